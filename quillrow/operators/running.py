"""Running headers and footers: lines that pages repeat near their edges, and which of them a text lost."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrow.functions import text as T
from quillrow.session import ship

# Lines from either edge that count, pages and share of pages that make a repeat, its height's spread.
EDGE_LINES, LEAST_PAGES, LEAST_SHARE, MOST_SPREAD = 5, 3, 0.3, 0.05
# Words before a page's number, between a count and its total, and before a number that is something's own;
# months; the greatest distance of a number from its page's, and the greatest Roman one.
PAGE_WORDS = frozenset(["page", "pages", "pg", "p", "pp", "seite", "página", "pagina", "blatt", "sheet", "folio", "side"])
COUNT_WORDS = frozenset(["of", "von", "de"])
LABEL_WORDS = frozenset(["no", "nr", "number", "num", "check", "cheque", "invoice", "inv", "account", "acct", "id", "ref", "reference", "order", "receipt", "claim", "policy", "loan", "case", "ticket", "voucher", "item", "unit", "suite", "form", "document", "file", "batch", "transaction", "confirmation"])
MONTHS = frozenset(["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec"])
MOST_OFFSET, MOST_ROMAN = 1000, 100
_DASHES, _BARS, _SPACES = "-–—", "|·•", " \t\n\r\f\v\u00a0"
_FRAME = _DASHES + "()[]|." + _SPACES
_PIECES = re.compile(r"[0-9]+|[^\W\d_]+|(?:[^\w]|_|(?![0-9])\d)+")
_ROMAN = re.compile("m*(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})")
_LETTERS = {"m": 1000, "d": 500, "c": 100, "l": 50, "x": 10, "v": 5, "i": 1}


def compared(line: Column) -> Column:
    """A line as it is compared: single spaces, without numbers at either end."""
    squeezed = F.trim(F.regexp_replace(line, r"\s+", " "))
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(squeezed, r"^\p{N}+", "")), r"\p{N}+$", ""))


def roman(word: str) -> int | None:
    """Value of a Roman numeral of one case in its own spelling."""
    low = word.lower()
    if not 0 < len(word) <= 12 or word not in (low, word.upper()) or not _ROMAN.fullmatch(low):
        return None
    own = [_LETTERS[c] for c in low]
    return sum(-v if v < max(own[i + 1 : i + 2], default=0) else v for i, v in enumerate(own))


class _Line:
    """Pieces of a line: what each is and what stands beside it."""

    def __init__(self, text: str) -> None:
        self.said = _PIECES.findall(text)
        self.word = [p[0].isalpha() for p in self.said]
        self.value = [int(p) if p.isascii() and p.isdigit() else roman(p) if w else None for p, w in zip(self.said, self.word, strict=True)]
        self.mark = [v is None and not w for v, w in zip(self.value, self.word, strict=True)]
        # The nearest piece before and after each that isn't blank, in one pass either way.
        self.last, self.next = [], [None] * len(self.said)
        seen = None
        for i, p in enumerate(self.said):
            self.last.append(seen)
            seen = i if p.strip() else seen
        seen = None
        for i in range(len(self.said) - 1, -1, -1):
            self.next[i] = seen
            seen = i if self.said[i].strip() else seen
        # Pieces that frame a count: up to the first other one, and from the last other one.
        others = [i for i in range(len(self.said)) if not self.is_mark(i, _FRAME)]
        self.outer = (others[0], others[-1]) if others else (0, 0)

    def is_word(self, i: int | None, among: frozenset[str]) -> bool:
        return i is not None and not self.mark[i] and self.said[i].lower() in among

    def is_mark(self, i: int | None, only: str) -> bool:
        """Whether a piece is there and of these marks alone."""
        return i is not None and 0 <= i < len(self.said) and self.mark[i] and not self.said[i].strip(only)

    def number(self, i: int) -> int | None:
        return self.value[i] if 0 <= i < len(self.said) else None

    def lead(self, i: int) -> int | None:
        """The piece before one, past marks such as a colon."""
        at = self.last[i]
        return self.last[at] if at is not None and self.mark[at] and not self.said[at].strip().strip(".:#") else at

    def paged(self, i: int) -> bool | None:
        """Whether a page word is joined to a number; None where there is none before it."""
        if not self.is_word(self.lead(i), PAGE_WORDS):
            return None
        return i > 0 and not self.mark[i - 1]

    def counted(self, i: int) -> int | None:
        """The place of the total where a number counts, as in 3 of 7."""
        way = self.next[i]
        total = None if way is None else self.next[way]
        if self.value[i] is None or total is None or self.value[total] is None or self.value[i] > self.value[total]:
            return None
        slash = self.said[way].strip() == "/"
        chained = [j for j in (self.next[total], i - 1) if j is not None and j >= 0 and self.mark[j] and "/" in self.said[j]]
        if not (slash or self.is_word(way, COUNT_WORDS)) or (slash and chained):
            return None
        return total if self.outer == (i, total) or self.paged(i) is False else None

    def reading(self, i: int, page: int) -> str | None:
        """What a number that says its page, or the time, is masked with; None of any other."""
        value, end = self.value[i], len(self.said) - 1
        if self.said[i].isdigit() and len(self.said[i]) <= 2 and any(self.said[j] == ":" and self.number(k) is not None for j, k in ((i - 1, i - 2), (i + 1, i + 2)) if 0 <= j <= end and k >= 0):
            return "#"
        joined = self.paged(i)
        dashes = [j for j in (i - 1, i + 1) if self.is_mark(j, _DASHES + _SPACES) and set(self.said[j]) & set(_DASHES)]
        framed = len(dashes) == 2 and self.number(i - 2) is None and self.number(i + 2) is None
        if (joined is False or framed) and 0 <= value <= page or (joined and value == page):
            return "#"
        label = self.last[i] is not None and (self.said[self.last[i]].strip() == "#" or self.is_word(self.lead(i), LABEL_WORDS))
        dated = self.is_word(self.last[i], MONTHS) or self.is_word(self.next[i], MONTHS)
        outer = [j for j, edge in ((i + 1, i == 0), (i - 1, i == end)) if edge]
        edge = any(not 0 <= j <= end or self.is_mark(j, _BARS + _SPACES) for j in outer)
        small = not self.word[i] or (self.said[i].islower() and value <= MOST_ROMAN)
        if (joined is False or framed or (edge and small and not dated and not label)) and abs(value - page) <= MOST_OFFSET:
            return f"#{value - page}#"
        return None


def masked(text: str, page: int) -> tuple[str, bool]:
    """A line with its page numbers, counts and times masked, and whether it says nothing else."""
    line, out, only = _Line(text.strip()), [], bool(text.strip())
    counts = {j for i in range(len(line.said)) if (total := line.counted(i)) is not None for j in (i, total)}
    for i, said in enumerate(line.said):
        if line.value[i] is None:
            only = only and (line.mark[i] or said.lower() in PAGE_WORDS | COUNT_WORDS)
            out.append(said)
            continue
        mask = "#" if i in counts else line.reading(i, page)
        only = only and mask is not None
        out.append(said if mask is None else mask)
    return "".join(out), only


def masked_key(text: Column, page: Column) -> Column:
    """The key of a line with its numbers masked; of one that says nothing else, null."""

    @F.pandas_udf("string")
    def read(texts, pages):  # noqa: ANN001, ANN202
        import pandas as pd

        made = [masked(t or "", int(p)) for t, p in zip(texts, pages, strict=True)]
        return pd.Series([None if only else " ".join(said.split()) for said, only in made], dtype=object)

    return read(text, page)


def edges(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The lines (doc, page, y, text) within EDGE_LINES heights of the top or bottom of their page."""
    page = Window.partitionBy(doc, "page")
    up, down = F.dense_rank().over(page.orderBy(F.desc("y"))), F.dense_rank().over(page.orderBy("y"))
    return lines.withColumn("from_top", up).withColumn("from_bottom", down).where((F.col("from_top") <= EDGE_LINES) | (F.col("from_bottom") <= EDGE_LINES)).drop("from_top", "from_bottom")


def repeated(lines: DataFrame, doc: str = "doc_id", key: Callable[[Column, Column], Column] = lambda text, page: compared(text)) -> DataFrame:
    """Edge lines that enough pages of a document repeat at about one height, by their key (of text and page).

    About one height is a spread of a small share of the pages' mean height.

    Returns doc, line_key, pages, first_page and first_text. Headings, list items, lines of one
    character and short lines don't count.
    """
    ship(lines.sparkSession)
    heights = lines.groupBy(doc, "page").agg((F.max("y") - F.min("y")).alias("height"))
    pages = heights.groupBy(doc).agg(F.count("*").alias("page_count"), F.greatest(F.avg("height"), F.lit(1.0)).alias("span"))
    kept = edges(lines, doc).where(~T.structural(F.col("text")) & ~T.decorative(F.col("text"))).withColumn("line_key", key(F.col("text"), F.col("page"))).where(F.length("line_key") >= 10)
    out = kept.groupBy(doc, "line_key").agg(F.count_distinct("page").alias("pages"), F.stddev_pop("y").alias("spread"), F.min(F.struct("page", "text")).alias("first"))
    least = F.greatest(F.lit(LEAST_PAGES), F.floor(F.col("page_count") * LEAST_SHARE))
    held = out.join(pages, doc).where((F.col("pages") >= least) & (F.col("spread") / F.col("span") < MOST_SPREAD))
    return held.select(doc, "line_key", F.col("pages").cast("long").alias("pages"), F.col("first.page").cast("long").alias("first_page"), F.col("first.text").alias("first_text"))


def lost(lines: DataFrame, markdown: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Repeated lines that their document's Markdown doesn't show anywhere."""
    kept = T.lines(markdown, doc, text).select(doc, compared(F.col("raw")).alias("line_key")).distinct()
    return repeated(lines, doc).join(kept, [doc, "line_key"], "left_anti")
