"""Decisions on pages: how a page is turned, whether its order is jumbled, what was never checked, and what a document's record says."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrow.functions import text as T

# Slope of 20 degrees, share of turned runs that turns a page, a move between runs, and moves up that jumble.
SLOPE, TURNED_SHARE, MOVE, LEAST_RUNS, LEAST_MOVES, UP_SHARE = 0.364, (2, 3), 50.0, 5, 3, 0.4
# Fixed value: the reason that marks a page as garbled.
GARBLED = "suspected_garbled_text"


def turns(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and turn of each page: up, down or none, by the directions (dx, dy) of its runs."""
    a, b = F.abs("dx"), F.abs("dy")
    across = b <= a * SLOPE
    upright = ~across & (a <= b * SLOPE)
    n = runs.groupBy(*keys).agg(F.count_if(across).alias("across"), F.count_if(upright & (F.col("dy") > 0)).alias("up"), F.count_if(upright & (F.col("dy") <= 0)).alias("down"))
    turned, every = F.col("up") + F.col("down"), F.col("across") + F.col("up") + F.col("down")
    most = (every >= 2) & (turned * TURNED_SHARE[1] >= every * TURNED_SHARE[0])
    return n.select(*keys, F.when(most & (F.col("up") > F.col("down")), "up").when(most & (F.col("up") < F.col("down")), "down").otherwise("none").alias("turn"))


def turned(x: Column, y: Column, turn: Column) -> tuple[Column, Column]:
    """A point of a page as it reads along x."""
    return F.when(turn == "up", y).when(turn == "down", -y).otherwise(x), F.when(turn == "up", -x).when(turn == "down", x).otherwise(y)


def jumbled(runs: DataFrame, keys: list[str], order: str, y: str = "y") -> DataFrame:
    """keys and jumbled of each page: whether too many of its long moves from run to run go up."""
    move = F.col(y) - F.lag(y).over(Window.partitionBy(*keys).orderBy(order))
    n = runs.withColumn("move", move).groupBy(*keys).agg(F.count("*").alias("runs"), F.count_if(F.col("move") > MOVE).alias("up"), F.count_if(F.col("move") < -MOVE).alias("down"))
    moves = F.col("up") + F.col("down")
    return n.select(*keys, ((F.col("runs") >= LEAST_RUNS) & (moves >= LEAST_MOVES) & (F.col("up") / F.greatest(moves, F.lit(1)) > UP_SHARE)).alias("jumbled"))


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Bare texts of cells side by side in table rows, empty cells passed over: key, one, other, each pair once."""
    rows = T.lines(docs, key, text).where(T.is_table_row(F.col("raw")) & ~F.trim("raw").rlike(r"^[|:\- ]*$"))
    own = F.filter(F.transform(F.split("raw", r"\|"), lambda c: T.bare(c)), lambda c: c != "")
    pairs = F.zip_with(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))), F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("one"), b.alias("other")))
    return rows.select(key, F.explode(pairs).alias("p")).select(key, "p.one", "p.other").distinct()


def unchecked(first: Column, page_count: Column, ocr: Column, only: Column | None = None) -> Column:
    """Pages from the first unchecked one on that are wanted and need no OCR; null if all were checked."""
    none = F.array().cast("array<int>")
    pages = F.when(first <= page_count, F.sequence(first, page_count)).otherwise(none)
    rest = F.array_except(pages, F.coalesce(ocr, none))
    return F.when(first.isNotNull(), rest if only is None else F.when(only.isNull(), rest).otherwise(F.array_intersect(rest, only)))


def composite_misread(misread: Column, read_as: Column, says: Column, evidence: Column, shown: Column) -> Column:
    """Whether a page's composite-font text is read wrongly.

    read_as, says and evidence are arrays of bare texts (null where a page has none), shown those that
    the document shows. Text in a font that may have a map is reported where it is shown as read
    without one; other text unless all that it says is found.
    """
    known = read_as.isNotNull()
    found = F.size(F.array_except(says, shown)) == 0
    wrong = F.arrays_overlap(read_as, shown) | (F.size(says) == 0) | ~found
    return F.coalesce(F.arrays_overlap(evidence, shown), F.lit(False)) | (misread & (~known | wrong))


def record(rows: DataFrame, analyzed: str = "analyzed", whole: str = "whole") -> DataFrame:
    """Documents' records: layout only where it was analysed, confidence 0 for text without any, encoding issues where a page is garbled."""
    empty = F.col(whole) & (F.col("pdf_type") == "TextBased") & (F.trim(F.coalesce("markdown", F.lit(""))) == "")
    garbled = F.exists("ocr_reasons", lambda p: F.array_contains(p["reasons"], GARBLED))
    return rows.withColumns({"layout": F.when(F.col(analyzed), F.col("layout")), "confidence": F.when(empty, F.lit(0.0)).otherwise(F.col("confidence")), "has_encoding_issues": F.col("has_encoding_issues") | garbled})


def embedded_message(files: Column, portfolio: Column) -> Column:
    """What is said of embedded files; null without any."""
    said = F.when(portfolio, F.format_string("portfolio of %d files", files)).otherwise(F.format_string("%d attached files", files))
    return F.when(files > 0, said)


def split_words(docs: DataFrame, words: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words that a text shows with a space or a cell's edge within: key, word, splits, definite.

    A line's end within a word is no split; one right after a hyphen isn't definite. Emphasis and
    escapes are read through.
    """
    from quillrow.session import ship

    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    gap = r"[\\*]*(?:[^\S\r\n]|\||[\\*])*"
    known = [(w, re.compile(r"(?<![^\W_])" + gap.join(map(re.escape, w)) + r"(?![^\W_])")) for w in sorted(set(words)) if len(w) > 1]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, t in zip(batch[key], batch[text], strict=True):
                for w, pattern in known:
                    inner = [m[0] for m in pattern.finditer(t or "") if re.search(r"[\s|]", m[0])]
                    if inner:
                        out.append((k, w, len(inner), sum(bool(re.search(r"[^\-\s|\\*][\\*]*[\s|]", x)) for x in inner)))
            yield pd.DataFrame(out, columns=[key, "word", "splits", "definite"])

    return docs.select(key, text).mapInPandas(search, f"`{key}` {kind}, word string, splits long, definite long")


def widest_first(words: DataFrame, misread: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Pages that hold a misread word, widest gap first and then in order: doc, place (from 1), page, gap."""
    own = words.join(misread.select(doc, F.col("word")).distinct(), [doc, "word"], "left_semi").groupBy(doc, "page").agg(F.max("gap").alias("gap"))
    return own.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("gap"), "page")))


def accuracy(pairs: DataFrame, truth: str = "truth", said: str = "said") -> DataFrame:
    """`pairs` with accuracy, the matching share of two texts without case, punctuation and extra spaces."""
    from quillrow.session import ship

    ship(pairs.sparkSession)

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        plain = lambda t: " ".join(re.sub(r"[^\w\s]", "", (t or "").lower()).split())
        return pd.Series([SequenceMatcher(None, plain(x), plain(y)).ratio() for x, y in zip(a, b, strict=True)], dtype=float)

    return pairs.withColumn("accuracy", ratio(truth, said))
