"""Column functions on text: prefixes, lines, amounts, cells, bare text, Roman numbers.

Patterns are for Java's dialect; (?d) keeps `.` and `$` to line feeds only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An amount: signs, a currency mark, grouped thousands or decimals, and closing marks.
AMOUNT = r"^[(\-+−]*[$€£]*([0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?|[0-9]+(,[0-9]+)*\.[0-9]+)[)%\-]*$"
#: A date as PDF files state it.
PDF_DATE = r"^D:[0-9]{4}([0-9]{2}){0,5}([Zz]|[+\-][0-9]{2}'?([0-9]{2}'?)?)?$"


def byte_prefix(text: Column, size: int) -> Column:
    """The longest prefix of whole characters within so many UTF-8 bytes."""
    data = F.encode(text, "UTF-8")
    # A character has four bytes at most, so one of four cuts is at a boundary.
    return F.coalesce(*[F.try_validate_utf8(F.substring(data, 1, size - k).cast("string")) for k in range(4)])


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line: key, ln (from 0), raw (without its line feed), off (bytes before it)."""
    parts = F.split(text, "\n", -1)
    # A final line feed ends the last line; it starts none.
    own = F.when(F.col(text) == "", F.array().cast("array<string>")).when(F.endswith(text, F.lit("\n")), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    each = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(own).alias("ln", "raw"))
    before = Window.partitionBy(key).orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("off", F.coalesce(F.sum(F.octet_length("raw") + 1).over(before), F.lit(0)).cast("long"))


def is_amount(token: Column) -> Column:
    return token.rlike(AMOUNT)


def cells(row: Column) -> Column:
    """Trimmed cells of a pipe-table row; escaped pipes stay."""
    body = F.regexp_replace(F.regexp_replace(F.trim(row), r"^\|", ""), r"(?<!\\)\|$", "")
    return F.transform(F.split(body, r"(?<!\\)\|", -1), lambda c: F.trim(c))


def amount_count(cell: Column) -> Column:
    """Number of amounts in a cell, 0 if anything else is in it."""
    tokens = F.filter(F.split(F.trim(cell), r"\s+"), lambda t: t != "")
    return F.when((F.size(tokens) > 0) & F.forall(tokens, is_amount), F.size(tokens)).otherwise(0).cast("long")


def is_table_row(line: Column) -> Column:
    t = F.trim(line)
    return F.startswith(t, F.lit("|")) & F.endswith(t, F.lit("|")) & (F.length(t) > 1)


def is_separator(line: Column) -> Column:
    return is_table_row(line) & F.trim(line).rlike(r"^[|:\- ]+$") & F.contains(line, F.lit("-"))


def normalized(text: Column) -> Column:
    """Without emphasis marks and escapes, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[*_`\\]", ""), r"\s+", " "))


def bare(text: Column) -> Column:
    """Without white space, pipes, emphasis and heading marks."""
    return F.regexp_replace(text, r"[\s|*_`#\[\]]", "")


def structural(line: Column) -> Column:
    """A heading, list item or numbered line."""
    return F.trim(line).rlike(r"^(#{1,6}\s|[-*+•]\s|[0-9]{1,3}[.)]\s)")


def decorative(line: Column) -> Column:
    """One character over and over."""
    return F.trim(line).rlike(r"^(.)\1*$")


def substantial(word: Column) -> Column:
    return word.rlike("[0-9]") | (F.length(word) >= 4)


def pdf_date(text: Column) -> Column:
    """The trimmed date if it is one, else null."""
    return F.when(F.trim(text).rlike(PDF_DATE), F.trim(text))


def roman_value(token: Column) -> Column:
    """Value of a Roman number read from the right, null if a letter is none; a total below zero or of zero is null."""
    values = F.create_map(*[F.lit(x) for k, v in (("i", 1), ("v", 5), ("x", 10), ("l", 50), ("c", 100), ("d", 500), ("m", 1000)) for x in (k, v)])
    letters = F.filter(F.split(F.lower(F.reverse(token)), ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("previous"))

    def step(s: Column, c: Column) -> Column:
        v = F.try_element_at(values, c)
        less = v < s["previous"]
        return F.struct(F.when(less, F.when(s["total"] >= v, s["total"] - v)).otherwise(s["total"] + v).alias("total"), F.when(less, s["previous"]).otherwise(v).alias("previous"))

    total = F.aggregate(letters, start, step)["total"]
    return F.when(token.rlike("^[ivxlcdmIVXLCDM]+$") & (total > 0), total)
