"""Strict delimited text: delimiter sniffing, records by a state machine, and the pipe table they make."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Delimiters in order of preference, records sniffed, and limits of a file.
DELIMITERS = ",;\t|"
SNIFFED, MOST_RECORDS, MOST_COLUMNS, MOST_FIELD = 32, 100_000, 4096, 1 << 20


class Malformed(ValueError):
    """The text is no well-formed table; the message is a stable code."""


def records(text: str, delimiter: str, most: int | None = None) -> list[list[str]]:
    """Records of a text: quotes are doubled within quoted fields and stand nowhere else; blank records are skipped."""
    out: list[list[str]] = []
    row: list[str] = []
    field: list[str] = []
    quoted = closed = False
    i, n = 0, len(text)

    def end_field() -> None:
        nonlocal closed
        if sum(map(len, field)) > MOST_FIELD or len(row) >= MOST_COLUMNS:
            raise Malformed("resource_limit")
        row.append("".join(field))
        field.clear()
        closed = False

    def end_record(was_closed: bool) -> None:
        end_field()
        if row != [""] or was_closed:
            if len(out) >= MOST_RECORDS:
                raise Malformed("resource_limit")
            out.append(list(row))
        row.clear()

    while i < n and (most is None or len(out) < most):
        c = text[i]
        if c == "\0":
            raise Malformed("malformed")
        if quoted:
            if c == '"':
                if text[i + 1 : i + 2] == '"':
                    field.append('"')
                    i += 1
                else:
                    quoted, closed = False, True
            else:
                field.append(c)
        elif c == delimiter:
            end_field()
        elif c == "\n" or c == "\r":
            if c == "\r" and text[i + 1 : i + 2] == "\n":
                i += 1
            end_record(closed)
        elif c == '"' and not field and not closed:
            quoted = True
        elif c == '"' or closed:
            raise Malformed("malformed")
        else:
            field.append(c)
        i += 1
    if quoted and i >= n:
        raise Malformed("malformed")
    if i >= n and (field or row or closed):
        end_record(closed)
    return out


def sniffed(text: str) -> str:
    """The delimiter whose most usual number of columns is usual most; more columns break ties, then order."""
    best, delimiter = 0, DELIMITERS[0]
    for d in DELIMITERS:
        try:
            widths = Counter(len(r) for r in records(text, d, SNIFFED))
        except Malformed:
            continue
        if not widths:
            continue
        count, width = max((c, w) for w, c in widths.items())
        score = count * 1000 + min(width, 500)
        if width >= 2 and score > best:
            best, delimiter = score, d
    return delimiter


def escaped(cell: str) -> str:
    """A cell's text in Markdown."""
    out = cell.replace("\\", "\\\\")
    for c in "|<>[]*_`":
        out = out.replace(c, "\\" + c)
    return out.replace("\r\n", " ").replace("\n", " ").replace("\r", " ")


def to_markdown(data: bytes) -> str:
    """A pipe table of a file's records, a rule after the first; all records have as many columns."""
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        raise Malformed("malformed") from e
    rows = records(text, sniffed(text))
    if not rows:
        raise Malformed("malformed")
    if any(len(r) != len(rows[0]) for r in rows):
        raise Malformed("malformed")
    made = ["| " + " | ".join(escaped(c.strip()) for c in r) + " |" for r in rows]
    return "\n".join([made[0], "|" + "---|" * len(rows[0]), *made[1:]]) + "\n"


def converted(files: DataFrame, content: str = "content") -> DataFrame:
    """`files` with markdown or an error code, for a binary column."""
    from quillrow.session import ship

    ship(files.sparkSession)

    @F.pandas_udf("markdown string, error string")
    def convert(column):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for data in column:
            try:
                out.append((to_markdown(bytes(data)) if data is not None else None, None if data is not None else "malformed"))
            except Malformed as e:
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["markdown", "error"])

    return files.withColumn("table_", convert(content)).withColumns({"markdown": F.col("table_.markdown"), "error": F.col("table_.error")}).drop("table_")


def best_delimiter(samples: DataFrame, key: str, text: str) -> DataFrame:
    """Sniffing as an aggregation, for texts without quotes: key, delimiter."""
    tried = samples.select(key, text, F.posexplode(F.array(*map(F.lit, DELIMITERS))).alias("rank", "delimiter"))
    lines = F.slice(F.filter(F.split(text, "\r?\n"), lambda x: x != ""), 1, SNIFFED)
    width = tried.select(key, "rank", "delimiter", F.explode(lines).alias("line")).withColumn("width", F.size(F.split("line", F.concat(F.lit(r"\Q"), "delimiter", F.lit(r"\E")), -1)))
    usual = width.groupBy(key, "rank", "delimiter", "width").agg(F.count("*").alias("n")).groupBy(key, "rank", "delimiter").agg(F.max(F.struct("n", "width")).alias("m"))
    scored = usual.withColumn("score", F.when(F.col("m.width") >= 2, F.col("m.n") * 1000 + F.least(F.col("m.width"), F.lit(500))).otherwise(0))
    return scored.groupBy(key).agg(F.max_by("delimiter", F.struct("score", -F.col("rank"))).alias("delimiter"))


def cell_markdown(cell: Column) -> Column:
    """`escaped` as a column function."""
    return F.regexp_replace(F.regexp_replace(cell, r"([\\|<>\[\]*_`])", r"\\$1"), "\r\n|\n|\r", " ")
