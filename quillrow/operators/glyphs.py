"""Positioned glyphs and runs: gaps between them, spaces they take, where they are placed, and the lines they make."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrow.session import ship

# Bounds of letter spacing as multiples of a word gap, and absolute ones in thousandths of a size.
TRACKED, TRACKED_MOST, CAPITALS, CAPITALS_MOST = (0.5, 3.0), 450.0, 1.25, 140.0
# Scripts set without spaces, scripts read from the right, and marks that join the word before them.
SPACELESS = r"[\x{3000}-\x{30FF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"
RIGHT_TO_LEFT = r"[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]"
JOINING = ".,;:!?)]}%’”»"
# Points within which a run is on a line, beyond which it may still be a line of its own, and how near
# the line's first run, or how far left of its last, it then starts.
ON_LINE, LEVEL, AT_MARGIN, LEFT_OF = 3.0, 0.5, 5.0, 10.0


def takes_space(before: Column, after: Column) -> Column:
    """Whether a word gap between two characters is a space."""
    no = [c.rlike(p) for c in (before, after) for p in (r"^\s", SPACELESS, RIGHT_TO_LEFT)]
    free = ~no[0]
    for n in no[1:]:
        free = free & ~n
    return F.coalesce(free & ~after.isin(*JOINING) & (F.length(before) > 0) & (F.length(after) > 0), F.lit(False))


def lower_median(values: Column) -> Column:
    """The middle value of an array, or the lower of the two middle ones."""
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), ((F.size(values) - 1) / 2).cast("int") + 1))


def tracking(gaps: Column, word_gap: Column) -> Column:
    """(gap, capitals) of letter spacing that a run's gaps show under a word gap, and whether it needs capitals; null if none."""
    seed = lower_median(gaps)
    found = lower_median(F.filter(gaps, lambda g: g <= seed + word_gap))
    fits = (found >= word_gap * TRACKED[0]) & (found <= F.least(word_gap * TRACKED[1], F.lit(TRACKED_MOST)))
    return F.when(fits, F.struct(found.alias("gap"), (found >= F.least(word_gap * CAPITALS, F.lit(CAPITALS_MOST))).alias("capitals")))


def composed(m: Column, n: Column) -> Column:
    """Two transforms (arrays a, b, c, d, e, f) after each other, m first."""
    a, b, c, d, e, f = (m[i] for i in range(6))
    p, q, r, s, t, u = (n[i] for i in range(6))
    return F.array(a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def placed(m: Column, x: Column, y: Column) -> Column:
    """Where a transform puts a point: (x, y)."""
    return F.struct((m[0] * x + m[2] * y + m[4]).alias("x"), (m[1] * x + m[3] * y + m[5]).alias("y"))


def earlier_in_column(glyphs: DataFrame, by: list[str], width: float, order: str = "y") -> DataFrame:
    """`glyphs` with column (its x in steps of width), above (the nearest glyph before it there) and drop (how far below it)."""
    own = glyphs.withColumn("column", F.floor(F.col("x") / width))
    run = Window.partitionBy(*by, "column").orderBy(F.desc(order), "x", "glyph")
    return own.withColumn("above", F.lag("glyph").over(run)).withColumn("drop", F.lag(order).over(run) - F.col(order))


def joins(line: list[tuple[float, float]], x: float, y: float) -> bool:
    """Whether a run at (x, y) goes on a line of the runs at these places."""
    (first_x, first_y), (last_x, _) = line[0], line[-1]
    apart = abs(first_y - y)
    return apart < ON_LINE and (apart <= LEVEL or (abs(x - first_x) >= AT_MARGIN and x >= last_x - LEFT_OF))


def text_lines(runs: DataFrame, by: list[str]) -> DataFrame:
    """Runs (by, x, y, text) with line and nth, both from 0: from the top, and from the left along a height.

    A run is compared with its line's first and last run, so sorted pages are folded, one pass a partition.
    """
    spark = runs.sparkSession
    ship(spark)
    columns = [*by, "x", "y", "text"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(c) for b in batches for c in zip(*(b.column(n).to_pylist() for n in columns), strict=True))
        out: list[tuple] = []
        for _, page in groupby(rows, key=lambda r: r[: len(by)]):
            at, line = [], -1
            for r in page:
                x, y = r[len(by)], r[len(by) + 1]
                if not at or not joins(at, x, y):
                    at, line = [], line + 1
                at.append((x, y))
                out.append((*r, line, len(at) - 1))
                if len(out) >= 50_000:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*columns, "line", "nth"])

    kinds = {f.name: f.dataType.simpleString() for f in runs.select(*by).schema}
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = [*[arrow[kinds[c]] for c in by], pa.float64(), pa.float64(), pa.string(), pa.int64(), pa.int64()]
    own = runs.select(*by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("text").cast("string").alias("text")).where("x IS NOT NULL AND y IS NOT NULL")
    sorted_ = own.repartition(*by).sortWithinPartitions(*by, F.desc("y"), "x", "text")
    ddl = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "x double, y double, text string, line long, nth long"])
    return sorted_.mapInArrow(fold, ddl)


def table_text(runs: DataFrame, by: list[str], width: float = 72.0) -> DataFrame:
    """A pipe table of each group's runs: a row a line, and a column each `width` points of x that holds a run."""
    own = text_lines(runs, by).withColumn("band", F.floor(F.col("x") / width))
    bands = own.groupBy(*by).agg(F.array_sort(F.collect_set("band")).alias("bands"))
    cells = own.groupBy(*by, "line", "band").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda r: F.replace(r["text"], F.lit("|"), F.lit(r"\|"))), " ").alias("cell"))
    lines = cells.groupBy(*by, "line").agg(F.map_from_entries(F.collect_list(F.struct("band", "cell"))).alias("held"))
    row = F.concat(F.lit("| "), F.array_join(F.transform("bands", lambda b: F.coalesce(F.try_element_at("held", b), F.lit(""))), " | "), F.lit(" |"))
    rows = lines.join(bands, by).select(*by, "line", row.alias("row"), F.size("bands").alias("n"))
    made = F.transform(F.array_sort(F.collect_list(F.struct("line", "row"))), lambda r: r["row"])
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.max("n")))
    out = rows.groupBy(*by).agg(made.alias("rows"), rule.alias("rule"))
    return out.select(*by, F.size("rows").cast("long").alias("n_rows"), F.array_join(F.concat(F.slice("rows", 1, 1), F.array("rule"), F.slice("rows", 2, 1 << 30)), "\n").alias("markdown"))
