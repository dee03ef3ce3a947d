"""Pipe tables in Markdown: blocks, cells, and what conversion may have done to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrow.functions import text as T


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines outside of code fences, with is_row, is_rule, block and paragraph.

    block numbers runs of table rows and of other lines; paragraph numbers runs of lines between blank
    ones. Both count from the start of the text.
    """
    line = T.lines(docs, key, text).withColumn("raw", F.regexp_replace("raw", "\r$", ""))
    run = Window.partitionBy(key).orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.ltrim("raw").rlike("^(```|~~~)")
    out = line.withColumn("fence", fence).withColumn("fences", F.sum(fence.cast("int")).over(run)).where(~F.col("fence") & (F.col("fences") % 2 == 0))
    out = out.withColumn("is_row", T.is_table_row(F.col("raw"))).withColumn("is_rule", T.is_separator(F.col("raw"))).withColumn("blank", F.trim("raw") == "")
    order = Window.partitionBy(key).orderBy("ln")
    new = F.coalesce(F.lag("is_row").over(order) != F.col("is_row"), F.lit(True)) | F.coalesce(F.lag("blank").over(order) != F.col("blank"), F.lit(True))
    return out.withColumn("block", F.sum(new.cast("int")).over(run)).drop("fence", "fences")


def cells(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per cell: key, block, row (from 0, rules left out), col (from 0), cell, n_amounts."""
    rows = blocks(docs, key, text).where(F.col("is_row") & ~F.col("is_rule"))
    place = Window.partitionBy(key, "block").orderBy("ln")
    numbered = rows.withColumn("row", (F.row_number().over(place) - 1).cast("long"))
    each = numbered.select(key, F.col("block").cast("long").alias("block"), "row", F.posexplode(T.cells(F.col("raw"))).alias("col", "cell"))
    return each.withColumn("col", F.col("col").cast("long")).withColumn("n_amounts", T.amount_count(F.col("cell")))


def merged(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 256) -> DataFrame:
    """The first `most` cells of each text that hold two amounts or more."""
    order = Window.partitionBy(key).orderBy("block", "row", "col")
    return cells(docs, key, text).where(F.col("n_amounts") >= 2).withColumn("number", F.row_number().over(order)).where(F.col("number") <= most).drop("number")


def rows_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tables whose first two rows also end the paragraph before them: key, block."""
    line = blocks(docs, key, text)
    first = line.where(F.col("is_row") & ~F.col("is_rule")).withColumn("n", F.row_number().over(Window.partitionBy(key, "block").orderBy("ln"))).where(F.col("n") <= 2)
    said = first.groupBy(key, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "raw"))), lambda x: T.normalized(F.array_join(F.filter(T.cells(x["raw"]), lambda c: c != ""), " "))), " ").alias("said"), F.max("n").alias("n"))
    before = line.where(~F.col("is_row") & ~F.col("blank")).groupBy(key, "block").agg(T.normalized(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "raw"))), lambda x: x["raw"]), " ")).alias("paragraph"))
    # The paragraph is the block just before, or the one before a blank block.
    near = before.select(key, F.explode(F.array(F.col("block") + 1, F.col("block") + 2)).alias("block"), "paragraph", F.col("block").alias("own"))
    hit = said.join(near, [key, "block"]).where((F.col("n") == 2) & (F.col("said") != "") & ((F.col("paragraph") == F.col("said")) | F.endswith("paragraph", F.concat(F.lit(" "), "said"))))
    return hit.select(key, F.col("block").cast("long").alias("block")).distinct()


def detached(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 64) -> DataFrame:
    """Amounts in the paragraph right after a table that the table doesn't hold: key, block, amounts in order."""
    line = blocks(docs, key, text)
    held = cells(docs, key, text).groupBy(key, "block").agg(F.flatten(F.collect_list(F.split("cell", r"\s+"))).alias("held"))
    after = line.where(~F.col("is_row") & ~F.col("blank")).groupBy(key, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "raw"))), lambda x: x["raw"]), " ").alias("paragraph"))
    amounts = after.select(key, F.explode(F.array(F.col("block") - 1, F.col("block") - 2)).alias("block"), F.filter(F.split("paragraph", r"\s+"), T.is_amount).alias("after")).where(F.size("after") > 0)
    out = amounts.join(held, [key, "block"]).withColumn("amounts", F.slice(F.array_except("after", "held"), 1, most))
    return out.where(F.size("amounts") > 0).select(key, F.col("block").cast("long").alias("block"), F.array_join("amounts", " ").alias("amounts"))


def not_rows(lines: DataFrame, held: DataFrame, by: list[str]) -> DataFrame:
    """Lines (by, items) that are no row of the tables of `held` (by, row): neither as a whole nor with every item a cell.

    Items and cells are compared bare; empty items count as any cell.
    """
    bare = lambda c: T.bare(c)
    split = held.select(*by, F.col("row"), F.filter(F.transform(F.split("row", r"\|"), bare), lambda c: c != "").alias("cells"))
    known = split.groupBy(*by).agg(F.collect_set(bare(F.col("row"))).alias("rows_"), F.array_distinct(F.flatten(F.collect_list("cells"))).alias("cells_"))
    whole = bare(F.array_join("items", " "))
    every = F.forall(F.transform("items", bare), lambda c: (c == "") | F.array_contains("cells_", c))
    out = lines.join(known, by, "left")
    return out.where(F.col("rows_").isNull() | ~(F.array_contains("rows_", whole) | every)).drop("rows_", "cells_")


def on_label_lines(amounts: DataFrame, labels: DataFrame, by: list[str], band: float) -> DataFrame:
    """Groups of which more than half of the amounts (by, y) stand within a band of a label's height (by, y).

    Returns by, n_read and n_on_rows. Heights meet in steps of the band, so no group's pairs are all made.
    """
    step = lambda df: df.withColumn("step", F.floor(F.col("y") / band))
    own = step(amounts.select(*by, "y")).withColumn("amount", F.monotonically_increasing_id())
    near = step(labels.select(*by, F.col("y").alias("y"))).groupBy(*by, "step").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    met = own.select(*by, "amount", "y", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step")).join(near, [*by, "step"])
    # Of a step's labels the lowest and the highest decide: a step is one band high.
    hit = met.where((F.abs(F.col("y") - F.col("low")) <= band) | (F.abs(F.col("y") - F.col("high")) <= band) | F.col("y").between(F.col("low"), F.col("high")))
    counted = hit.groupBy(*by).agg(F.count_distinct("amount").alias("n_on_rows"))
    return own.groupBy(*by).agg(F.count("*").alias("n_read")).join(counted, by).where(2 * F.col("n_on_rows") > F.col("n_read"))


def cell_styles(cells: DataFrame, rows: DataFrame, spans: DataFrame, sheet: str = "sheet") -> DataFrame:
    """`cells` (sheet, row, col, style) with the style that applies: its own, its row's, or that of a span of columns.

    `rows` is (sheet, row, row_style), `spans` (sheet, start, end, span_style) with end exclusive. Spans
    are opened into their columns, which a sheet has few of.
    """
    columns = spans.where("end > start").select(sheet, F.explode(F.expr("sequence(start, end - 1)")).alias("col"), "span_style").groupBy(sheet, "col").agg(F.min("span_style").alias("span_style"))
    out = cells.join(rows, [sheet, "row"], "left").join(columns, [sheet, "col"], "left")
    return out.withColumn("applies", F.coalesce("style", "row_style", "span_style")).drop("row_style", "span_style")


def without_once(have: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of `have` less one for each equal row of `gone`."""
    return have.exceptAll(gone.select(*have.columns))
