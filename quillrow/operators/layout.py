"""Geometry: items within regions, and pairs of items within a band, by bucketed range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps(a: str, b: str) -> Column:
    """Whether two rectangles (left, bottom, right, top arrays) share more than an edge."""
    x, y = F.col(a), F.col(b)
    return (x[0] < y[2]) & (y[0] < x[2]) & (x[1] < y[3]) & (y[1] < x[3])


def within(x: Column, y: Column, box: Column, slack: float = 0.0) -> Column:
    """Whether a point lies in a box, its edges and some slack included."""
    return x.between(box[0] - slack, box[2] + slack) & y.between(box[1] - slack, box[3] + slack)


def in_regions(items: DataFrame, regions: DataFrame, doc: str, side: float) -> DataFrame:
    """Text of each region: doc, page, region, n_items, text (top to bottom, left to right).

    items has doc, page, x, y, text; regions has doc, page, region, box. The join is on squares of
    `side`, so an item meets only the regions that touch its square. Regions without items stay, with
    an empty text.
    """
    tile = lambda c: F.floor(c / side).cast("int")
    cells = regions.withColumn("tx", F.explode(F.sequence(tile(F.col("box")[0]), tile(F.col("box")[2])))).withColumn("ty", F.explode(F.sequence(tile(F.col("box")[1]), tile(F.col("box")[3]))))
    own = items.withColumn("tx", tile(F.col("x"))).withColumn("ty", tile(F.col("y")))
    hits = own.join(cells, [doc, "page", "tx", "ty"]).where(within(F.col("x"), F.col("y"), F.col("box")))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("down"), "x", "text"))), lambda i: i["text"]), " ")
    found = hits.groupBy(doc, "page", "region").agg(F.count("*").alias("n_items"), said.alias("text"))
    return regions.select(doc, "page", "region").join(found, [doc, "page", "region"], "left").fillna({"n_items": 0, "text": ""})


def band_pairs(items: DataFrame, keys: list[str], value: str, width: float, item: str) -> DataFrame:
    """Pairs of items of one key whose values differ by `width` or less: keys, item_a, item_b, gap.

    Items meet in their value's bucket and the next one, so a pair is compared once or twice, never
    with all of its key.
    """
    b = F.floor(F.col(value) / width).cast("long")
    a = items.select(*keys, F.col(item).alias("item_a"), F.col(value).alias("va"), b.alias("bucket"))
    z = items.select(*keys, F.col(item).alias("item_b"), F.col(value).alias("vb"), b.alias("own")).withColumn("bucket", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)))
    near = a.join(z, [*keys, "bucket"]).where((F.col("item_a") < F.col("item_b")) & (F.abs(F.col("va") - F.col("vb")) <= width))
    return near.select(*keys, "item_a", "item_b", F.round(F.abs(F.col("va") - F.col("vb")), 6).alias("gap"))
