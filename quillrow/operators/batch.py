"""Batches: results or errors in the order asked for, top rows, and algebra on sets of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def batch(requests: DataFrame, results: DataFrame, key: str, paths: str = "paths") -> DataFrame:
    """Each asked path of a request (an array column), in order, with its result or an error.

    Returns the request's other columns, pos (from 0), key, the result's columns and error.
    """
    asked = requests.select(*[c for c in requests.columns if c != paths], F.posexplode(paths).alias("pos", key))
    out = asked.join(results.withColumn("found_", F.lit(True)), key, "left")
    return out.withColumn("error", F.when(F.col("found_").isNull(), F.lit("not found"))).drop("found_")


def in_order(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Rows of a batch as one array of structs in the order asked for."""
    made = F.transform(F.array_sort(F.collect_list(F.struct("pos", *columns))), lambda x: F.struct(*[x[c].alias(c) for c in columns]))
    return rows.groupBy(*by).agg(made.alias("items"))


def top(rows: Column, size: int) -> Column:
    """The first rows of an array of structs by their fields, greatest first."""
    return F.slice(F.sort_array(rows, asc=False), 1, size)


def pages_of(*arrays: Column) -> Column:
    """All pages of some arrays, sorted, each once."""
    none = F.array().cast("array<int>")
    out = F.coalesce(arrays[0], none)
    for a in arrays[1:]:
        out = F.array_union(out, F.coalesce(a, none))
    return F.array_sort(F.array_distinct(out))


def only(pages: Column, wanted: Column) -> Column:
    """Pages that are wanted; a null wish is for all."""
    return F.when(wanted.isNull(), pages).otherwise(F.array_intersect(pages, wanted))
