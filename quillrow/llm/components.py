"""Connected components of a link table, by alternating large-star and small-star rounds.

No step gathers the links of one node: minima are summed before their shuffle, and every join has
plain exchanges on both sides, so that adaptive execution can split a hub's rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrow.llm.common import dropped, written


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) of one block as a star of each component: (node, smallest node), without the latter itself."""
    if not len(u):
        return u, v
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _settled(links: DataFrame) -> bool:
    """True if every node has one parent and no parent has a parent."""
    n = links.agg(F.count("*").alias("n"), F.count_distinct("a").alias("d")).first()
    if n["n"] != n["d"]:
        return False
    return links.select(F.col("b").alias("a")).distinct().join(links.select("a").distinct(), "a", "left_semi").limit(1).count() == 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest reachable node, for every node that has a link to another.

    Nodes are longs. Null ends and links of a node with itself are ignored. Links may repeat.
    """
    x, y = F.col(a), F.col(b)
    links = written(edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "links")
    while not _settled(links):
        # Large star: each node's larger neighbours go to its smallest neighbour or itself.
        below = written(links.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "b"), "below")
        large = written(links.join(below, "b", "left").select("a", F.coalesce("m", "b").alias("b")).unionByName(below.select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "large")
        # Small star: each node and its smaller neighbours go to the smallest of these.
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        moved = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, links = links, written(moved.unionByName(least.withColumnRenamed("m", "b")).distinct(), "links")
        dropped(before, below, large, least)
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
