"""Embedding near-dedup by an epsilon grid order join.

Unit vectors are projected on leading principal dimensions and get the grid cell of side epsilon
that they fall in there, epsilon being the Euclidean distance that the least cosine allows. Rows of
one group are sorted by their cells and cut into blocks; two blocks whose cells are provably further
apart than epsilon are never joined, and within a pair of blocks the two sequences are halved again
and again, skipping what is provably distant, until short stretches are compared exactly.

Bounds: the principal dimensions are fitted on at most `sample_rows` rows (smallest hash). Any
orthonormal directions give the same result; they only decide how much is skipped.

Shapes of input with a defined result: null, zero or non-finite vectors and rows with a null label
link with nothing; vectors of different lengths never link; equal vectors are kept as one class with
its number of members, so groups of copies cost one row; rows that repeat a vec_id each count as a link,
and classes that share their least vec_id are one node; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrow.llm import common, vectors
from quillrow.llm.ann import _last
from quillrow.llm.components import components, local_stars

#: Rows of a block, rows at which the recursion compares outright, and grid dimensions.
BLOCK, LEAF, DIMS = 4096, 128, 8


def principal(rows: list[np.ndarray]) -> dict[int, np.ndarray]:
    """Leading principal directions of unit vectors, by length of vector."""
    by: dict[int, list[np.ndarray]] = {}
    for v in rows:
        x = np.asarray(v, np.float64)
        by.setdefault(len(x), []).append(x / np.linalg.norm(x))
    out = {}
    for d, v in by.items():
        x = np.stack(v)
        _, _, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
        out[d] = vt[:DIMS]
    return out


def gap(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> float:
    """Least squared distance between two boxes."""
    g = np.maximum(0.0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float((g * g).sum())


def join_sequences(a: np.ndarray, pa_: np.ndarray, b: np.ndarray, pb: np.ndarray, eps2: float, same: bool) -> Iterator[tuple[slice, slice, bool]]:
    """Pairs of stretches of two ordered sequences that may hold a pair within epsilon."""
    stack = [(0, len(a), 0, len(b), same)]
    while stack:
        i, j, k, m, own = stack.pop()
        if not own and gap(pa_[i:j].min(axis=0), pa_[i:j].max(axis=0), pb[k:m].min(axis=0), pb[k:m].max(axis=0)) > eps2:
            continue
        if j - i <= LEAF and m - k <= LEAF:
            yield slice(i, j), slice(k, m), own
        elif own:
            h = (i + j) // 2
            stack += [(i, h, i, h, True), (h, j, h, j, True), (i, h, h, j, False)]
        elif j - i >= m - k:
            h = (i + j) // 2
            stack += [(i, h, k, m, False), (h, j, k, m, False)]
        else:
            h = (k + m) // 2
            stack += [(i, j, k, h, False), (i, j, h, m, False)]


def links(classes: DataFrame, min_cosine: float, sample_rows: int) -> DataFrame:
    """Links of distinct vectors: (rep, n, other).

    n is the number of members of the classes linked with rep within one pair of blocks; other is the
    smallest class that rep reaches there, or null.
    """
    spark = classes.sparkSession
    eps = float(np.sqrt(max(0.0, 2 - 2 * min_cosine))) + 1e-9
    sample = classes.select("v", F.xxhash64("rep", "v").alias("h")).orderBy("h").limit(sample_rows).toPandas()
    basis = spark.sparkContext.broadcast(principal(list(sample["v"])))
    row = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("rep", pa.int64()), ("members", pa.int64()), ("cells", pa.list_(pa.int32())), ("grid", pa.binary()), ("unit", pa.binary())])

    def gridded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r, v in zip(batch.select(["label", "rep", "members"]).to_pylist(), vectors.matrix(batch.column("v")), strict=True):
                x = v.astype(np.float64)
                x = x / np.linalg.norm(x)
                p = np.zeros(DIMS)
                if (b := basis.value.get(len(x))) is not None:
                    p[: len(b)] = b @ x
                out.append(r | {"dim": len(x), "cells": np.floor(p / eps).astype(np.int32), "grid": p.tobytes(), "unit": x.tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=row)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("block", pa.string()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("reps", pa.binary()), ("members", pa.binary()), ("grid", pa.binary()), ("units", pa.binary())])
        for (label, dim), rows in vectors.runs(batches, ["label", "dim"]):
            part: list[dict] = []
            for last, r in _last(rows):
                part.append(r)
                if last or len(part) == BLOCK:
                    grid = np.frombuffer(b"".join(x["grid"] for x in part), np.float64).reshape(len(part), DIMS)
                    made = {"label": label, "dim": dim, "block": vectors.named(part, "rep"), "lo": grid.min(axis=0), "hi": grid.max(axis=0), "grid": grid.tobytes()}
                    made |= {"reps": np.array([x["rep"] for x in part], np.int64).tobytes(), "members": np.array([x["members"] for x in part], np.int64).tobytes(), "units": b"".join(x["unit"] for x in part)}
                    yield pa.RecordBatch.from_pylist([made], schema=schema)
                    part = []

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    grid = common.written(classes.mapInArrow(gridded, "label long, dim int, rep long, members long, cells array<int>, grid binary, unit binary"), "grid")
    order = ["label", "dim", *[f"c{i}" for i in range(DIMS)], "rep"]
    ordered = grid.select("*", *[F.col("cells")[i].alias(f"c{i}") for i in range(DIMS)]).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("cells", *order[2:-1])
    held = common.written(ordered.mapInArrow(blocks, "label long, dim int, block string, lo array<double>, hi array<double>, reps binary, members binary, grid binary, units binary"), "blocks")

    # Boxes meet in a column of the first grid dimension; all dimensions together then decide.
    box = held.select("label", "dim", "block", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo")[0] / eps), F.floor(F.col("hi")[0] / eps))).alias("column"))
    near = held.select("label", "dim", F.col("block").alias("block_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), F.explode(F.sequence(F.floor(F.col("lo")[0] / eps) - 1, F.floor(F.col("hi")[0] / eps) + 1)).alias("column"))
    gaps = F.zip_with(F.arrays_zip("lo", "hi"), F.arrays_zip("lo_b", "hi_b"), lambda a, b: F.greatest(F.lit(0.0), a["lo"] - b["hi_b"], b["lo_b"] - a["hi"]))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    pairs = box.join(near, ["label", "dim", "column"]).where((F.col("block") <= F.col("block_b")) & (apart <= eps * eps)).select("block", "block_b").distinct()
    body = held.select("block", "dim", "reps", "members", "grid", "units")
    both = pairs.join(body, "block").join(body.select(*[F.col(c).alias(f"{c}_b") for c in body.columns]), "block_b")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield _linked(r, eps * eps, min_cosine)

    spread = both.repartition(parts, "block", "block_b")
    return spread.mapInArrow(compared, "rep long, n long, other long")


def _linked(r: dict, eps2: float, min_cosine: float) -> pa.RecordBatch:
    """Links between the rows of a pair of blocks."""
    side = []
    for s in ("", "_b"):
        reps = np.frombuffer(r["reps" + s], np.int64)
        side.append((reps, np.frombuffer(r["members" + s], np.int64), np.frombuffer(r["grid" + s], np.float64).reshape(len(reps), DIMS), np.frombuffer(r["units" + s], np.float64).reshape(len(reps), r["dim"])))
    (ra, ma, ga, ua), (rb, mb, gb, ub) = side
    same = r["block"] == r["block_b"]
    na, nb = np.zeros(len(ra), np.int64), np.zeros(len(rb), np.int64)
    u, v = [], []
    for i, j, own in join_sequences(ra, ga, rb, gb, eps2, same):
        x, y = np.nonzero(ua[i] @ ub[j].T >= min_cosine)
        if own:
            x, y = x[x < y], y[x < y]
        x, y = x + i.start, y + j.start
        np.add.at(na, x, mb[y])
        np.add.at(nb, y, ma[x])
        u.append(ra[x])
        v.append(rb[y])
    node, least = local_stars(np.concatenate(u) if u else ra[:0], np.concatenate(v) if v else rb[:0])
    reps, n = (ra, na + nb) if same else (np.concatenate([ra, rb]), np.concatenate([na, nb]))
    at = n > 0
    return pa.RecordBatch.from_pydict(
        {"rep": np.concatenate([reps[at], node]), "n": np.concatenate([n[at], np.zeros(len(node), np.int64)]), "other": pa.array([None] * int(at.sum()) + least.tolist(), pa.int64())},
        schema=pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("other", pa.int64())]),
    )


def near_duplicates(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", min_cosine: float = 0.93, sample_rows: int = 4096) -> DataFrame:
    """Classes of vectors linked at `min_cosine` or more within a label.

    Returns vec_id, n_links (other rows linked directly), component_id, kept.
    """
    common.prepare(table.sparkSession)
    own = table.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("key", pa.binary()), ("v", pa.list_(pa.float64()))])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = vectors.matrix(batch.column("v"))
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "key": [vectors.fingerprint(x) for x in rows], "v": [x.astype(np.float64) for x in rows]}, schema=schema)

    part = F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    good = common.written(vectors.usable(own.where(part), "v").mapInArrow(keyed, "vec_id long, label long, key binary, v array<double>"), "vectors")
    classes = common.written(good.groupBy("label", "key").agg(F.min(F.struct("vec_id", "v")).alias("s"), F.count("*").alias("members")).select("label", "key", F.col("s.vec_id").alias("rep"), "members", F.col("s.v").alias("v")), "classes")
    found = common.written(links(classes, min_cosine, sample_rows), "links")
    counted = found.groupBy("rep").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    known = common.written(
        classes.select("label", "key", "rep", "members").join(counted, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "key", (F.col("members") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")),
        "known",
    )
    linked = good.select("vec_id", "label", "key").join(known, ["label", "key"]).select("vec_id", "n_links", "component_id")
    alone = own.where(~F.coalesce(part & vectors.sound("v"), F.lit(False)))
    rest = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))

