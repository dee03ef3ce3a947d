"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut in two halves and each half is quantised with its own codebook; a row's cell is the
pair of its codes. A query ranks the codes of each half by distance and walks the pairs of codes in
order of the summed distance, with a heap, until the visited cells hold the share of the index that
it is to rerank; those entries are reranked by their exact inner product in double precision.

Bounds: codebooks are fitted on at most `sample_rows` rows (those of smallest hash); every row is
indexed. What is broadcast, the codebooks and the cell counts, is bounded by `codes`.

The share is a parameter because no index can do better than the data allow: on vectors without
structure a recall of 0.9 takes about half of the index.

Shapes of input with a defined result: null, zero or non-finite vectors take no part, as query or as
candidate; vectors of another length than a query's are no candidates of it; with fewer candidates
than asked for, all are returned; ties go to the smaller id; an id that is repeated is excluded for
its own query on every row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrow.llm import common, vectors

#: Rows of an index block, queries that are scored together, and how many times these a task holds.
BLOCK, QUERIES, HELD = 2048, 4096, 4
#: Lanes into which the index is dealt; each keeps a running best list for each query.
LANES = 16


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Centroids of the rows of x by Lloyd's rounds; an empty cluster keeps its centroid."""
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The centroid nearest to each row."""
    return ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)


def probes(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> np.ndarray:
    """Cells in order of summed distance until they hold `wanted` entries.

    first and second are a query's distances to the codes of either half; counts has the entries of
    each pair of codes.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    fa, sb = first[a].tolist(), second[b].tolist()
    a, b = a.tolist(), b.tolist()
    held = counts.tolist()
    heap, out, total = [(fa[0] + sb[0], 0, 0)], [], 0
    while heap and total < wanted:
        _, i, j = heapq.heappop(heap)
        n = held[a[i]][b[j]]
        if n:
            out.append(a[i] * len(b) + b[j])
            total += n
        # (i, j) opens (i, j + 1); the first of a row also opens the next row: each pair enters once.
        if j + 1 < len(b):
            heapq.heappush(heap, (fa[i] + sb[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (fa[i + 1] + sb[0], i + 1, 0))
    return np.array(out, np.int64)


def fit(index: DataFrame, vector: str, codes: int, sample_rows: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Codebooks of both halves, by length of vector."""
    rows = index.select(vector, F.xxhash64("row_id", vector).alias("h")).orderBy("h").limit(sample_rows).toPandas()
    by: dict[int, list[np.ndarray]] = {}
    for v in rows[vector]:
        by.setdefault(len(v), []).append(np.asarray(v, np.float64))
    return {d: (kmeans(x[:, : (d + 1) // 2], codes), kmeans(x[:, (d + 1) // 2 :], codes) if d > 1 else np.zeros((1, 0))) for d, x in ((d, np.stack(v)) for d, v in by.items())}


def cell_of(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The cells of the rows of x."""
    h = (x.shape[1] + 1) // 2
    return nearest(x[:, :h], books[0]) * len(books[1]) + nearest(x[:, h:], books[1])


def search(table: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, codes: int = 32, share: float = 0.7, sample_rows: int = 20_000) -> DataFrame:
    """The k nearest rows of `table` to each row of `queries` by inner product.

    Returns query_id, rank (from 1), vec_id, score.
    """
    spark = table.sparkSession
    common.prepare(spark)
    pick = lambda df: vectors.usable(df.select(F.col(vec_id).alias("row_id"), F.col(vector).alias("v")).where(F.col("row_id").isNotNull()), "v")
    index = pick(table)
    books = spark.sparkContext.broadcast(fit(index, "v", codes, sample_rows))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("row_id").to_pylist(), vectors.matrix(batch.column("v"))
            by: dict[int, list[int]] = {}
            for i, v in enumerate(rows):
                by.setdefault(len(v), []).append(i)
            for d, at in by.items():
                x = np.stack([rows[i] for i in at]).astype(np.float64)
                # A length that the sample lacks has one cell for all its rows.
                cells = cell_of(x, books.value[d]) if d in books.value else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_pydict({"row_id": [ids[i] for i in at], "dim": [d] * len(at), "cell": cells, "bytes": [rows[i].astype(np.float64).tobytes() for i in at]}, schema=pa.schema([("row_id", pa.int64()), ("dim", pa.int32()), ("cell", pa.int64()), ("bytes", pa.binary())]))

    entries = common.written(index.mapInArrow(coded, "row_id long, dim int, cell long, bytes binary"), "entries")
    counts: dict[int, np.ndarray] = {}
    for r in entries.groupBy("dim", "cell").count().collect():  # at most codes * codes rows for each length
        shape = tuple(map(len, books.value[r["dim"]])) if r["dim"] in books.value else (1, 1)
        counts.setdefault(r["dim"], np.zeros(shape, np.int64))[divmod(r["cell"], shape[1])] = r["count"]
    cells = spark.sparkContext.broadcast(counts)

    # Entries in order of their cells, in blocks; rows of one cell may fill many blocks.
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = entries.repartitionByRange(parts, "dim", "cell", "row_id").sortWithinPartitions("dim", "cell", "row_id").mapInArrow(_blocks(BLOCK), "dim int, block string, rows binary, cells binary, data binary")
    asked = common.written(pick(queries).select("row_id", F.size("v").alias("dim"), F.transform("v", lambda x: x.cast("double")).alias("v")), "asked")
    # Queries are dealt into groups that a task can hold, and each group goes to every lane; blocks are dealt into lanes,
    # and each goes to every group: the stated query set meets all rows once, without a join on a few keys.
    n = max(1, -(-asked.count() // (HELD * QUERIES)))
    lane, group = F.pmod(F.xxhash64("block"), F.lit(LANES)).cast("int"), F.pmod(F.xxhash64("row_id"), F.lit(n)).cast("int")
    empty = F.lit(None)
    held = asked.select("dim", F.explode(F.expr(f"sequence(0, {LANES - 1})")).alias("lane"), group.alias("set"), F.lit(0).alias("kind"), "row_id", "v", empty.cast("binary").alias("rows"), empty.cast("binary").alias("cells"), empty.cast("binary").alias("entries"))
    met = blocks.select("dim", lane.alias("lane"), F.explode(F.expr(f"sequence(0, {n - 1})")).alias("set"), F.lit(1).alias("kind"), empty.cast("long").alias("row_id"), empty.cast("array<double>").alias("v"), "rows", "cells", F.col("data").alias("entries"))

    def reranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, _, _), rows in vectors.runs(batches, ["dim", "lane", "set"]):
            own: list[dict] = []
            best: list[_Best] | None = None
            for r in rows:
                if r["kind"] == 0:
                    own.append(r)
                    continue
                if best is None:  # all queries of the group come before its blocks
                    best = [_Best(own[at : at + QUERIES], dim, books.value.get(dim), cells.value[dim], share, k) for at in range(0, len(own), QUERIES)]
                for b in best:
                    b.add(r)
            yield from (out for b in best or [] if (out := b.found()) is not None)

    part = held.unionByName(met).repartition(parts, "dim", "lane", "set").sortWithinPartitions("dim", "lane", "set", "kind", "row_id").mapInArrow(reranked, "query_id long, vec_id long, score double")
    # Best of the lanes: at most LANES * k rows for each query.
    order = "row_number() over (partition by query_id order by score desc, vec_id) as rank"
    return part.selectExpr("query_id", order, "vec_id", "score").where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Best:
    """Running best list of some queries over the index blocks of a lane."""

    def __init__(self, rows: list[dict], dim: int, books, counts: np.ndarray, share: float, k: int) -> None:  # noqa: ANN001
        self.k = k
        self.ids = np.array([r["row_id"] for r in rows], np.int64)
        self.q = np.array([r["v"] for r in rows], np.float64).reshape(len(rows), dim)
        wanted = max(int(np.ceil(share * counts.sum())), k + 1)
        self.visit = np.zeros((len(self.ids), counts.size), bool)
        if books is None:
            self.visit[:] = True
        else:
            h = (dim + 1) // 2
            first, second = -self.q[:, :h] @ books[0].T, -self.q[:, h:] @ books[1].T
            for i in range(len(self.ids)):
                self.visit[i, probes(first[i], second[i], counts, wanted)] = True
        self.score = np.full((len(self.ids), k), -np.inf)
        self.near = np.full((len(self.ids), k), np.iinfo(np.int64).max)

    def add(self, row: dict) -> None:
        rows, cells = np.frombuffer(row["rows"], np.int64), np.frombuffer(row["cells"], np.int64)
        x = np.frombuffer(row["entries"], np.float64).reshape(len(rows), -1)
        first = np.flatnonzero(np.concatenate([[True], np.diff(cells) != 0]))
        for at in range(0, len(self.ids), 256):
            q, visit = self.q[at : at + 256], self.visit[at : at + 256]
            s = np.full((len(q), len(rows)), -np.inf)
            # Entries of a cell are one stretch of the block; only the queries that visit it meet them.
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(rows)], strict=True):
                own = np.flatnonzero(visit[:, cells[a]])
                if len(own) == len(q):
                    s[:, a:b] = q @ x[a:b].T
                elif len(own):
                    s[own, a:b] = q[own] @ x[a:b].T
            s[self.ids[at : at + 256, None] == rows[None, :]] = -np.inf
            # The product only preselects; what may be among the best is scored again, term by term in order.
            floor = self.score[at : at + 256, -1] - 1e-9
            for i in np.flatnonzero((s > floor[:, None]).any(axis=1)):
                c = np.flatnonzero(s[i] > floor[i])
                if len(c) > self.k:
                    c = c[s[i][c] >= np.partition(s[i][c], len(c) - self.k)[len(c) - self.k] - 1e-9]
                exact = (q[i] * x[c]).sum(axis=1)
                score, near = np.append(self.score[at + i], exact), np.append(self.near[at + i], rows[c])
                o = vectors.top(score, near, self.k)
                self.score[at + i], self.near[at + i] = score[o], near[o]

    def found(self) -> pa.RecordBatch | None:
        i, j = np.nonzero(np.isfinite(self.score))
        if not len(i):
            return None
        return pa.RecordBatch.from_pydict({"query_id": self.ids[i], "vec_id": self.near[i, j], "score": self.score[i, j]})


def _blocks(size: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("dim", pa.int32()), ("block", pa.string()), ("rows", pa.binary()), ("cells", pa.binary()), ("data", pa.binary())])
        for (dim,), rows in vectors.runs(batches, ["dim"]):
            part: list[dict] = []
            for last, r in _last(rows):
                part.append(r)
                if last or len(part) == size:
                    made = {"dim": dim, "block": vectors.named(part, "row_id"), "rows": np.array([x["row_id"] for x in part], np.int64).tobytes(), "cells": np.array([x["cell"] for x in part], np.int64).tobytes(), "data": b"".join(x["bytes"] for x in part)}
                    yield pa.RecordBatch.from_pylist([made], schema=schema)
                    part = []

    return run


def _last(rows: Iterator[dict]) -> Iterator[tuple[bool, dict]]:
    """Each row, with whether it is the last."""
    held = None
    for r in rows:
        if held is not None:
            yield False, held
        held = r
    if held is not None:
        yield True, held
