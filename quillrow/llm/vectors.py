"""What the operators on embedding tables share: validity, equality of vectors, blocks of rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(vector: str = "embedding") -> Column:
    """True for a vector that is there, not zero, and free of null, NaN and infinite components."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(~bad, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows with a sound vector."""
    return df.where(sound(vector))


def matrix(column: pa.Array) -> list[np.ndarray]:
    """The vectors of a list column, as they are stored."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum([0, *(len(x) for x in column)]) if column.null_count else column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def fingerprint(v: np.ndarray) -> bytes:
    """The same bytes for equal vectors, whatever the sign of their zeros."""
    return hashlib.blake2b((np.asarray(v, np.float64) + 0.0).tobytes(), digest_size=16).digest()


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, best first, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows (as dicts) of sorted batches, grouped by `keys`; a group is streamed, never held."""
    from itertools import groupby

    rows = (r for b in batches for r in b.to_pylist())
    yield from groupby(rows, key=lambda r: tuple(r[k] for k in keys))


def named(part: list[dict], key: str) -> str:
    """A name of a block by its rows, the same whenever a task is run again."""
    return hashlib.blake2b(np.array([x[key] for x in part], np.int64).tobytes(), digest_size=12).hexdigest()
