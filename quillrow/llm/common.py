"""What the corpus operators share: table access, scratch storage and Arrow plumbing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrow.session import ship

#: Rows of one Arrow batch handed to Python. Documents can be long, so batches stay short.
BATCH_ROWS = 1000
#: The same for rows of a few numbers.
LONG_BATCH_ROWS = 50_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data set at `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Ships the package and bounds the Arrow batches of Python stages, unless the session sets a bound."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


@contextmanager
def longer_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of narrow rows meanwhile: LONG_BATCH_ROWS, unless the session sets a bound of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    ours = spark.conf.get(key) == str(BATCH_ROWS)
    if ours:
        spark.conf.set(key, str(LONG_BATCH_ROWS))
    try:
        yield
    finally:
        if ours:
            spark.conf.set(key, str(BATCH_ROWS))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`; a temporary one only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="quillrow-")
        if not held.isDefined():
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is removed when the driver ends."""
    path = f"{scratch_root(spark)}/quillrow/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path, on whatever store it is."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone already; scratch files are harmless
        pass


#: Whether the shuffles of a query are deleted when it ends, not only when the driver collects its garbage.
_CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a written table: lineage ends here and lost executors cost no recomputation of it.

    What was shuffled to make it is deleted at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANS, None)
    spark.conf.set(_CLEANS, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANS, before) if before else spark.conf.unset(_CLEANS)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.scratch)


def map_rows(df: DataFrame, rows: Callable[[list[dict]], Iterator[dict] | list[dict]], schema: pa.Schema, ddl: str) -> DataFrame:
    """Maps batches of rows (as dicts) to rows of `schema` through Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(rows(batch.to_pylist()))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return df.mapInArrow(run, ddl)


#: How each operator's memory of words or models in a worker process is emptied, and the operator that the process serves.
_emptied: dict[str, Callable[[], object]] = {}
_served = [""]


def remembers(owner: str, empty: Callable[[], object]) -> None:
    """Registers what empties an operator's memory in a worker process."""
    _emptied[owner] = empty


def serve(owner: str) -> None:
    """Empties the memories of all other operators: Spark hands a worker process from stage to stage."""
    if _served[0] != owner:
        _served[0] = owner
        for name, empty in _emptied.items():
            if name != owner:
                empty()
        gc.collect()
        release()


def release() -> None:
    """Gives freed memory back to the machine, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def served(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapper of batches that holds no operator's memory but its own, and none that is free when it ends."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve(owner)
        yield from run(batches)
        release()

    return mapped


def smallest(df: DataFrame, group: str, key: str, most: int) -> dict:
    """For each value of `group` the greatest of its `most` smallest distinct keys; keys are 64-bit hashes.

    Keys are cut before they are ranked, at a height that leaves a few times `most` of them, and again
    higher where that was too low: no task ranks a whole group. Groups are few, as classes are.
    """
    todo = {r[group]: r["n"] for r in df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).collect()}
    bounds, wide = {}, 2.0
    while todo:
        cut = {g: int(min(1.0, wide * most / n) * (1 << 64)) - (1 << 63) - 1 for g, n in todo.items()}
        low = reduce(or_, [(F.col(group) == F.lit(g)) & (F.col(key) <= F.lit(c)) for g, c in cut.items()])
        ranked = df.where(low).select(group, key).distinct().selectExpr(group, key, f"row_number() over (partition by {group} order by {key}) as rank").where(F.col("rank") <= most)
        for r in ranked.groupBy(group).agg(F.max(key).alias("k"), F.count("*").alias("n")).collect():
            if r["n"] == most or cut[r[group]] == (1 << 63) - 1:
                bounds[r[group]] = r["k"]
                del todo[r[group]]
        wide *= 8
    return bounds


def boxed(df: DataFrame, but: tuple[str, ...] = ()) -> DataFrame:
    """All columns of `df`, except some, as one struct `row`: their names can't clash with an operator's own."""
    names = [c for c in df.columns if c not in but]
    return df.select(F.struct(*[F.col(f"`{c}`") for c in names] or [F.lit(None).alias("none")]).alias("row"), *but)


@contextmanager
def uncollected() -> Iterator[None]:
    """No search for reference cycles meanwhile: large tables of plain objects have none, and each search reads them all."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def keyed(df: DataFrame, name: str = "row_key") -> DataFrame:
    """Adds a key that tells even equal rows apart. Write the result before reading it twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


#: Rows of a table of a number or two a row that is broadcast; a longer one is joined by a shuffle.
MOST_BROADCAST = 400_000


def among(rows: DataFrame, keys: DataFrame, name: str = "row_key") -> DataFrame:
    """The rows whose key `name`, made by keyed(), is in the column of this name of `keys`, where it may repeat.

    Keys of a task follow each other, so one number tells of 64 of them which are there: a table of these is
    short enough to broadcast for 25 million rows, and rows with their texts aren't shuffled.
    """
    word = f"shiftright(`{name}`, 6)"
    marks = written(keys.selectExpr(f"{word} as word", f"shiftleft(1L, cast(`{name}` & 63 as int)) as mark").groupBy("word").agg(F.bit_or("mark").alias("marks")), "marks")
    few = marks.selectExpr("word as _word", "marks as _marks")
    found = rows.join(F.broadcast(few) if marks.count() <= MOST_BROADCAST else few, F.expr(f"{word} = _word"))
    return found.where(f"getbit(_marks, cast(`{name}` & 63 as int)) = 1").select(*[f"`{c}`" for c in rows.columns])
