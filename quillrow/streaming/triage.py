"""Streaming variants: files classified as they come, and windows over events.

The transformations are those of the batch engine; only sources and sinks differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillrow.sources import files

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """A stream of the files that appear below a folder."""
    reader = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def triaged(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """path, kind, digest and error of each file, contents that came within `delay` before left out."""
    fits = F.col("length") <= files.MOST_BYTES
    kind = F.when(fits, files.kind_of(F.col("content"), F.col("path")))
    out = stream.withColumns({"digest": F.sha2("content", 256), "kind": kind, "error": F.when(~fits, "resource_limit")})
    return out.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["digest"]).select("path", "modificationTime", "kind", "digest", "error")


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs `write` on each batch of what is there now; a batch that is run again has the same number."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, size: str = "1 day", late: str = "2 days", time: str = "ts") -> DataFrame:
    """Count and sum of each type of event in windows of time."""
    own = events.withWatermark(time, late) if events.isStreaming else events
    return own.groupBy(F.window(time, size), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days", time: str = "ts") -> DataFrame:
    """Sessions of users: start, end and number of events."""
    own = events.withWatermark(time, late) if events.isStreaming else events
    return own.groupBy(F.session_window(time, gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
