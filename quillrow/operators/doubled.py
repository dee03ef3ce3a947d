"""Text that stands twice: runs of words said again at once, and words with every character doubled."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrow.functions import text as T
from quillrow.session import ship

#: Words of the longest run that is looked for.
MOST_WORDS = 64


def words(text: Column) -> Column:
    """Words without Markdown marks."""
    return F.filter(F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, r"[*_`|#]", "")), lambda w: w != "")


def at_once(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1) -> DataFrame:
    """Runs of `size` words that are said again at once: key, pos (from 0), run.

    Of a run of one word, only substantial ones count.
    """
    own = docs.where(F.col(text).isNotNull()).select(key, words(F.col(text)).alias("w"))
    each = own.select(key, "w", F.explode(F.expr(f"sequence(0, greatest(size(w) - {2 * size}, 0))")).alias("pos")).where(F.size("w") >= 2 * size)
    run = each.select(key, "pos", F.expr(f"slice(w, pos + 1, {size})").alias("a"), F.expr(f"slice(w, pos + 1 + {size}, {size})").alias("b")).where(F.col("a") == F.col("b"))
    out = run.select(key, F.col("pos").cast("long").alias("pos"), F.array_join("a", " ").alias("run"))
    return out.where(T.substantial(F.col("run"))) if size == 1 else out


def glyphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words of two pairs or more with every character doubled: key, pos, word, painted_once."""
    each = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(words(F.col(text))).alias("pos", "word"))
    twice = each.where(F.col("word").rlike(r"^(?:(.)\1){2,}$") & ~F.col("word").rlike(r"^(.)\1*$"))
    return twice.select(key, F.col("pos").cast("long").alias("pos"), "word", F.regexp_replace("word", r"(.)\1", "$1").alias("painted_once"))


def runs(own: list[str]) -> list[tuple[int, str]]:
    """(place, run) of runs of up to MOST_WORDS words said again at once, longest first at each place, none reported twice."""
    places: dict[str, list[int]] = {}
    for i, w in enumerate(own):
        places.setdefault(w, []).append(i)
    out, at = [], 0
    while at < len(own):
        same = places[own[at]]
        # A run can only begin again where its first word stands again.
        far = bisect_right(same, min(at + MOST_WORDS, (len(own) + at) // 2))
        for again in reversed(same[bisect_right(same, at) : far]):
            n = again - at
            run = own[at:again]
            if run == own[again : again + n] and (n > 1 or len(run[0]) >= 4 or re.search("[0-9]", run[0])):
                out.append((at, " ".join(run)))
                at += 2 * n
                break
        else:
            at += 1
    return out


def greedy(text: str | None) -> list[str]:
    """The runs of a text."""
    return [r for _, r in runs([w for w in (re.sub(r"[*_`|#]", "", x) for x in (text or "").split()) if w])]


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of 1 to MOST_WORDS words that are said again at once: key, pos (from 0), run."""
    ship(docs.sparkSession)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *r) for i, w in enumerate(batch.column("w")) for r in runs(w.as_py())]
            at, pos, run = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), pa.array(pos, pa.int64()), pa.array(run, pa.string())], names=[key, "pos", "run"])

    own = docs.where(F.col(text).isNotNull()).select(key, words(F.col(text)).alias("w"))
    return own.mapInArrow(search, f"`{key}` {docs.schema[key].dataType.simpleString()}, pos long, run string")
