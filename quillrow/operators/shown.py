"""Whether texts are shown: containment of given texts in what a document displays."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrow.functions import text as T


def shown(docs: DataFrame, texts: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", pattern: str = "text") -> DataFrame:
    """(key, item) where the bare text of the document holds the bare pattern.

    All patterns are searched at once with an automaton; `texts` is a list of a size that fits a task
    and is collected once. Empty patterns are shown nowhere.
    """
    from quillrow.session import ship

    spark = docs.sparkSession
    ship(spark)
    listed = [(r[0], r[1]) for r in texts.select(item, T.bare(F.col(pattern)).alias("p")).collect() if r[1]]
    held = spark.sparkContext.broadcast(listed)
    kinds = {c: d.schema[c].dataType.simpleString() for c, d in ((key, docs), (item, texts))}

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        by: dict[str, list] = {}
        for i, p in held.value:
            by.setdefault(p, []).append(i)
        for p, items in by.items():
            automaton.add_word(p, items)
        automaton.make_automaton()
        for batch in batches:
            out = []
            for k, b in zip(batch[key], batch["bare"], strict=True):
                found = {i for _, items in automaton.iter(b) for i in items} if by else ()
                out += [(k, i) for i in found]
            yield pd.DataFrame(out, columns=[key, item])

    bare = docs.where(F.col(text).isNotNull()).select(key, T.bare(F.col(text)).alias("bare"))
    return bare.mapInPandas(search, f"`{key}` {kinds[key]}, `{item}` {kinds[item]}")


def unshown(asked: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", value: str = "value") -> DataFrame:
    """Rows of (key, value) whose document doesn't show the value."""
    bare = docs.select(key, T.bare(F.coalesce(text, F.lit(""))).alias("bare"))
    return asked.join(bare, key, "left").where(~F.contains(F.coalesce("bare", F.lit("")), T.bare(F.col(value)))).drop("bare")


def edge_safe(text_bare: Column, value_bare: Column) -> Column:
    """Containment where a digit at the value's edge doesn't run on into digits."""
    quoted = F.concat(F.lit(r"\Q"), value_bare, F.lit(r"\E"))
    left = F.when(value_bare.rlike("^[0-9]"), F.lit("(?<![0-9])")).otherwise("")
    right = F.when(value_bare.rlike("[0-9]$"), F.lit("(?![0-9])")).otherwise("")
    return F.regexp_like(text_bare, F.concat(left, quoted, right))
