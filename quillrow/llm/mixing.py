"""Mixing sources to target weights with soft membership.

A classifier learned from a table of labelled documents gives every document a posterior over
domains. Document rates are then fitted by projected-gradient least squares so that the expected
tokens of each domain, the sum of rate times tokens times posterior, match the targets. Rates are
nonnegative and start at one.

With residual R = expected - target, M the tokens-weighted second moment of the posteriors and p a
document's posterior, the objective is half of R' M^-1 R, and in the metric of the documents' tokens
the step is rate <- max(0, rate - p' M^-1 R), whose Lipschitz constant is one. A longer step takes M
over the documents of positive rate alone; where it doesn't lower the objective enough, the step of
length one is taken instead. A rate after some steps depends only on p and on the steps' vectors, so
no rates are stored between steps; each step is one pass over a narrow table that sums a few numbers
per domain.

Bounds: the classifier is fitted on at most `max_rows` labelled documents of each domain (smallest
hash of doc_id). Posteriors, token counts and the fit cover every document.

Shapes of input with a defined result: a null or empty text has no tokens, a uniform posterior and
rate one; without labelled documents posteriors are uniform; a domain that no document can reach
leaves its target unmet; repeated rows are documents of their own with equal rates; labels of absent
documents are ignored; a document with several labels counts once for each; an empty table gives an
empty result; texts are read whole; other columns are carried only where the stage asks for them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrow.llm import common, language

_MARKS = ".,;:!?*#&%$|\"'()[]{}"
_EDGE = re.compile(r"^\W+|\W+$")
#: Labelled documents that have to hold a word before it counts.
LEAST_DOCUMENTS = 3

#: Words whose buckets a worker remembers.
MOST_WORDS = 150_000
_buckets: dict[str, tuple[int, ...]] = {}
common.remembers("mixing", _buckets.clear)


def _hashed(part: str) -> int:
    return xxhash.xxh32_intdigest(part.encode("utf-8", "surrogatepass")) >> (32 - language.BITS)


def buckets(word: str) -> tuple[int, ...]:
    """Buckets of a word without the marks around it, and of the marks behind it."""
    known = _buckets.get(word)
    if known is None:
        if len(_buckets) >= MOST_WORDS:
            _buckets.clear()
        core = _EDGE.sub("", word)
        tail = word[len(word.rstrip(_MARKS)) :]
        known = _buckets[word] = tuple(_hashed(x) for x in (core, "\0" + tail) if x and x != "\0")
    return known


def features(text: str | None) -> tuple[np.ndarray, int]:
    """Buckets of a text's distinct words, and the number of all words."""
    words = (text or "").lower().split()
    return np.array(sorted({b for w in set(words) for b in buckets(w)}), np.int64), len(words)


@dataclass
class Domains:
    """A softmax classifier over words."""

    names: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def posterior(self, at: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.full(len(self.names), 1 / len(self.names))
        z = (self.weights[at].sum(axis=0, dtype=np.float64) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()


def train(docs: DataFrame, labels: DataFrame, names: list[str], max_rows: int = 1500, holdout: float = 0.2) -> Domains:
    """Learns domains from `labels` (doc_id, domain)."""
    asked = labels.where(F.col("domain").isin(*names)).select("doc_id", "domain", F.xxhash64("doc_id").alias("h")).distinct()
    bounds = common.smallest(asked, "domain", "h", max_rows)
    low = reduce(or_, [(F.col("domain") == n) & (F.col("h") <= h) for n, h in bounds.items()], F.lit(False))
    # At most max_rows labels of each domain, so this side is short whatever the corpus.
    rows = docs.select("doc_id", "text").join(F.broadcast(asked.where(low)), "doc_id").dropDuplicates(["doc_id", "domain"])
    found = rows.select("domain", "h", "text").mapInArrow(common.served(_sample, "mixing"), "domain string, h long, at array<int>").toPandas().sort_values(["domain", "h"], kind="stable")
    seen = [n for n in names if (found["domain"] == n).any()]
    if not seen:
        return Domains(names, np.zeros((language.SIZE, len(names)), np.float32), np.zeros(len(names)), 1.0)
    spread = np.zeros(language.SIZE, np.int64)
    for a in found["at"]:
        spread[np.asarray(a)] += 1
    made = [(k, np.ones(len(k))) for k in (np.asarray(a)[spread[np.asarray(a)] >= LEAST_DOCUMENTS] for a in found["at"])]
    y = found["domain"].map({n: i for i, n in enumerate(names)}).to_numpy()
    held = (found["h"].to_numpy() % 1000) / 1000 < holdout
    if held.all() or not held.any():
        held = np.zeros(len(y), bool)
    w, b = language.fit_ftrl([r for r, h in zip(made, held, strict=True) if not h], y[~held], len(names), alpha=0.1, l1=0.3, l2=0.1, epochs=4)
    logits = np.array([x @ w[at] + b for (at, x), h in zip(made, held, strict=True) if h]).reshape(-1, len(names))
    return Domains(names, w.astype(np.float32), b, max(0.2, language.fit_temperature(logits, y[held])))


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("domain", pa.string()), ("h", pa.int64()), ("at", pa.list_(pa.int32()))])
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"domain": batch.column("domain"), "h": batch.column("h"), "at": [features(t)[0].astype(np.int32) for t in batch.column("text").to_pylist()]}, schema=schema)


def memberships(docs: DataFrame, model: Domains) -> DataFrame:
    """The columns of `docs` but its text, with n_tokens and posterior."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # its size is set by the buckets and domains
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, p = [], []
            for text in batch.column("text").to_pylist():
                at, words = features(text)
                n.append(words)
                p.append(held.value.posterior(at))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(n, pa.int64()), pa.array(p, pa.list_(pa.float64()))], names=[*others, "n_tokens", "posterior"])

    schema = T.StructType([*[docs.schema[c] for c in others], T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))])
    return docs.select(*others, "text").mapInArrow(common.served(run, "mixing"), schema)


def _matrix(column: pa.Array, domains: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, domains)


def stepped(p: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Rates after the steps, from one."""
    r = np.ones(len(p))
    for s in steps:
        r = np.maximum(0.0, r - p @ s)
    return r


def totals(members: DataFrame, steps: np.ndarray, domains: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens of each domain at the rates after the steps, and the second moment of the posteriors of positive rate."""
    size = domains * (domains + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size)
        for batch in batches:
            p, n = _matrix(batch.column("posterior"), domains), batch.column("n_tokens").to_numpy().astype(float)
            r = stepped(p, steps)
            own[:domains] += (n * r) @ p
            own[domains:] += (((n * (r > 0))[:, None] * p).T @ p).reshape(-1)
        yield pa.RecordBatch.from_pydict({"k": np.arange(size), "x": own}, schema=pa.schema([("k", pa.int64()), ("x", pa.float64())]))

    out = np.zeros(size)
    for r in members.select("posterior", "n_tokens").mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():  # domains * (domains + 1) rows
        out[r["k"]] = r["x"]
    return out[:domains], out[domains:].reshape(domains, domains)


def fit_rates(members: DataFrame, domains: int, targets: np.ndarray | None = None, multiples: np.ndarray | None = None, tolerance: float = 1e-6, most_steps: int = 60) -> np.ndarray:
    """The steps of the projected gradient; targets are tokens, or multiples of what the domains hold."""
    steps = np.zeros((0, domains))
    have, moment = totals(members, steps, domains)
    goal = have * multiples if targets is None else np.asarray(targets, float)
    inverse = active = np.linalg.pinv(moment)
    cost = lambda x: float((x - goal) @ inverse @ (x - goal))
    for _ in range(most_steps):
        if np.abs(have - goal).max() <= tolerance * max(1.0, goal.sum()):
            break
        longer = np.vstack([steps, active @ (have - goal)])
        now, moment = totals(members, longer, domains)
        if cost(now) > 0.5 * cost(have):
            longer = np.vstack([steps, inverse @ (have - goal)])
            now, moment = totals(members, longer, domains)
        stuck = cost(now) > (1 - 1e-4) * cost(have)
        steps, have, active = longer, now, np.linalg.pinv(moment)
        if stuck:
            break  # the targets can't be met any closer
    return steps


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, multiples: dict[str, float] | None = None, budget: float = 1.0, max_rows: int = 1500, seed: int = 17) -> DataFrame:
    """Rates and copies of every document.

    `weights` are shares of the output's tokens, `budget` the output's tokens as a multiple of the
    input's; or `multiples` says by how much each domain's tokens change. Returns the columns of
    `docs` but its text, with (in place of columns of these names) row_key, n_tokens, posterior (in order of the domains), rate and
    n_copies, a whole number whose mean over seeds is the rate.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    names = list(weights or multiples or {})
    model = train(docs, labels, names, max_rows)
    members = common.written(memberships(common.keyed(docs), model), "members")
    targets = None
    if weights:
        share = np.array([weights[n] for n in names], float)
        tokens = members.agg(F.sum("n_tokens")).first()[0] or 0
        targets = budget * tokens * share / share.sum()
    steps = fit_rates(members, len(names), targets, None if weights else np.array([multiples[n] for n in names], float))

    @F.pandas_udf("double")
    def rate(p):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(stepped(np.stack(p.to_numpy()), steps)) if len(p) else pd.Series([], dtype=float)

    unit = F.pmod(F.xxhash64(F.col("doc_id"), F.col("row_key"), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # As if not deterministic: else Spark runs it for a filter of copies and again for the copies, each in a worker process
    # of its own for every task, and the workers that are too many live on through the stages that follow.
    out = members.withColumn("rate", F.when(F.col("n_tokens") == 0, 1.0).otherwise(rate.asNondeterministic()("posterior")))
    return out.withColumn("n_copies", F.floor(F.col("rate") + unit).cast("long"))


def quality_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table of quality and toxic marks: toxic, low or high."""
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "high")
    return labels.select("doc_id", kind.alias("domain")).where(F.col("domain").isNotNull() & F.col("doc_id").isNotNull())


def mixed(docs: DataFrame, labels: DataFrame, multiples: dict[str, float]) -> DataFrame:
    """`docs`, each row as often as its copies say."""
    # Rows go with their posteriors: the numbers of copies needn't be joined with the texts.
    rates = mix(common.boxed(docs).select("row", "row.doc_id", "row.text"), labels, multiples=multiples)
    return rates.where(F.col("n_copies") > 0).withColumn("copy", F.explode(F.expr("sequence(1L, n_copies)"))).select("row.*")
