"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Training is follow-the-regularised-leader (proximal, per coordinate) with an elastic-net penalty,
then a temperature is fitted on held-out rows so that scores are calibrated.

Features are character n-grams of lengths 1 to 3 of the lower-cased text, hashed into `2**BITS`
buckets; a feature's value is its share of the text's n-grams times the inverse document frequency.

Bounds: the fit uses at most `max_rows` labelled documents of each language, those with the smallest
hash of doc_id. Document frequencies cover every labelled document offered for learning, and
prediction reads every whole text.

Shapes of input with a defined result: a null text, or one without a letter, is `und` with score 0;
without labelled rows every text is `und`; one language only is always predicted, with score 1;
texts of any length are read whole; repeated rows are predicted alike; an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrow.llm import common

BITS = 16
SIZE = 1 << BITS
UND = "und"
#: Scale of the feature values, so that steps of the learner are of useful size.
SCALE = 30.0
#: Characters worked on at once.
CHUNK = 1 << 16
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, in pieces that overlap by two characters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(codes), CHUNK):
        c = codes[max(0, at - 2) : at + CHUNK]
        skip = at - max(0, at - 2)
        one = c * _MULT[0]
        two = (one[:-1] ^ (c[1:] * _MULT[1])) * _MULT[2]
        three = (two[:-1] ^ (c[2:] * _MULT[0])) * _MULT[1] if len(c) > 2 else two[:0]
        parts = [one[skip:], two[max(0, skip - 1) :], three]
        yield np.concatenate([(x >> np.uint32(32 - BITS)).astype(np.int32) for x in parts])


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs."""
    total = np.zeros(SIZE, np.int64)
    for g in ngrams(text):
        total += np.bincount(g, minlength=SIZE)
    at = np.flatnonzero(total)
    return at, total[at]


def packed(at: np.ndarray, n: np.ndarray) -> bytes:
    """Buckets in ascending order and their counts, as few bytes: steps between buckets and counts are mostly small."""
    return zlib.compress(np.diff(at, prepend=0).astype("<u2").tobytes() + n.astype("<u4").tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of what `packed` made."""
    raw = zlib.decompress(data)
    size = len(raw) // 6
    return np.cumsum(np.frombuffer(raw, "<u2", size), dtype=np.int64), np.frombuffer(raw, "<u4", size, 2 * size)


@dataclass
class Rows(Sequence):
    """Buckets and feature values of packed texts; each is unpacked when it is read, so that the driver holds only bytes."""

    packs: list[bytes]
    idf: np.ndarray

    def __len__(self) -> int:
        return len(self.packs)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at, n = unpacked(self.packs[i])
        return at, (n / max(1, n.sum(dtype=np.int64))).astype(np.float32).astype(float) * self.idf[at] * SCALE


@dataclass
class Model:
    """Weights (bucket by language, document frequencies folded in), biases and the temperature."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score of a whole text."""
        if not self.langs or text is None or not any(map(str.isalpha, text)):
            return UND, 0.0
        total, n = np.zeros(len(self.langs)), 0
        for g in ngrams(text):
            total += np.add.reduce(self.weights[g], axis=0, dtype=np.float64)
            n += len(g)
        z = (total / n + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def fit_ftrl(rows: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, epochs: int = 2, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by FTRL-proximal; l1 and l2 are the elastic net."""
    z, n = np.zeros((SIZE + 1, classes)), np.zeros((SIZE + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zi, ni = z[at], n[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            own, share = rows[i]
            at, x = np.append(own, SIZE), np.append(share, 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    every = weights(np.arange(SIZE + 1))
    return every[:SIZE], every[SIZE]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, over all rows of `docs`, and the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen = np.zeros(SIZE, bool)
                for g in ngrams(text or ""):
                    seen[g] = True
                df += seen
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"bucket": np.append(at, -1), "n": np.append(df[at], n)}, schema=pa.schema([("bucket", pa.int64()), ("n", pa.int64())]))

    counts = docs.select("text").mapInArrow(common.served(run, "language"), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most 2**BITS + 1 rows
    df = np.zeros(SIZE + 1)
    df[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    return df[:SIZE], int(df[SIZE])


def train(docs: DataFrame, max_rows: int = 1200, holdout: float = 0.2) -> Model:
    """Learns from text and non-null lang of `docs` alone."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang", F.xxhash64("doc_id").alias("h"))
    # The max_rows smallest hashes of each language: found on two narrow columns, so no text is sorted.
    bounds = common.smallest(labelled, "lang", "h", max_rows)
    if not bounds:
        return Model([], np.zeros((SIZE, 0), np.float32), np.zeros(0), 1.0)
    wanted = F.lit(False)
    for lang, h in bounds.items():
        wanted = wanted | ((F.col("lang") == lang) & (F.col("h") <= h))
    langs = sorted(bounds)
    # Bytes, not lists: a row of numbers becomes an object each in the driver.
    sample = labelled.where(wanted).select("h", "lang", "text").mapInArrow(common.served(_features, "language"), "h long, lang string, pack binary").toArrow()
    # A row repeated under one doc_id shares its hash, so the bound is enforced once more here.
    first = sample.select(["h", "lang"]).to_pandas().sort_values(["lang", "h"], kind="stable").groupby("lang").head(max_rows)
    packs = sample["pack"].take(first.index.to_numpy()).to_pylist()
    df, n = document_frequencies(labelled)
    idf = np.log((1 + n) / (1 + df)) + 1.0
    y = first["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy()
    held = (first["h"].to_numpy() % 1000) / 1000 < holdout
    if held.all() or not held.any():
        held = np.zeros(len(y), bool)
    w, b = fit_ftrl(Rows([p for p, h in zip(packs, held, strict=True) if not h], idf), y[~held], len(langs))
    logits = np.array([x @ w[at] + b for at, x in Rows([p for p, h in zip(packs, held, strict=True) if h], idf)]).reshape(-1, len(langs))
    model = Model(langs, (w * idf[:, None] * SCALE).astype(np.float32), b, fit_temperature(logits, y[held]))
    del sample, first, packs, df, idf, w
    common.release()
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("h", pa.int64()), ("lang", pa.string()), ("pack", pa.binary())])
    for batch in batches:
        texts = (t.as_py() for t in batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("lang").cast(pa.string()), pa.array([packed(*counted(t)) for t in texts], pa.binary())], schema=schema)


def predict(docs: DataFrame, model: Model, text: Column | None = None) -> DataFrame:
    """`docs` with lang_pred and score; other columns are carried as they are, none is read."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # its size is set by BITS and the number of languages

    @F.pandas_udf("lang_pred string, score double")
    def said(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        common.serve("language")
        return pd.DataFrame([held.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    out = docs.withColumn("said_", said(F.col("text") if text is None else text))
    return out.withColumns({"lang_pred": F.col("said_.lang_pred"), "score": F.col("said_.score")}).drop("said_")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; remainder 1 is held out from learning."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def identify(docs: DataFrame, max_rows: int = 1200) -> DataFrame:
    """Learns from the folds that are not held out and predicts every row.

    Returns doc_id, held_out, lang_pred, score. A null doc_id is never learned from.
    """
    common.prepare(docs.sparkSession)
    own = docs.select("doc_id", "text", "lang")
    model = train(own.where(fold() != 1), max_rows)
    return predict(own.select("doc_id", "text", F.coalesce(fold() == 1, F.lit(True)).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def accepted(docs: DataFrame, min_score: float = 0.5, max_rows: int = 1200) -> DataFrame:
    """The rows of `docs` whose text has a language that the model is sure enough of."""
    common.prepare(docs.sparkSession)
    model = train(docs.select("doc_id", "text", "lang").where(fold() != 1), max_rows)
    out = predict(common.boxed(docs), model, F.col("row.text"))
    return out.where((F.col("lang_pred") != UND) & (F.col("score") >= min_score)).select("row.*")
