"""Secret scans judged by who owns the candidate across the whole corpus.

Each text is scanned for candidate credentials. The hash of each candidate is then counted over the
corpus by distinct owners, repositories and documents. A value that many owners carry was copied
from a manual or a template; a value that stays with one owner looks live.

Shapes of input with a defined result: a null text is an empty one (no spans); a null owner or
repository counts as one unnamed owner or repository; repeated rows are scanned one by one but count
once as owner or repository; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrow.llm import common, spans

#: Kinds that every scan reports, in their order.
BASE = ("assign", "access", "hex")
#: Kinds that are reported only where ownership says that the value looks live.
OWNED = ("jwt", "vendor", "pem", "opaque")
KINDS = BASE + OWNED

ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
JWT = re.compile(r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
VENDOR = re.compile(r"\b(?:ghp|gho|ghs|ghu|ghr|glpat|xoxb|xoxp|xoxa|sk|rk|pk)[_-][A-Za-z0-9_-]{20,}")
PEM = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Bytes as x (lowercase hex digit) or space, to find long hex runs with one search.
_HEX_MAP = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
#: Bytes as x (part of an opaque token) or space.
_OPAQUE_MAP = bytes(120 if re.match(r"[A-Za-z0-9+/_-]", chr(i)) else 32 for i in range(256))


def entropy(value: str) -> float:
    """Shannon entropy of the characters, in bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in (value.count(x) for x in set(value))) if n else 0.0


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the base kinds: leftmost, non-overlapping per kind; failing matches are dropped."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [("assign", *m.span(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"x" * 24 in text.encode("utf-8", "replace").translate(_HEX_MAP):
        found += [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    return found


def further_spans(text: str, min_entropy: float) -> list[tuple[str, int, int, str]]:
    """Candidates of the kinds that ownership has to confirm."""
    found = []
    if "eyJ" in text:
        found += [("jwt", *m.span(), m[0]) for m in JWT.finditer(text)]
    if "PRIVATE KEY-----" in text:
        found += [("pem", *m.span(), m[0]) for m in PEM.finditer(text)]
    if b"x" * 23 in text.encode("utf-8", "replace").translate(_OPAQUE_MAP):
        found += [("vendor", *m.span(), m[0]) for m in VENDOR.finditer(text)]
        for m in OPAQUE.finditer(text):
            v = m[0]
            mixed = re.search("[0-9]", v) and re.search("[a-z]", v) and re.search("[A-Z]", v)
            if mixed and entropy(v) >= min_entropy:
                found.append(("opaque", *m.span(), v))
    return found


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_sha256", pa.string()), ("entropy", pa.float64())])
_SCAN = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("repository", pa.string()), ("owner", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("found", pa.list_(_SPAN))])
_SCAN_DDL = "row_key long, doc_id long, repository string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<kind:string,start:long,end:long,value_sha256:string,entropy:double>>"


def candidates(docs: DataFrame, repository: str = "doc_id", owner: str = "source", min_entropy: float = 3.5) -> DataFrame:
    """One row per document with its base digest and all candidate spans."""

    def rows(batch: list[dict]) -> Iterator[dict]:
        for r in batch:
            text = r["text"] or ""
            base = base_spans(text)
            kinds = [x[0] for x in base]
            taken = {x[1:3] for x in base}
            more = [x for x in further_spans(text, min_entropy) if x[1:3] not in taken]
            yield {
                "row_key": r["row_key"], "doc_id": r["doc_id"], "repository": r["repository"], "owner": r["owner"],
                "n_assign": kinds.count("assign"), "n_access": kinds.count("access"), "n_hex": kinds.count("hex"),
                "base_sha256": spans.digest(spans.joined([x[:3] for x in base], KINDS)),
                "found": [{"kind": k, "start": a, "end": b, "value_sha256": spans.digest(v), "entropy": entropy(v)} for k, a, b, v in base + more],
            }

    picked = docs.select("doc_id", F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"), "text")
    return common.map_rows(common.keyed(picked), rows, _SCAN, _SCAN_DDL)


def ownership(found: DataFrame) -> DataFrame:
    """How many documents, repositories and owners carry each candidate value.

    Counted in three steps, each summed before its shuffle: by value, owner and repository, then by
    value and owner, then by value. No step gathers the rows of one value in one task.
    """
    none = F.lit("\0")
    each = found.select("row_key", F.coalesce("owner", none).alias("owner"), F.coalesce("repository", none).alias("repository"), F.explode(F.array_distinct("found.value_sha256")).alias("value_sha256"))
    return (
        each.groupBy("value_sha256", "owner", "repository").agg(F.count("*").alias("n_documents"))
        .groupBy("value_sha256", "owner").agg(F.sum("n_documents").alias("n_documents"), F.count("*").alias("n_repositories"))
        .groupBy("value_sha256").agg(F.sum("n_documents").alias("n_documents"), F.sum("n_repositories").alias("n_repositories"), F.count("*").alias("n_owners"))
    )


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", min_owners_copied: int = 3, min_entropy: float = 3.5) -> DataFrame:
    """Secrets of every text, each with its standing in the corpus.

    Returns per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind, start, end,
    value_sha256, n_documents, n_repositories, n_owners, standing) in order. The standing is `copied`
    for a value of `min_owners_copied` owners or more, else `placeholder` for one of low entropy,
    else `live`. Base kinds are kept whatever their standing; the others only where they look live.
    A repository that two owners share counts for each of them.
    """
    common.prepare(docs.sparkSession)
    found = common.written(candidates(docs, repository, owner, min_entropy), "secrets")
    keep = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    standing = F.when(F.col("n_owners") >= min_owners_copied, "copied").when(F.col("entropy") < F.lit(min_entropy) - 1, "placeholder").otherwise("live")
    kind_rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    judged = (
        found.where(F.size("found") > 0).select("row_key", *keep, F.explode("found").alias("s")).select("row_key", *keep, "s.*")
        .join(ownership(found), "value_sha256").withColumn("standing", standing).withColumn("rank", kind_rank)
        .withColumn("reported", F.col("kind").isin(*BASE) | (F.col("standing") == "live"))
        .groupBy("row_key").agg(*[F.first(c).alias(c) for c in keep], F.array_sort(F.collect_list(F.when(F.col("reported"), F.struct("start", "rank", "end", "kind", "value_sha256", "n_documents", "n_repositories", "n_owners", "standing")))).alias("spans"))
        .drop("row_key")
    )
    clean = found.where(F.size("found") == 0).select(*keep, F.array().cast(judged.schema["spans"].dataType).alias("spans"))
    return judged.unionByName(clean)
