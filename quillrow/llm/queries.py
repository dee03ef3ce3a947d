"""The corpus operators as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrow.llm import ann, bitpack, epsilon, language, mixing, pieces, pii, secrets, simhash, suffixes
from quillrow.llm.common import read


def _spans_text(c: str = "spans") -> Column:
    return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Words of the strings that make repeated passages.
PASSAGE = 51
#: Shares of tokens that the mixing query aims at.
TARGETS = {"high": 0.8, "low": 0.15, "toxic": 0.05}


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate and copies of every document for the target shares of quality domains."""
    out = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text"), mixing.quality_domains(read(spark, sf_dir, "labels")), TARGETS)
    share = [F.col("posterior")[i].alias(f"p_{n}") for i, n in enumerate(TARGETS)]
    return out.select("doc_id", "n_tokens", *share, "rate", "n_copies")


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all vectors."""
    table = read(spark, sf_dir, "embeddings")
    return ann.search(table, table.where(F.col("vec_id") % 20 == 0))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written bit-packed and read back."""
    import public_tokenizers

    return bitpack.write_and_read(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_bilstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    out = pii.detect(read(spark, sf_dir, "documents"))
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", _spans_text().alias("spans"), added.alias("n_added"), F.size("spans").cast("long").alias("n_spans"))


def op6_gumbel_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and of two sampled segmentations, with their digests."""
    import public_tokenizers

    return pieces.encode(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated strings of 400 bytes, and its words in passages of over 50 that repeat."""
    out = suffixes.removed(read(spark, sf_dir, "documents").select("doc_id", "text"), 400, passage=PASSAGE)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", F.length("data").cast("long").alias("n_bytes"), gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language.identify(read(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; a document is a repository, its source the owner."""
    out = secrets.scan(read(spark, sf_dir, "documents"))
    live = F.size(F.filter("spans", lambda s: s["standing"] == "live")).cast("long")
    copied = F.size(F.filter("spans", lambda s: s["standing"] == "copied")).cast("long")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", _spans_text().alias("spans"), live.alias("n_live"), copied.alias("n_copied"), F.size("spans").cast("long").alias("n_spans"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-equal vectors within a label."""
    return epsilon.near_duplicates(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_soft_mixing": op1_soft_mixing,
    "op2_multi_index": op2_multi_index,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_bit_packing": op4_bit_packing,
    "op5_bilstm_crf_pii": op5_bilstm_crf_pii,
    "op6_gumbel_sentencepiece": op6_gumbel_sentencepiece,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_language_id": op8_language_id,
    "op9_secret_scan": op9_secret_scan,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
}

_LINKS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r(node, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, l.y FROM r JOIN l ON r.seen = l.x),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY 1), n AS (SELECT x, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON x = vec_id"""

#: The other operators learn, hash, sample or tokenise, which SQL can't say; tests hold them against plain versions.
ORACLE_SQL: dict[str, str] = {"op10_embedding_near_dedup": _LINKS_SQL}
