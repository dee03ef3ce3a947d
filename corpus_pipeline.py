"""From raw documents to token ids: language, near duplicates, personal data, mixture, pieces.

Each stage works on all that the one before kept; between stages the rows are written as Parquet and
read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillrow.llm import common, language, mixing, pieces, pii, simhash

#: By how much the tokens of each quality domain change in the mixture. Documents of the first domain get a rate of
#: one or more, so that none of them is lost.
MULTIPLES = {"high": 1.05, "low": 0.9, "toxic": 0.8}


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model is sure of."""
    return language.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity of about 0.8 or more."""
    return simhash.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind."""
    return pii.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the fitted rates say."""
    return mixing.mixed(docs, mixing.quality_domains(common.read(spark, sf_dir, "labels")), MULTIPLES)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document and of two sampled segmentations."""
    import public_tokenizers

    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), room=pieces.LITTLE)


STAGES = [
    ("language_id", languages),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixture),
    ("sentencepiece", token_ids),
]

#: Learned models and sampled segmentations are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
