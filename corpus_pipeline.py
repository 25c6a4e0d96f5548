"""A corpus pipeline: filter by quality, drop near-duplicates, mask personal data, mix sources, encode.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it kept; its result is written
and read again before the next. All but the last return the columns of ``documents``; the last one returns, per row of
the mix, ``doc_id``, ``source``, the token ids and their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm import bpe, mixing, pii, quality, queries, similar
from clauseloom.llm.common import bounded_batches, read
from clauseloom.session import materialize

#: SQL can express neither the fingerprints nor the classifier; tests hold the stages against plain Python.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    bounded_batches(spark)
    return quality.keep_quality(docs, read(spark, sf_dir, "labels"), threshold=0.3)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more): the one of the smallest id."""
    bounded_batches(spark)
    return similar.drop_similar(docs, ratio=(4, 5), shingle=5)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked; ``n_chars`` follows the text."""
    bounded_batches(spark)
    masked = pii.mask_documents(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    bounded_batches(spark)
    return mixing.mix_documents(docs, weights=(5, 2, 1), share=1.5, cap=2)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    bounded_batches(spark)
    encoded = bpe.encode_documents(docs.select("doc_id", "source", "text"), queries.codec(spark))
    return encoded.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality", quality_stage), ("near_duplicates", near_duplicates_stage), ("personal_data", personal_data_stage),
    ("mixing", mixing_stage), ("encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
