"""A training-data pipeline over the documents table: five stages, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import near_copies, packing, quality_rules, secret_scan, toxicity
from tallyspark.llm.common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that score 0.5 or more go. The labels of `sf_dir` train the classifier.

    Null and empty texts are scored like any other; without toxic labels all
    stay. Rows that repeat stay or go together. Empty tables give empty results.
    """
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that fail the base rules or are depleted go, and the shared lines of the others.

    Null and empty texts have too few words, so they go. Rows that repeat stay
    or go together. Empty tables give empty results.
    """
    return quality_rules.keep_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates: of each group one document stays, the one with the smallest id, nulls last.

    Of rows that repeat, and of ties without an id, one stays. Null and empty
    texts are copies of each other. Empty tables give empty results.
    """
    return near_copies.one_of_each(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: what they find is replaced by a mark.

    Null and empty texts stay as they are, rows that repeat too, each with the
    same change. Empty tables give empty results.
    """
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of all documents in windows of 4096 tokens, ids included.

    Null and empty texts are their end id alone. Rows that repeat are packed
    each. Empty tables give empty results.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scans", hide_secrets),
    ("packing", pack),
]

#: Learned scores and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
