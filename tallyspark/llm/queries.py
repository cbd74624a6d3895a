"""The registered queries of this package: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import (
    alignment,
    html_extraction,
    nn_descent,
    packing,
    quality_rules,
    secret_scan,
    sentencepiece_unigram,
    simhash,
    spelling,
    token_counts,
    toxicity,
    warc,
    wavelet,
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extracted(_read(spark, sf_dir, "pages"))


def op2_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(_read(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_read(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op5_unigram_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_unigram.encoding_report(_read(spark, sf_dir, "documents"), path)


def op6_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(_read(spark, sf_dir, "documents"), path).drop("ids")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_report(_read(spark, sf_dir, "documents"))


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), path)


def op11_lockstep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.alignment(_read(spark, sf_dir, "documents"), *paths)


def op12_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return wavelet.stored_documents(_read(spark, sf_dir, "documents"), path)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_crf": op1_html_crf,
    "op2_simhash_pivots": op2_simhash_pivots,
    "op3_arc_to_warc": op3_arc_to_warc,
    "op4_quality_rules": op4_quality_rules,
    "op5_unigram_encoding": op5_unigram_encoding,
    "op6_concat_and_cut": op6_concat_and_cut,
    "op7_secret_scan": op7_secret_scan,
    "op8_nn_descent": op8_nn_descent,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
    "op11_lockstep_alignment": op11_lockstep_alignment,
    "op12_wavelet_shards": op12_wavelet_shards,
    "op13_spelling_variants": op13_spelling_variants,
}
