"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chronolex.llm import ann, conversation_trie, decontamination, divergence, html_text, language_id, line_dedup, mixing, pieces, quality_classifier, quality_rules, simhash, substring_dedup


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.digest(_read(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(_read(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(_read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_read(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_read(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(_read(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(_read(spark, sf_dir, "documents"))


def op9_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.digest(_read(spark, sf_dir, "embeddings"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.digest(_read(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.digest(_read(spark, sf_dir, "conversations"))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_html_text,
        op3_language_id,
        op4_quality_rules,
        op5_line_dedup,
        op6_substring_dedup,
        op7_source_mixing,
        op8_simhash,
        op9_piece_encoding,
        op10_prefix_forest,
        op11_source_divergence,
        op12_conversation_trie,
        op13_benchmark_decontamination,
    )
}
ORACLES = {"op5_line_dedup": line_dedup.SQL, "op7_source_mixing": mixing.SQL, "op11_source_divergence": divergence.SQL, "op12_conversation_trie": conversation_trie.SQL, "op13_benchmark_decontamination": decontamination.SQL}
