"""The registered queries of this subpackage: each applies its operator to a whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontaminate, html_density, language, media, ngram_join, packing, prefix_trie, quality, sql, token_coder, toxicity, url_rules, warc
from .tokens import vocabulary_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_coder.op1_query(_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op2_warc_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op2_query(_table(spark, sf_dir, "pages"))


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op3_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op4_query(_table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def op5_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op5_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op6_query(_table(spark, sf_dir, "documents"))


def op7_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.op7_query(_table(spark, sf_dir, "pages"))


def op8_quality_fourier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op8_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op9_query(_table(spark, sf_dir, "documents"))


def op10_count_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.op10_query(_table(spark, sf_dir, "documents"))


def op11_stream_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.op11_query(_table(spark, sf_dir, "documents"))


def op12_url_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.op12_query(_table(spark, sf_dir, "pages"))


def op13_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.op13_query(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_coder, op2_warc_ranges, op3_winnowing, op4_linear_grouping, op5_toxicity_ftrl, op6_transport_streams, op7_text_density, op8_quality_fourier, op9_language_profiles, op10_count_tree, op11_stream_layout, op12_url_expressions, op13_burst_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_ranges": sql.OP2, "op3_winnowing": sql.OP3, "op10_count_tree": sql.OP10, "op11_stream_layout": sql.OP11, "op12_url_expressions": sql.OP12, "op13_burst_trie": sql.OP13}
