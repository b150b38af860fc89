"""The queries opN_<name> and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import chat_format, decontaminate, language_id, masked_lm, near_dup, packing, quality_rules, site_quality, token_counts, url_filter
from trellis.storage import read_table


def op1_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digests(chat_format.segments(chat_format.with_hostile(read_table(spark, sf_dir, "conversations"))))


def op3_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op5_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.pseudo_likelihood(read_table(spark, sf_dir, "documents"))


def op6_large_item_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_empirical_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.site_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_oph_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"), k=3, percent=85)


def op9_threshold_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.verdicts(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *(f"quality_report.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op10_markov_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(read_table(spark, sf_dir, "pages"))


_ALL = (
    op1_whole_token_counts, op2_prefix_target_chat, op3_winnowing_decontamination, op4_cross_parsing_language, op5_masked_pseudo_likelihood,
    op6_large_item_packing, op7_empirical_bayes_quality, op8_oph_near_dedup, op9_threshold_quality_rules, op10_markov_url_filter,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {"op2_prefix_target_chat": chat_format.sql(), "op9_threshold_quality_rules": quality_rules.sql()}
