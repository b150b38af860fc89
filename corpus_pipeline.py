"""The corpus pipeline: quality rules, language, near-duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the documents it keeps
with their columns; the last returns the packing of what is left. Nulls, ties and empty tables are treated as the
operators' docstrings say: a null text fails the quality rules.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trellis.llm import decontaminate, language_id, near_dup, packing, quality_rules
from trellis.storage import Scratch, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule fails."""
    return quality_rules.passing(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach."""
    return language_id.recognised(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked by a similarity of 0.8 of five-word shingles."""
    return near_dup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, with their place in sequences of 1024 tokens."""
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("language_id", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]

#: Language, near-duplicates and tokens are beyond SQL; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
