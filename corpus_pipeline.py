"""The corpus pipeline: five stages, each reading what the one before has kept.

Part of the optional subpackage ``labelloom.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelloom.llm import decontaminate, exact_dedup, jaccard_join, mil_quality, raking
from labelloom.llm.common import materialize, table
from labelloom.llm.queries import MIX_FRACTION, MIX_TARGETS, is_past, quality_model


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the attention model rejects."""
    return mil_quality.keep_good(docs, quality_model(spark, sf_dir, docs))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the document with the largest id."""
    return exact_dedup.keep_winners(docs, is_past(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group joined by similarity links keep the document with the smallest id."""
    return jaccard_join.keep_one(docs)


def benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents so that sources, languages and topics meet their weights."""
    return raking.keep_mixture(docs, MIX_TARGETS, MIX_FRACTION)


STAGES = [("quality", quality), ("exact duplicates", exact_duplicates), ("near duplicates", near_duplicates),
          ("benchmark overlaps", benchmark_overlaps), ("mixture", mixture)]

# A trained model decides in the first stage, so SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
