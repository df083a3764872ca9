"""Corpus pipeline: quality rules, near-dedup, decontamination, personal data, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a
DataFrame; all but the last return the columns of documents. Between stages the rows are written as
Parquet in the shared folder, so a lost executor costs one stage's tasks at most. Empty tables pass
through as empty tables; see the operators for nulls, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import common, decontam, neardup, packing, pii, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that fail the base rules or lie far from their language and source."""
    return quality.keep_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies."""
    return neardup.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap a benchmark item."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts; n_chars follows the new text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of power-of-two lengths, with their ids. Workers remember few words, as executors are full by now."""
    return packing.pack(docs, cache_words=100_000)


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("pii", personal_data), ("packing", pack)]

#: The quality stage's robust estimate and the encoding aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for name, stage in first:
        before, docs = docs, common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        common.drop(before)
    return last(spark, docs, sf_dir)
