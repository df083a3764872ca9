"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common, decontam, html_extract, lengths, neardup, packing, pii, quality, sql, substring, token_codes, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_digest(packing.pack(_table(spark, sf_dir, "documents")))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "codes")
    token_codes.write(_table(spark, sf_dir, "documents"), path)
    return token_codes.digests(token_codes.read(spark, path))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.token_counts(_table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.with_digest(pii.find(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_html, op3_toxicity, op4_token_codes, op5_near_duplicates, op6_quality, op7_token_counts, op8_decontamination, op9_substring, op10_pii)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
