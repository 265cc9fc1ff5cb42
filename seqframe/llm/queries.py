"""The registered queries of the subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, line_dedup, media, minhash_dedup, mixing, secrets, sharding, substring_dedup, suffix_dedup, toxicity
from ._shared import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.line_dedup(table(spark, sf_dir, "pages")))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), batches=3, fanout=2))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.audio(table(spark, sf_dir, "documents")))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_suffix_array_dedup,
        op3_benchmark_decontamination,
        op4_sharding,
        op5_substring_dedup,
        op6_secret_scans,
        op7_media_columns,
        op8_minhash_near_dedup,
        op9_mixing,
        op10_toxicity,
    )
}

ORACLE: dict[str, str] = {
    "op1_line_dedup": line_dedup.SQL,
    "op2_suffix_array_dedup": suffix_dedup.SQL,
    "op5_substring_dedup": substring_dedup.SQL,
    "op8_minhash_near_dedup": minhash_dedup.SQL,
    "op9_mixing": mixing.SQL,
}
