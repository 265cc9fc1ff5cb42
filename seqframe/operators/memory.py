"""Construction and destruction of elements.  Frames hold no raw memory: results are projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values that a type has after value-initialisation.
ZERO = {"string": "", "boolean": False}


def uninitialized_copy(s: DataFrame) -> DataFrame:
    return s.select("*")


def uninitialized_copy_n(s: DataFrame, n: int) -> DataFrame:
    return s.filter(F.col("pos") < n)


uninitialized_move, uninitialized_move_n = uninitialized_copy, uninitialized_copy_n


def uninitialized_fill(s: DataFrame, value) -> DataFrame:
    return s.withColumn("v", F.lit(value).cast(s.schema["v"].dataType))


def uninitialized_fill_n(spark: SparkSession, n: int, value) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), F.lit(value).alias("v"))


def destroy(s: DataFrame) -> DataFrame:
    """Give up cached data; an empty sequence of the same type remains."""
    s.unpersist()
    return s.filter(F.lit(False))


def destroy_n(s: DataFrame, n: int) -> DataFrame:
    return s.filter(F.col("pos") >= n)


def uninitialized_default_construct(s: DataFrame) -> DataFrame:
    """Elements without a set value: typed nulls."""
    return s.withColumn("v", F.lit(None).cast(s.schema["v"].dataType))


def uninitialized_default_construct_n(spark: SparkSession, n: int, kind: str) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), F.lit(None).cast(kind).alias("v"))


def uninitialized_value_construct(s: DataFrame) -> DataFrame:
    kind = s.schema["v"].dataType
    return s.withColumn("v", F.lit(ZERO.get(kind.typeName(), 0)).cast(kind))


def uninitialized_value_construct_n(spark: SparkSession, n: int, kind: str) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), F.lit(ZERO.get(kind, 0)).cast(kind).alias("v"))
