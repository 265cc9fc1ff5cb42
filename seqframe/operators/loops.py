"""Counted loops with induction values and reductions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .aggregate import AGGREGATES, COMBINE


class Induction:
    """A value that moves by ``stride`` each trip; ``final`` is what it holds after the loop."""

    def __init__(self, base, stride=1):
        self.base, self.stride = base, stride

    def at(self, trip: Column) -> Column:
        return F.lit(self.base) + trip * F.lit(self.stride)

    def final(self, trips: int):
        return self.base + trips * self.stride


class Reduction:
    """``init`` combined by ``op`` with what each trip contributes."""

    def __init__(self, init, op: str, body: Callable[..., Column]):
        self.init, self.op, self.body = init, op, body


def reduction_plus(init, body):
    return Reduction(init, "plus", body)


def reduction_multiplies(init, body):
    return Reduction(init, "multiplies", body)


def reduction_bit_and(init, body):
    return Reduction(init, "bit_and", body)


def reduction_bit_or(init, body):
    return Reduction(init, "bit_or", body)


def reduction_bit_xor(init, body):
    return Reduction(init, "bit_xor", body)


def reduction_min(init, body):
    return Reduction(init, "minimum", body)


def reduction_max(init, body):
    return Reduction(init, "maximum", body)


def for_loop_strided(spark: SparkSession, start: int, end: int, stride: int = 1, *, induction: dict[str, Induction] | None = None, reductions: dict[str, Reduction] | None = None) -> DataFrame:
    """Run trips i = start, start + stride, ... before ``end``.

    With ``reductions``: one row, a column for each.  Bodies are functions of ``i`` and the induction
    values, in order.  Without: one row a trip with ``i`` and the induction values.
    """
    trips = spark.range(start, end, stride).withColumnRenamed("id", "i")
    trip = F.floor((F.col("i") - start) / stride).cast("long")
    values = [x.at(trip) for x in (induction or {}).values()]
    if not reductions:
        return trips.select("i", *[v.alias(k) for k, v in zip(induction or {}, values)])
    out = []
    for name, r in reductions.items():
        total = AGGREGATES[r.op](r.body(F.col("i"), *values))
        kind = "double" if isinstance(r.init, float) else "long"
        out.append(F.coalesce(COMBINE[r.op](F.lit(r.init), total), F.lit(r.init)).cast(kind).alias(name))
    return trips.agg(*out)


def for_loop(spark: SparkSession, start: int, end: int, **more) -> DataFrame:
    return for_loop_strided(spark, start, end, 1, **more)


def for_loop_n(spark: SparkSession, start: int, n: int, **more) -> DataFrame:
    return for_loop_strided(spark, start, start + n, 1, **more)


def for_loop_n_strided(spark: SparkSession, start: int, n: int, stride: int, **more) -> DataFrame:
    return for_loop_strided(spark, start, start + n * stride, stride, **more)
