"""Copies, maps, replacements, removals and re-orderings.  All keep the relative order they promise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import compact, islands
from ..plans.ranking import Late, chosen, col, fresh, grouped_pos, length, order_of, sized

Pred = Callable[[Column], Column]


def _kept(s: DataFrame, keep: Column) -> DataFrame:
    if (o := order_of(s)) is not None:
        try:
            return Late(chosen(o, F.coalesce(keep, F.lit(False))))
        except AnalysisException:  # the test reads positions
            pass
    return compact(s.filter(F.coalesce(keep, F.lit(False))))


def copy(s: DataFrame) -> DataFrame:
    return s.select("*")


def move(s: DataFrame) -> DataFrame:
    return s.select("*")


def copy_n(s: DataFrame, n: int) -> DataFrame:
    return s.filter(F.col("pos") < n)


def copy_if(s: DataFrame, pred: Pred, proj: Pred = lambda c: c) -> DataFrame:
    return _kept(s, pred(proj(F.col("v"))))


def swap_ranges(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both sequences after the exchange: ``pos, a, b``."""
    return a.select("pos", F.col("v").alias("b")).join(b.select("pos", F.col("v").alias("a")), "pos").select("pos", "a", "b")


def transform(s: DataFrame, op: Pred, proj: Pred = lambda c: c) -> DataFrame:
    return s.withColumn("v", op(proj(F.col("v"))))


def transform_binary(a: DataFrame, b: DataFrame, op: Callable[[Column, Column], Column]) -> DataFrame:
    both = a.select("pos", F.col("v").alias("_a")).join(b.select("pos", F.col("v").alias("_b")), "pos")
    return both.select("pos", op(F.col("_a"), F.col("_b")).alias("v"))


def transform_if(s: DataFrame, out: DataFrame, op: Pred, pred: Pred) -> DataFrame:
    """``op`` where ``pred`` holds; elsewhere what ``out`` held before."""
    both = s.join(out.select("pos", F.col("v").alias("_out")), "pos")
    return both.withColumn("v", F.when(pred(F.col("v")), op(F.col("v"))).otherwise(F.col("_out"))).drop("_out")


def transform_if_binary(a: DataFrame, b: DataFrame, out: DataFrame, op: Callable, pred: Callable) -> DataFrame:
    x = a.select("pos", F.col("v").alias("_a")).join(b.select("pos", F.col("v").alias("_b")), "pos").join(out.select("pos", F.col("v").alias("_out")), "pos")
    return x.select("pos", F.when(pred(F.col("_a"), F.col("_b")), op(F.col("_a"), F.col("_b"))).otherwise(F.col("_out")).alias("v"))


def replace(s: DataFrame, old, new) -> DataFrame:
    return replace_if(s, lambda v: v == F.lit(old), new)


def replace_if(s: DataFrame, pred: Pred, new) -> DataFrame:
    return s.withColumn("v", F.when(pred(F.col("v")), F.lit(new)).otherwise(F.col("v")).cast(s.schema["v"].dataType))


replace_copy, replace_copy_if = replace, replace_if


def fill(s: DataFrame, value) -> DataFrame:
    return s.withColumn("v", F.lit(value).cast(s.schema["v"].dataType))


def fill_n(s: DataFrame, n: int, value) -> DataFrame:
    return s.withColumn("v", F.when(F.col("pos") < n, F.lit(value)).otherwise(F.col("v")).cast(s.schema["v"].dataType))


def generate(s: DataFrame, g: Callable[[], Column]) -> DataFrame:
    """Assign ``g()``, an expression such as ``F.rand(seed)`` or a function of ``pos``."""
    return s.withColumn("v", g())


def generate_n(spark: SparkSession, n: int, g: Callable[[], Column]) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos")).withColumn("v", g())


def remove(s: DataFrame, value) -> DataFrame:
    return _kept(s, ~F.col("v").eqNullSafe(F.lit(value)))


def remove_if(s: DataFrame, pred: Pred) -> DataFrame:
    return _kept(s, ~F.coalesce(pred(F.col("v")), F.lit(False)))


remove_copy, remove_copy_if = remove, remove_if


def unique(s: DataFrame, same: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Keep the first of each run of consecutive equal elements; the number of the run is its new position."""
    run, first = fresh(s, "_run", "_first")
    out = islands(s, "v", same, run, first).filter(first)
    return out.withColumn("pos", F.col(run) - 1).select(*map(col, s.columns))


unique_copy = unique


def reverse(s: DataFrame) -> DataFrame:
    n = length(s)
    return sized(s.withColumn("pos", F.lit(n - 1) - F.col("pos")), n)


reverse_copy = reverse


def rotate(s: DataFrame, middle: int) -> DataFrame:
    """The element at ``middle`` becomes the first."""
    n = length(s)
    return sized(s.withColumn("pos", F.pmod(F.col("pos") - middle, F.lit(n or 1)).cast("long")), n)


rotate_copy = rotate


def shift_left(s: DataFrame, n: int) -> DataFrame:
    """Drop the first ``n``; unchanged for n <= 0."""
    return s.select("*") if n <= 0 else s.filter(F.col("pos") >= n).withColumn("pos", F.col("pos") - n)


def shift_right(s: DataFrame, n: int) -> DataFrame:
    """Drop the last ``n`` and move the rest back by ``n``; unchanged for n <= 0."""
    if n <= 0:
        return s.select("*")
    return s.filter(F.col("pos") < length(s) - n).withColumn("pos", F.col("pos") + n)


def stable_partition(s: DataFrame, pred: Pred) -> DataFrame:
    """Elements that pass first; order kept in both groups."""
    late, old = F.when(F.coalesce(pred(F.col("v")), F.lit(False)), 0).otherwise(1), fresh(s, "_old")[0]
    return grouped_pos(s.withColumnRenamed("pos", old), late, old).select(*map(col, s.columns))


partition = stable_partition


def partition_point(s: DataFrame, pred: Pred) -> DataFrame:
    """The boundary that a partition by ``pred`` leaves."""
    return s.agg(F.count_if(pred(F.col("v"))).alias("result"))


def partition_copy(s: DataFrame, pred: Pred) -> tuple[DataFrame, DataFrame]:
    p = F.coalesce(pred(F.col("v")), F.lit(False))
    return _kept(s, p), _kept(s, ~p)
