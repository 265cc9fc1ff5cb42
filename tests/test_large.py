"""Sequences too large for one bucket or for 64 bits, in the small."""

from decimal import Decimal

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from seqframe import registry
from seqframe.functions import random as rnd
from seqframe.operators import aggregate as ag
from seqframe.operators import sorting
from seqframe.plans import dense_pos, ranking


def test_inner_product_beyond_64_bits(spark):
    s = spark.createDataFrame([(i, 1 << 57) for i in range(64)], "pos long, v long")
    twice = s.select("pos", F.lit(32).cast("long").alias("v"))
    got = ag.inner_product(s, twice, 5)
    assert got.columns == ["result"] and got.head()[0] == Decimal(5 + 64 * 32 * (1 << 57))
    fits = ag.inner_product(s.withColumn("v", F.col("pos")), twice, 5)
    assert fits.dtypes == [("result", "bigint")] and fits.head()[0] == 5 + 32 * sum(range(64))
    assert ag.inner_product(s.filter("false"), twice, 7).head()[0] == 7


def test_ranks_of_bounds_beyond_32_bits(spark):
    """Buckets times sampled keys pass 2^31."""
    df = spark.range(40_000).select((F.col("id") * 7919 % 40_009).alias("x"))
    dealt, total = ranking.leveled(df, "level", ["x"], rows=2)
    assert total == 40_000 and dealt.groupBy("level").count().agg(F.max("count")).head()[0] <= 4


LATE = (
    "sort", "stable_sort", "inplace_merge", "sort_descending", "radix_sort", "kernel_param", "sort_by_key", "sort_async", "sort_by", "sort_by_proj", "inplace_merge_descending", "ranges_sort", "ranges_stable_sort",
    "partial_sort_copy", "partial_sort_by", "partial_sort_copy_by", "nth_element", "nth_element_rearranged", "nth_element_by", "min_element_by", "max_element_by",
    "merge", "merge_limited", "merge_descending", "ranges_merge", "set_union_by", "set_intersection_by", "set_difference_by", "set_symmetric_difference_by",
    "copy_if", "remove_if", "partition_copy_false", "ranges_copy_if", "ranges_copy_if_limited", "search", "ranges_search", "find_end", "search_frame", "unique", "execution_seq",
)


@pytest.mark.parametrize("name", LATE)
def test_sequences_without_positions(spark, sf, name, monkeypatch):
    """Operators that take the order of a long sequence give the rows of the SQL."""
    monkeypatch.setattr(ranking, "LATE", 0)
    same_rows(spark, sf, registry.QUERIES[name], registry.ORACLE[name])


def test_long_sequences_are_sorted_by_their_keys(spark, monkeypatch):
    """Positions that nothing reads are not made: a sort moves each row once."""
    monkeypatch.setattr(ranking, "LATE", 1000)
    for name in ("sort_descending", "copy_if"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, name


def test_more_classes_than_are_broadcast(spark, sf, monkeypatch):
    monkeypatch.setattr(ranking, "LATE", 0)
    monkeypatch.setattr(sorting, "MOST", 0)
    for name in ("set_union_by", "set_symmetric_difference_by"):
        same_rows(spark, sf, registry.QUERIES[name], registry.ORACLE[name])


def moves(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_long_sequences_are_moved_once(spark, monkeypatch):
    """Positions that nothing reads are not made: a merge, a selection or a set operation moves each row once."""
    monkeypatch.setattr(ranking, "LATE", 1000)
    d = "/root/testdata/sf0.1"
    for name in ("merge", "merge_descending", "nth_element_rearranged", "set_union_by"):
        plan = registry.QUERIES[name](spark, d)
        assert moves(plan) == (3 if name == "set_union_by" else 1), name


@pytest.mark.parametrize("kinds", ["long, long, timestamp", "double, long, date", "string, double, long"])
def test_mixed_directions_choose_buckets(spark, kinds):
    """Keys of both directions, nulls and NaN: every order of directions gives the order of Spark, in even buckets."""
    names, kinds = ["a", "b", "c"], kinds.split(", ")
    raw = spark.range(600).select("id", *[F.when((F.col("id") * m) % 11 != 0, (F.col("id") * m) % n).alias(c) for c, m, n in zip(names, (7, 13, 1), (3, 5, 1000))])
    make = {"long": lambda c: c, "double": lambda c: F.when(c == 1, F.lit(float("nan"))).otherwise(c / 2), "string": lambda c: c.cast("string"), "timestamp": F.timestamp_seconds, "date": lambda c: F.date_from_unix_date(c.cast("int"))}
    df = raw.select("id", *[make[k](F.col(c)).alias(c) for c, k in zip(names, kinds)])
    for down in ([], ["a"], ["b"], ["a", "c"], ["b", "c"], names):
        got = [r.id for r in dense_pos(df, *names, descending=down, tie="id", rows=40).orderBy("pos").collect()]
        assert got == [r.id for r in df.orderBy(*ranking.ordering(names, down, "id")).collect()], down
    if kinds[0] == "long":
        dealt, _ = ranking.leveled(df, "level", names, ["a"], "id", 40)
        assert dealt.groupBy("level").count().agg(F.max("count")).head()[0] <= 80


def test_a_list_is_searched_in_one_scan(spark, monkeypatch):
    """The length is known from the making of the sequence, which is not read again to count it."""
    for late in (1000, ranking.LATE):
        monkeypatch.setattr(ranking, "LATE", late)
        plan = registry.QUERIES["ranges_search"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1


@pytest.mark.parametrize("engine", [rnd.philox4x32, rnd.philox4x64, rnd.ranlux24])
def test_vectors_are_drawn_in_one_pass(spark, engine):
    got = rnd.vectors(spark, 50, engine(), 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") + plan.count("MapInArrow") == 1
    flat = [r.v for r in rnd.numbers(spark, 200, engine()).orderBy("pos").collect()]
    assert [(r.pos, r.v) for r in got.orderBy("pos").collect()] == [(i, flat[4 * i : 4 * i + 4]) for i in range(50)]
    assert rnd.vectors(spark, 0, engine(), 4).count() == 0
