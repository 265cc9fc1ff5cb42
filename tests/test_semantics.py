"""Documented results, degenerate arguments, and random sequences against plain Python."""

import itertools
import threading

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqframe.operators import aggregate as ag
from seqframe.operators import rearrange as re
from seqframe.operators import search as se
from seqframe.operators import sorting as so
from seqframe.plans import dense_pos, islands, neighbour, ranking, running, scan_with, segment_scan
from seqframe.sources import sequences as src
from seqframe.streaming import async_ as asy
from seqframe.streaming import selection as sel

CASES = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
NUMBERS = st.lists(st.integers(0, 6), max_size=40)


def seq(spark, values, **more):
    rows = [(i, v, *[c[i] for c in more.values()]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, ", ".join(["pos long", "v long", *[f"{k} long" for k in more]]))


def values(df, name="v"):
    rows = sorted((r.pos, r[name]) for r in df.collect())
    assert [p for p, _ in rows] == list(range(len(rows)))
    return [v for _, v in rows]


def one(df):
    return df.head()[0]


def test_documented_runs(spark):
    s = seq(spark, [1, 2, 3, 4, 5, 6], k=[0, 0, 0, 1, 1, 1])
    assert [(r.k, r.v) for r in ag.reduce_by_segment(s).orderBy("pos").collect()] == [(0, 6), (1, 15)]
    assert values(ag.inclusive_scan_by_segment(s)) == [1, 3, 6, 4, 9, 15]
    assert values(ag.exclusive_scan_by_segment(s)) == [0, 1, 3, 0, 4, 9]
    again = seq(spark, [1] * 6, k=[1, 1, 2, 1, 1, 1])
    assert [(r.k, r.v) for r in ag.reduce_by_segment(again).orderBy("pos").collect()] == [(1, 2), (2, 1), (1, 3)]


def test_documented_bounds(spark):
    s, q = seq(spark, [0, 2, 2, 2, 3, 3, 3, 3, 6, 6]), seq(spark, [0, 2, 4, 7, 6])
    assert values(ag.lower_bound(s, q), "result") == [0, 1, 8, 10, 8]
    assert values(ag.upper_bound(s, q), "result") == [1, 4, 8, 10, 10]
    assert values(ag.binary_search(s, q), "result") == [True, True, False, False, True]


def test_documented_histograms(spark):
    s = seq(spark, [9, 9, 3, 8, 4, 4, 4, 5, 1, 99])
    assert [r.n for r in ag.histogram(s, 5, 0, 10).orderBy("bin").collect()] == [1, 1, 4, 0, 3]
    assert [r.n for r in ag.histogram_bounds(s, [-1, 0, 8, 12]).orderBy("bin").collect()] == [0, 6, 3]


def test_degenerate(spark):
    s, e = seq(spark, [5, 5, 7]), seq(spark, [])
    assert one(se.search(s, [])) == 0 and one(se.find_end(s, [])) == 3 and one(se.find_first_of(s, [])) == 3
    assert one(se.search_n(s, 0, 5)) == 0 and one(se.search_n(s, 2, 5)) == 0 and one(se.search_n(s, 3, 5)) == 3
    assert one(se.find(e, 1)) == 0 and one(se.is_sorted(e)) and one(se.is_heap(e)) and one(se.is_partitioned(e, lambda v: v > 1))
    assert one(se.equal(e, e)) and not one(se.equal(s, e)) and one(se.mismatch(s, e)) == 0
    assert one(se.lexicographical_compare(e, s)) and not one(se.lexicographical_compare(s, e)) and not one(se.lexicographical_compare(s, s))
    assert values(re.shift_left(s, 9)) == [] and values(re.shift_left(s, 0)) == [5, 5, 7]
    assert one(ag.reduce(e, 3)) == 3 and values(so.sort(e)) == [] and values(ag.adjacent_difference(e)) == []
    assert [r.n for r in ag.histogram(e, 3, 0, 3).orderBy("bin").collect()] == [0, 0, 0]
    assert tuple(so.minmax_element(seq(spark, [2, 1, 3, 1, 3])).head()) == (1, 4)
    assert one(so.max_element(seq(spark, [2, 3, 3]))) == 1


@CASES
@given(a=NUMBERS)
def test_sequences(spark, a):
    s = seq(spark, a)
    assert values(so.sort(s)) == sorted(a)
    assert values(re.unique(s)) == [k for k, _ in itertools.groupby(a)]
    assert values(ag.inclusive_scan(s)) == list(itertools.accumulate(a))
    assert values(ag.exclusive_scan(s, 1)) == list(itertools.accumulate(a, initial=1))[: len(a)]
    assert values(re.stable_partition(s, lambda v: v > 2)) == [x for x in a if x > 2] + [x for x in a if x <= 2]
    assert values(re.rotate(s, 3)) == (a[3 % len(a) :] + a[: 3 % len(a)] if a else [])
    pattern = a[1:3] or [9]
    starts = [i for i in range(len(a) - len(pattern) + 1) if a[i : i + len(pattern)] == pattern]
    assert one(se.search(s, pattern)) == (starts[0] if starts else len(a))
    assert one(se.find_end(s, pattern)) == (starts[-1] if starts else len(a))


@CASES
@given(a=NUMBERS, b=NUMBERS)
def test_multisets(spark, a, b):
    x, y = seq(spark, sorted(a)), seq(spark, sorted(b))
    count = lambda v: (a.count(v), b.count(v))
    every = sorted(set(a) | set(b))
    expand = lambda f: [v for v in every for _ in range(f(*count(v)))]
    assert values(so.set_union(x, y)) == expand(max)
    assert values(so.set_intersection(x, y)) == expand(min)
    assert values(so.set_difference(x, y)) == expand(lambda m, n: max(0, m - n))
    assert values(so.set_symmetric_difference(x, y)) == expand(lambda m, n: abs(m - n))
    assert one(se.includes(x, y)) == all(a.count(v) >= b.count(v) for v in set(b))
    assert values(so.merge(x, y)) == sorted(a + b)


@pytest.mark.parametrize("bucket", [1, 3, 1000])
def test_recipes_over_buckets(spark, bucket):
    a = [3, 3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5]
    s = seq(spark, a)
    for op, f in (("sum", lambda x, y: x + y), ("min", min), ("max", max), ("bit_xor", lambda x, y: x ^ y)):
        assert values(running(s, F.col("v"), op, "r", bucket=bucket), "r") == list(itertools.accumulate(a, f))
    product = lambda x, y: x * y % 97
    assert values(scan_with(s, "v", product, 2, "r", bucket=bucket), "r") == list(itertools.accumulate(a, product, initial=2))[1:]
    assert values(scan_with(s, "v", product, 2, "r", inclusive=False, bucket=bucket), "r") == list(itertools.accumulate(a, product, initial=2))[:-1]
    assert values(neighbour(s, "v", -1, "b", bucket=bucket), "b") == [None, *a[:-1]]
    assert values(neighbour(s, "v", 1, "b", bucket=bucket), "b") == [*a[1:], None]
    assert values(islands(s, "v"), "island") == [1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]


def test_positions_with_frequent_values(spark):
    rows = [(i, 7 if i % 3 else i, f"k{i % 5}") for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, n int, t string")
    got = [r.i for r in dense_pos(df, "n", tie="i").orderBy("pos").collect()]
    assert got == [i for i, _, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    got = [r.i for r in dense_pos(df, "t", "i").orderBy("pos").collect()]
    assert got == [i for i, _, _ in sorted(rows, key=lambda r: (r[2], r[0]))]
    down = [r.i for r in dense_pos(df, "n", descending=["n"], tie="i").orderBy("pos").collect()]
    assert down == [i for i, _, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    odd = spark.createDataFrame([(1, None), (2, 3.0), (3, float("nan")), (4, -1.0)], "i long, x double")
    assert [r.i for r in dense_pos(odd, "x").orderBy("pos").collect()] == [1, 4, 2, 3]


def scans_and_exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan"), plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def test_plans_read_and_move_once(spark):
    """Each operator reads its table once; rows are moved once for the positions and once for the operator."""
    from seqframe import registry

    sf = "/root/testdata/sf0.1"
    orders, events = registry.orders(spark, sf), registry.events(spark, sf)
    assert scans_and_exchanges(orders) == (1, 1)
    for df in (so.sort(orders), ag.inclusive_scan(orders), re.unique(orders), ag.adjacent_difference(orders), re.copy_if(orders, lambda v: v % 3 == 0), re.stable_partition(orders, lambda v: v > 9)):
        assert scans_and_exchanges(df) == (1, 2)
    assert scans_and_exchanges(ag.inclusive_scan_by_segment(events)) == (1, 2)
    assert scans_and_exchanges(ag.reduce_by_segment(events)) == (1, 3)


@pytest.mark.parametrize("kind", ["tie", "prefix", "nulls"])
def test_buckets_stay_even(spark, kind):
    """No bucket takes more than twice its share on frequent values, shared prefixes and nulls; halving agrees with comparing."""
    n, rows = 4000, 100
    value = {"tie": F.when(F.col("i") % 10 == 0, F.col("i")).otherwise(7), "prefix": F.concat(F.lit("https://example.org/"), F.lpad("i", 6, "0")), "nulls": F.when(F.col("i") % 3 == 0, F.col("i"))}[kind]
    df = spark.range(n).withColumnRenamed("id", "i").withColumn("x", value)
    dealt, total = ranking.leveled(df, "level", ["x"], tie="i", rows=rows)
    assert total == n and dealt.groupBy("level").count().agg(F.max("count")).head()[0] <= 2 * rows
    many = ranking.TREE
    try:
        ranking.TREE = 0
        again, _ = ranking.leveled(df, "level", ["x"], tie="i", rows=rows)
        assert dealt.join(again.select("i", F.col("level").alias("other")), "i").filter("level != other").isEmpty()
        down, _ = ranking.leveled(df, "level", ["x"], ["x"], tie="i", rows=rows)
        assert down.groupBy("level").count().agg(F.max("count")).head()[0] <= 2 * rows
    finally:
        ranking.TREE = many
    key = lambda r: (r.x is not None, r.x or 0 if kind != "prefix" else r.x, r.i)
    got = dense_pos(df, "x", tie="i", rows=rows).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(n)) and [r.i for r in got] == [r.i for r in sorted(got, key=key)]


def test_more_buckets_than_the_driver_takes(spark, monkeypatch):
    monkeypatch.setattr(ranking, "MOST", 4)
    s = spark.range(1000).select(F.col("id").alias("pos"), (F.col("id") % 7).alias("v"))
    assert values(running(s, F.col("v"), "sum", "r", bucket=1), "r") == list(itertools.accumulate(i % 7 for i in range(1000)))
    assert values(ranking.compact(s.filter("v = 3"), bucket=1)) == [3] * 143


def test_columns_with_clashing_names(spark):
    s = spark.createDataFrame([(i, (i * 7) % 5, i, i, i, i, i) for i in range(9)], "pos long, v long, _b long, _old long, _key long, _level long, `_r.x` long")
    for df in (so.sort(s), so.partial_sort(s, 3), so.nth_element(s, 4), re.unique(s), re.stable_partition(s, lambda v: v > 2), re.copy_if(s, lambda v: v > 1), ag.inclusive_scan(s), ag.adjacent_difference(s)):
        assert sorted(df.columns) == sorted(s.columns)
        for r in df.collect():
            assert r["_b"] == r["_old"] == r["_key"] == r["_level"] == r["_r.x"]


def test_nulls_and_not_a_number(spark):
    s = seq(spark, [5, None, None, 1])
    assert values(so.nth_element(s, 1)) == [None, None, 5, 1] and values(so.sort(s)) == [None, None, 1, 5]
    q = seq(spark, [None, 1, 2, 9])
    assert values(ag.lower_bound(s, q), "result") == [0, 2, 3, 4] and values(ag.upper_bound(s, q), "result") == [2, 3, 3, 4]
    assert values(ag.binary_search(s, q), "result") == [True, True, False, False]
    x = spark.createDataFrame([(0, float("nan")), (1, 2.0), (2, None), (3, -0.0)], "pos long, v double")
    assert [str(v) for v in values(so.sort(x))] == ["None", "-0.0", "2.0", "nan"]


def test_operations_by_name(spark):
    flags = spark.createDataFrame([(0, False), (1, True), (2, False)], "pos long, v boolean")
    assert values(ag.exclusive_scan(flags, False, "logical_or")) == [False, False, True]
    assert values(ag.inclusive_scan(flags, "logical_and")) == [False, False, False]
    with pytest.raises(ValueError):
        ag.exclusive_scan(flags, False, "xor")
    big = seq(spark, [94906267, 94906267])
    assert one(ag.reduce(big, 1, "multiplies")) == 94906267**2 and values(ag.inclusive_scan(big, "multiplies")) == [94906267, 94906267**2]
    runs = seq(spark, [94906267, 94906267, 3], k=[1, 1, 2])
    assert [r.v for r in ag.reduce_by_segment(runs, "multiplies").orderBy("pos").collect()] == [94906267**2, 3]


@CASES
@given(a=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 9)), max_size=30))
def test_operations_of_the_caller_by_segment(spark, a):
    s = seq(spark, [v for _, v in a], k=[k for k, _ in a])
    op = lambda x, y: max(x, y)
    runs = [[v for _, v in g] for _, g in itertools.groupby(a, key=lambda r: r[0])]
    assert [r.v for r in ag.reduce_by_segment(s, op).orderBy("pos").collect()] == [max(g) for g in runs]
    assert values(ag.inclusive_scan_by_segment(s, op)) == [x for g in runs for x in itertools.accumulate(g, max)]
    assert values(ag.exclusive_scan_by_segment(s, 4, op)) == [x for g in runs for x in list(itertools.accumulate(g, max, initial=4))[:-1]]
    for bucket in (1, 2, 5):
        assert values(segment_scan(s, "k", F.col("v"), "sum", "r", bucket=bucket), "r") == [x for g in runs for x in itertools.accumulate(g)]
        assert values(scan_with(s, "v", op, None, "r", key="k", bucket=bucket), "r") == [x for g in runs for x in itertools.accumulate(g, max)]


@CASES
@given(a=NUMBERS, n=st.integers(0, 40))
def test_orders_of_the_caller(spark, a, n):
    s, by = seq(spark, a), lambda v: [v % 3, v]
    order = lambda i: (-(a[i] % 3), a[i], i)
    want = [a[i] for i in sorted(range(len(a)), key=order)]
    assert values(so.sort(s, [True, False], by=by)) == want
    assert values(so.partial_sort_copy(s, n, [True, False], by)) == want[:n]
    front = sorted(range(len(a)), key=order)[:n]
    assert values(so.partial_sort(s, n, [True, False], by)) == [a[i] for i in front] + [x for i, x in enumerate(a) if i not in front]
    if n < len(a):
        assert one(so.nth_value(s, n, [True, False], by)) == want[n] and values(so.nth_element(s, n, [True, False], by))[n] == want[n]
    pattern = a[1:3] or [9]
    assert one(se.search(s, seq(spark, pattern))) == one(se.search(s, pattern)) and one(se.find_end(s, seq(spark, pattern))) == one(se.find_end(s, pattern))


def test_views(spark):
    s = seq(spark, [4, 5, 6])
    assert values(src.permuted(s, seq(spark, [2, 0, 2]))) == [6, 4, 6]
    assert values(src.padded_front(s, 2)) == [4, 4, 4, 5, 6]
    assert [tuple(r) for r in src.zipped(s, re.reverse(s)).orderBy("pos").collect()] == [(0, 4, 6), (1, 5, 5), (2, 6, 4)]


def test_futures(spark):
    s = seq(spark, [1, 2, 3])
    a = asy.transform_async(s, lambda v: v * 2)
    b = asy.reduce_async(s, 10, "plus", a)
    asy.wait_for_all(a, b)
    assert values(a.get()) == [2, 4, 6] and b.get() == 16 and b.done()


def test_selection():
    rr = sel.RoundRobin(["a", "b", "c"])
    assert [sel.submit_and_wait(rr, lambda r: r) for _ in range(4)] == ["a", "b", "c", "a"]
    assert sel.submit_and_wait(sel.FixedResource(["a", "b"], 1), lambda r: r) == "b"
    load, gate = sel.DynamicLoad(["a", "b"]), threading.Event()
    first = sel.submit(load, lambda r: (gate.wait(5), r)[1])
    assert [sel.submit_and_wait(load, lambda r: r) for _ in range(2)] == ["b", "b"]
    gate.set()
    assert first.wait() == "a" and sel.get_submission_group(load).wait() is not None
    tune = sel.AutoTune(["slow", "fast"])
    work = lambda r: threading.Event().wait(0.05 if r == "slow" else 0.0) or r
    assert [sel.submit_and_wait(tune, work) for _ in range(4)] == ["slow", "fast", "fast", "fast"]
    chosen = sel.select(rr)
    assert sel.unwrap(chosen) in sel.get_resources(rr) and sel.wait(sel.submit(chosen, lambda r: r)) == chosen.unwrap()
