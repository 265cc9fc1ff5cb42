"""Queries on part keys of every order line against brute force on a small table."""

import datetime
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from seqframe import registry


@pytest.fixture(scope="module")
def halves(tmp_path_factory):
    """Quantities of 1 to 50; parts 0 to 39, of which no line asks for the last ten."""
    d = tmp_path_factory.mktemp("whole")
    n = 300
    keys, quantities = [i * i * 7 % 31 % 30 for i in range(n)], [float(i % 50 + 1) for i in range(n)]
    dates = [datetime.datetime(1997 if i % 3 else 1999, 5, 1) for i in range(n)]
    pq.write_table(pa.table({"l_partkey": pa.array(keys, pa.int64()), "l_quantity": quantities, "l_shipdate": pa.array(dates, pa.timestamp("us"))}), d / "lineitem.parquet")
    pq.write_table(pa.table({"p_partkey": pa.array(range(40), pa.int64())}), d / "part.parquet")
    return str(d), sorted(k for i, k in enumerate(keys) if i % 3), sorted(k for i, k in enumerate(keys) if not i % 3)


def rows(spark, d, name, value="v"):
    got = sorted((r.pos, r[value]) for r in registry.QUERIES[name](spark, d).collect())
    assert [p for p, _ in got] == list(range(len(got)))
    return [v for _, v in got]


def test_multisets_of_every_line(spark, halves):
    d, a, b = halves
    x, y = Counter(a), Counter(b)
    spread = lambda c: sorted(c.elements())
    assert rows(spark, d, "merge") == sorted(a + b) and rows(spark, d, "merge_limited") == sorted(a + b)[:100]
    assert rows(spark, d, "set_union") == spread(x | y) and rows(spark, d, "set_intersection") == spread(x & y)
    assert rows(spark, d, "set_difference") == spread(x - y) and rows(spark, d, "set_symmetric_difference") == spread((x - y) + (y - x))
    assert registry.QUERIES["includes"](spark, d).head().result
    assert registry.QUERIES["includes_not"](spark, d).head().result == (not y - x)


def test_bounds_of_every_part(spark, halves):
    d, a, _ = halves
    assert rows(spark, d, "lower_bound", "result") == [bisect_left(a, k) for k in range(40)]
    assert rows(spark, d, "upper_bound", "result") == [bisect_right(a, k) for k in range(40)]
    assert rows(spark, d, "binary_search", "result") == [k in set(a) for k in range(40)]


def test_halves_make_up_the_table(spark, sf):
    early, late, lines = (registry.part_keys(spark, sf, test).count() for test in (registry.EARLY, registry.LATE, "true"))
    assert early + late == lines and min(early, late) > lines / 3
