"""Queries over the driver's tables, one for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import functors as fn
from .operators import aggregate as ag
from .operators import kernels, loops, memory
from .plans import policy
from .operators import rearrange as re
from .operators import search as se
from .operators import sorting as so
from .sources import sequences as src
from .streaming import async_ as asy
from .streaming import selection as sel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# ---------------------------------------------------------------- sequences


def _cents(name: str) -> Column:
    return F.floor(F.col(name) * 100 + 0.5).cast("long")


def orders(spark: SparkSession, d: str, **columns: Column) -> DataFrame:
    """Order prices in cents, by order key."""
    return src.read_parquet(spark, f"{d}/orders.parquet", "o_orderkey", columns=columns or {"v": _cents("o_totalprice")})


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Quantities of order lines by the six columns that are unique together."""
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return src.read_parquet(spark, f"{d}/lineitem.parquet", *keys, columns={"v": F.col("l_quantity").cast("long")})


def events(spark: SparkSession, d: str) -> DataFrame:
    """Event types as keys and values in cents, by event id."""
    return src.read_parquet(spark, f"{d}/events.parquet", "event_id", columns={"k": F.col("event_type"), "v": _cents("value")})


def prices(spark: SparkSession, d: str) -> DataFrame:
    """The values of `orders` for operators that no order matters to: a scan of one column, no exchange."""
    return spark.read.parquet(f"{d}/orders.parquet").select(_cents("o_totalprice").alias("v"))


def quantities(spark: SparkSession, d: str) -> DataFrame:
    """The values of `lines`, without positions."""
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_quantity").cast("long").alias("v"))


def part_keys(spark: SparkSession, d: str, test: str) -> DataFrame:
    """Part keys of the order lines that pass ``test``, without positions."""
    return spark.read.parquet(f"{d}/lineitem.parquet").filter(test).select(F.col("l_partkey").alias("v"))


def parts(spark: SparkSession, d: str, test: str) -> DataFrame:
    """The same as a sorted sequence."""
    return src.sequence(part_keys(spark, d, test), "v", columns={"v": F.col("v")})


# ship dates run from 1995-01-02 to 2001-11-04: the split is near their median
EARLY, LATE = "l_shipdate < TIMESTAMP '1998-06-01'", "l_shipdate >= TIMESTAMP '1998-06-01'"

O = "o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS v FROM orders)"  # noqa: E741
L = (
    "l AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS pos,"
    " CAST(l_quantity AS BIGINT) AS v FROM lineitem)"
)
E = "e AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, event_type AS k, CAST(floor(value * 100 + 0.5) AS BIGINT) AS v FROM events)"
P = f"a AS (SELECT l_partkey AS v FROM lineitem WHERE {EARLY}), b AS (SELECT l_partkey AS v FROM lineitem WHERE {LATE})"


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def on_orders(name: str, op: Callable[[DataFrame], DataFrame], sql: str) -> None:
    add(name, lambda s, d: op(orders(s, d)), f"WITH {O} {sql}")


def on_prices(name: str, op: Callable[[DataFrame], DataFrame], sql: str) -> None:
    add(name, lambda s, d: op(prices(s, d)), f"WITH {O} {sql}")


def on_quantities(name: str, op: Callable[[DataFrame], DataFrame], sql: str) -> None:
    add(name, lambda s, d: op(quantities(s, d)), f"WITH {L} {sql}")


def on_lines(name: str, op: Callable[[DataFrame], DataFrame], sql: str) -> None:
    add(name, lambda s, d: op(lines(s, d)), f"WITH {L} {sql}")


def on_events(name: str, op: Callable[[DataFrame], DataFrame], sql: str) -> None:
    add(name, lambda s, d: op(events(s, d)), f"WITH {E} {sql}")


ISLANDS = (
    f"{E}, f AS (SELECT *, CASE WHEN k = lag(k) OVER (ORDER BY pos) THEN 0 ELSE 1 END AS new FROM e),"
    " g AS (SELECT *, sum(new) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM f)"
)

# flagship
add(
    "reduce_by_segment",
    lambda s, d: ag.reduce_by_segment(events(s, d)),
    f"WITH {ISLANDS} SELECT CAST(island - 1 AS BIGINT) AS pos, min(k) AS k, CAST(sum(v) AS BIGINT) AS v FROM g GROUP BY island",
)

# ---------------------------------------------------------------- search

BIG = 50_000_00
FIRST = "SELECT coalesce(min(pos) FILTER (WHERE {}), count(*)) AS result FROM {}"
on_prices("any_of", lambda s: se.any_of(s, lambda v: v > BIG), f"SELECT coalesce(bool_or(v > {BIG}), false) AS result FROM o")
on_prices("all_of", lambda s: se.all_of(s, lambda v: v > 0), "SELECT coalesce(bool_and(v > 0), true) AS result FROM o")
on_prices("none_of", lambda s: se.none_of(s, lambda v: v < 0), "SELECT NOT coalesce(bool_or(v < 0), false) AS result FROM o")
on_prices("any_of_empty", lambda s: se.any_of(s.filter("false"), lambda v: v > 0), "SELECT false AS result")
on_prices("all_of_empty", lambda s: se.all_of(s.filter("false"), lambda v: v > 0), "SELECT true AS result")
on_orders("for_each", lambda s: se.for_each(s, lambda v: v * 2 + 1), "SELECT pos, v * 2 + 1 AS v FROM o")
on_orders("for_each_n", lambda s: se.for_each_n(s, 100, lambda v: -v), "SELECT pos, CASE WHEN pos < 100 THEN -v ELSE v END AS v FROM o")
on_lines("find_if", lambda s: se.find_if(s, lambda v: v > 49), FIRST.format("v > 49", "l"))
on_lines("find_if_not", lambda s: se.find_if_not(s, lambda v: v < 50), FIRST.format("NOT v < 50", "l"))
on_lines("find", lambda s: se.find(s, 50), FIRST.format("v = 50", "l"))
on_lines("find_absent", lambda s: se.find(s, 51), FIRST.format("v = 51", "l"))
on_lines("find_first_of", lambda s: se.find_first_of(s, [48, 49, 77]), FIRST.format("v IN (48, 49, 77)", "l"))
on_lines("find_first_of_frame", lambda s: se.find_first_of_frame(s, s.sparkSession.createDataFrame([(47,), (50,)], "v long")), FIRST.format("v IN (47, 50)", "l"))
on_lines("adjacent_find", se.adjacent_find, "SELECT coalesce(min(pos) FILTER (WHERE v = n), count(*)) AS result FROM (SELECT pos, v, lead(v) OVER (ORDER BY pos) AS n FROM l)")
on_quantities("count", lambda s: se.count(s, 7), "SELECT count(*) FILTER (WHERE v = 7) AS result FROM l")
on_quantities("count_if", lambda s: se.count_if(s, lambda v: v % 2 == 0), "SELECT count(*) FILTER (WHERE v % 2 = 0) AS result FROM l")
NEXT = "SELECT pos, v, lead(v) OVER (ORDER BY pos) AS v1, lead(v, 2) OVER (ORDER BY pos) AS v2 FROM l"
on_lines("search", lambda s: se.search(s, [7, 7]), f"SELECT coalesce(min(pos) FILTER (WHERE v = 7 AND v1 = 7), count(*)) AS result FROM ({NEXT})")
on_lines("search_empty", lambda s: se.search(s, []), "SELECT CAST(0 AS BIGINT) AS result")
on_lines("find_end", lambda s: se.find_end(s, [7, 8]), f"SELECT coalesce(max(pos) FILTER (WHERE v = 7 AND v1 = 8), count(*)) AS result FROM ({NEXT})")
on_lines("search_n", lambda s: se.search_n(s, 3, 40, lambda v, x: v >= x), f"SELECT coalesce(min(pos) FILTER (WHERE v >= 40 AND v1 >= 40 AND v2 >= 40), count(*)) AS result FROM ({NEXT})")
HALVES = f"{O}, x AS (SELECT pos, v // 100000000 AS v FROM o), y AS (SELECT pos, CASE WHEN pos = 300 THEN -1 ELSE v // 100000000 END AS v FROM o)"


def _pair(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = orders(s, d).withColumn("v", F.floor(F.col("v") / 100_000_000))
    return a, a.withColumn("v", F.when(F.col("pos") == 300, -1).otherwise(F.col("v")))


add("mismatch", lambda s, d: se.mismatch(*_pair(s, d)), f"WITH {HALVES} SELECT coalesce(min(pos) FILTER (WHERE x.v <> y.v), count(*)) AS result FROM x JOIN y USING (pos)")
add("equal", lambda s, d: se.equal(*_pair(s, d)), f"WITH {HALVES} SELECT bool_and(x.v = y.v) AS result FROM x JOIN y USING (pos)")
add("equal_empty", lambda s, d: se.equal(*[x.filter("false") for x in _pair(s, d)]), "SELECT true AS result")
add("lexicographical_compare", lambda s, d: se.lexicographical_compare(*reversed(_pair(s, d))), f"WITH {HALVES} SELECT arg_min(y.v < x.v, pos) AS result FROM x JOIN y USING (pos) WHERE x.v <> y.v")
LAGGED = "(SELECT pos, v, lag(v) OVER (ORDER BY pos) AS p FROM o)"
on_orders("is_sorted", se.is_sorted, f"SELECT coalesce(bool_and(p IS NULL OR NOT v < p), true) AS result FROM {LAGGED}")
on_orders("is_sorted_until", se.is_sorted_until, FIRST.format("v < p", LAGGED))
on_orders("is_partitioned", lambda s: se.is_partitioned(s.withColumn("v", F.col("pos")), lambda v: v < 100), "SELECT coalesce(max(pos) FILTER (WHERE pos < 100) < min(pos) FILTER (WHERE NOT pos < 100), true) AS result FROM o")
HEAP = "(SELECT c.pos, c.v, p.v AS p FROM o c LEFT JOIN o p ON c.pos > 0 AND p.pos = (c.pos - 1) // 2)"
on_orders("is_heap_until", se.is_heap_until, FIRST.format("p < v", HEAP))
on_orders("is_heap", lambda s: se.is_heap(s.withColumn("v", -F.col("pos"))), "SELECT true AS result")
add("includes", lambda s, d: se.includes(part_keys(s, d, "true"), part_keys(s, d, EARLY)), f"WITH {P} SELECT NOT EXISTS (SELECT v FROM a EXCEPT ALL SELECT l_partkey FROM lineitem) AS result")
add("includes_not", lambda s, d: se.includes(part_keys(s, d, EARLY), part_keys(s, d, LATE)), f"WITH {P} SELECT NOT EXISTS (SELECT v FROM b EXCEPT ALL SELECT v FROM a) AS result")

# ---------------------------------------------------------------- copies, maps, re-orderings

KEEP = "SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, v FROM {} WHERE {}"
on_orders("copy", re.copy, "SELECT pos, v FROM o")
on_orders("move", re.move, "SELECT pos, v FROM o")
on_orders("copy_n", lambda s: re.copy_n(s, 25), "SELECT pos, v FROM o WHERE pos < 25")
on_lines("copy_if", lambda s: re.copy_if(s, lambda v: v % 3 == 0), KEEP.format("l", "v % 3 = 0"))
on_orders("swap_ranges", lambda s: re.swap_ranges(s, s.withColumn("v", -F.col("v"))), "SELECT pos, -v AS a, v AS b FROM o")
on_orders("transform", lambda s: re.transform(s, lambda v: v % 1000), "SELECT pos, v % 1000 AS v FROM o")
on_orders("transform_binary", lambda s: re.transform_binary(s, s.withColumn("v", F.col("pos")), fn.plus), "SELECT pos, v + pos AS v FROM o")
on_orders("transform_if", lambda s: re.transform_if(s, s.withColumn("v", F.col("pos")), lambda v: -v, lambda v: v % 2 == 0), "SELECT pos, CASE WHEN v % 2 = 0 THEN -v ELSE pos END AS v FROM o")
on_orders(
    "transform_if_binary",
    lambda s: re.transform_if_binary(s, s.withColumn("v", F.col("pos")), s.withColumn("v", F.lit(7).cast("long")), fn.minus, lambda a, b: a % 2 == 0),
    "SELECT pos, CASE WHEN v % 2 = 0 THEN v - pos ELSE 7 END AS v FROM o",
)
for _name, _op in (("replace", re.replace), ("replace_copy", re.replace_copy)):
    on_lines(_name, lambda s, f=_op: f(s, 7, 70), "SELECT pos, CASE WHEN v = 7 THEN 70 ELSE v END AS v FROM l")
for _name, _op in (("replace_if", re.replace_if), ("replace_copy_if", re.replace_copy_if)):
    on_lines(_name, lambda s, f=_op: f(s, lambda v: v > 40, 0), "SELECT pos, CASE WHEN v > 40 THEN 0 ELSE v END AS v FROM l")
on_orders("fill", lambda s: re.fill(s, 5), "SELECT pos, CAST(5 AS BIGINT) AS v FROM o")
on_orders("fill_n", lambda s: re.fill_n(s, 10, 5), "SELECT pos, CASE WHEN pos < 10 THEN 5 ELSE v END AS v FROM o")
on_orders("generate", lambda s: re.generate(s, lambda: F.col("pos") * F.col("pos")), "SELECT pos, pos * pos AS v FROM o")
add("generate_n", lambda s, d: re.generate_n(s, 1000, lambda: F.col("pos") % 7), "SELECT range AS pos, range % 7 AS v FROM range(1000)")
for _name, _op in (("remove", re.remove), ("remove_copy", re.remove_copy)):
    on_lines(_name, lambda s, f=_op: f(s, 7), KEEP.format("l", "v <> 7"))
for _name, _op in (("remove_if", re.remove_if), ("remove_copy_if", re.remove_copy_if)):
    on_lines(_name, lambda s, f=_op: f(s, lambda v: v < 25), KEEP.format("l", "NOT v < 25"))
UNIQUE = "(SELECT pos, v, lag(v) OVER (ORDER BY pos) AS p FROM l)"
for _name, _op in (("unique", re.unique), ("unique_copy", re.unique_copy)):
    on_lines(_name, lambda s, f=_op: f(s), KEEP.format(UNIQUE, "p IS NULL OR v <> p"))
for _name in ("reverse", "reverse_copy"):
    on_orders(_name, re.reverse, "SELECT (SELECT count(*) FROM o) - 1 - pos AS pos, v FROM o")
for _name in ("rotate", "rotate_copy"):
    on_orders(_name, lambda s: re.rotate(s, 100), "SELECT (pos - 100 + n) % n AS pos, v FROM o, (SELECT count(*) AS n FROM o)")
on_orders("shift_left", lambda s: re.shift_left(s, 30), "SELECT pos - 30 AS pos, v FROM o WHERE pos >= 30")
on_orders("shift_left_none", lambda s: re.shift_left(s, -1), "SELECT pos, v FROM o")
on_orders("shift_right", lambda s: re.shift_right(s, 30), "SELECT pos + 30 AS pos, v FROM o WHERE pos < (SELECT count(*) FROM o) - 30")
for _name, _op in (("partition", re.partition), ("stable_partition", re.stable_partition)):
    on_lines(_name, lambda s, f=_op: f(s, lambda v: v > 30), "SELECT row_number() OVER (ORDER BY v <= 30, pos) - 1 AS pos, v FROM l")
on_quantities("partition_point", lambda s: re.partition_point(s, lambda v: v > 30), "SELECT count(*) FILTER (WHERE v > 30) AS result FROM l")
on_lines("partition_copy_true", lambda s: re.partition_copy(s, lambda v: v > 30)[0], KEEP.format("l", "v > 30"))
on_lines("partition_copy_false", lambda s: re.partition_copy(s, lambda v: v > 30)[1], KEEP.format("l", "NOT v > 30"))

# ---------------------------------------------------------------- sorts, selections, merges

SORTED = "SELECT row_number() OVER (ORDER BY v{}, pos) - 1 AS pos, v FROM {}"
for _name, _op in (("sort", so.sort), ("stable_sort", so.stable_sort), ("inplace_merge", so.inplace_merge)):
    on_lines(_name, lambda s, f=_op: f(s), SORTED.format("", "l"))
on_orders("sort_descending", lambda s: so.sort(s, descending=True), SORTED.format(" DESC", "o"))
on_lines("radix_sort", kernels.radix_sort, SORTED.format("", "l"))
BY_KEY = "SELECT row_number() OVER (ORDER BY k, pos) - 1 AS pos, k, v FROM e"
for _name, _op in (("sort_by_key", so.sort_by_key), ("stable_sort_by_key", so.stable_sort_by_key)):
    on_events(_name, lambda s, f=_op: f(s), BY_KEY)
on_events("radix_sort_by_key", lambda s: kernels.radix_sort_by_key(s.withColumn("k", F.length("k"))), "SELECT row_number() OVER (ORDER BY length(k), pos) - 1 AS pos, CAST(length(k) AS INTEGER) AS k, v FROM e")
on_orders(
    "partial_sort",
    lambda s: so.partial_sort(s, 50),
    "SELECT row_number() OVER (ORDER BY r >= 50, CASE WHEN r < 50 THEN r ELSE pos END) - 1 AS pos, v FROM (SELECT pos, v, row_number() OVER (ORDER BY v, pos) - 1 AS r FROM o)",
)
on_orders("partial_sort_copy", lambda s: so.partial_sort_copy(s, 50), "SELECT * FROM (SELECT row_number() OVER (ORDER BY v, pos) - 1 AS pos, v FROM o) WHERE pos < 50")
on_lines("nth_element", lambda s: so.nth_value(s, 1000), "SELECT v AS result FROM l ORDER BY v, pos LIMIT 1 OFFSET 1000")
on_lines(
    "nth_element_rearranged",
    lambda s: so.nth_element(s, 1000),
    "SELECT row_number() OVER (ORDER BY sign(r - 1000), pos) - 1 AS pos, v FROM (SELECT pos, v, row_number() OVER (ORDER BY v, pos) - 1 AS r FROM l)",
)
add("merge", lambda s, d: so.merge(parts(s, d, EARLY), parts(s, d, LATE)), f"WITH {P} SELECT row_number() OVER (ORDER BY v) - 1 AS pos, v FROM (SELECT v FROM a UNION ALL SELECT v FROM b)")
add("merge_limited", lambda s, d: so.merge(parts(s, d, EARLY), parts(s, d, LATE), 100), f"WITH {P} SELECT row_number() OVER (ORDER BY v) - 1 AS pos, v FROM (SELECT v FROM a UNION ALL SELECT v FROM b) QUALIFY pos < 100")
on_lines("min_element", so.min_element, "SELECT arg_min(pos, (v, pos)) AS result, min(v) AS value FROM l")
on_lines("max_element", so.max_element, "SELECT arg_max(pos, (v, -pos)) AS result, max(v) AS value FROM l")
on_lines("minmax_element", so.minmax_element, "SELECT arg_min(pos, (v, pos)) AS min_pos, arg_max(pos, (v, pos)) AS max_pos FROM l")
RANKED = "SELECT row_number() OVER (ORDER BY v) - 1 AS pos, v FROM ({})"
for _name, _op, _sql in (
    ("set_union", so.set_union, "SELECT v FROM a UNION ALL (SELECT v FROM b EXCEPT ALL SELECT v FROM a)"),
    ("set_intersection", so.set_intersection, "SELECT v FROM a INTERSECT ALL SELECT v FROM b"),
    ("set_difference", so.set_difference, "SELECT v FROM a EXCEPT ALL SELECT v FROM b"),
    ("set_symmetric_difference", so.set_symmetric_difference, "(SELECT v FROM a EXCEPT ALL SELECT v FROM b) UNION ALL (SELECT v FROM b EXCEPT ALL SELECT v FROM a)"),
):
    add(_name, lambda s, d, f=_op: f(part_keys(s, d, EARLY), part_keys(s, d, LATE)), f"WITH {P} " + RANKED.format(_sql))

# ---------------------------------------------------------------- reductions and scans

on_prices("reduce", lambda s: ag.reduce(s, 10), "SELECT CAST(10 + sum(v) AS BIGINT) AS result FROM o")
on_prices("reduce_min", lambda s: ag.reduce(s, 999_999_999, "minimum"), "SELECT least(999999999, min(v)) AS result FROM o")
on_prices("reduce_xor", lambda s: ag.reduce(s, 0, "bit_xor"), "SELECT bit_xor(v) AS result FROM o")
on_prices("reduce_custom", lambda s: ag.reduce(s, 0, lambda a, b: max(a, b)), "SELECT max(v) AS result FROM o")
on_prices("reduce_empty", lambda s: ag.reduce(s.filter("false"), 42), "SELECT CAST(42 AS BIGINT) AS result")
on_prices("transform_reduce", lambda s: ag.transform_reduce(s, 0, "plus", lambda v: v % 10), "SELECT CAST(sum(v % 10) AS BIGINT) AS result FROM o")
on_orders("inner_product", lambda s: ag.inner_product(s, s.withColumn("v", F.col("pos"))), "SELECT CAST(sum(v * pos) AS BIGINT) AS result FROM o")
SCAN = "SELECT pos, CAST({} OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND {}) AS BIGINT) AS v FROM o"
on_orders("inclusive_scan", ag.inclusive_scan, SCAN.format("sum(v)", "CURRENT ROW"))
on_orders("inclusive_scan_init", lambda s: ag.inclusive_scan(s, "plus", 100), f"SELECT pos, v + 100 AS v FROM ({SCAN.format('sum(v)', 'CURRENT ROW')})")
on_orders("inclusive_scan_max", lambda s: ag.inclusive_scan(s, "maximum"), SCAN.format("max(v)", "CURRENT ROW"))
on_orders("inclusive_scan_custom", lambda s: ag.inclusive_scan(s, lambda a, b: max(a, b)), SCAN.format("max(v)", "CURRENT ROW"))
on_orders("exclusive_scan", lambda s: ag.exclusive_scan(s, 5), f"SELECT pos, coalesce(v, 0) + 5 AS v FROM ({SCAN.format('sum(v)', '1 PRECEDING')})")
on_orders("exclusive_scan_min", lambda s: ag.exclusive_scan(s, 999_999_999, "minimum"), f"SELECT pos, least(coalesce(v, 999999999), 999999999) AS v FROM ({SCAN.format('min(v)', '1 PRECEDING')})")
on_orders("transform_inclusive_scan", lambda s: ag.transform_inclusive_scan(s, "plus", lambda v: v % 7), SCAN.format("sum(v % 7)", "CURRENT ROW"))
on_orders("transform_exclusive_scan", lambda s: ag.transform_exclusive_scan(s, 3, "plus", lambda v: v % 7), f"SELECT pos, coalesce(v, 0) + 3 AS v FROM ({SCAN.format('sum(v % 7)', '1 PRECEDING')})")
on_orders("single_pass_inclusive_scan", kernels.single_pass_inclusive_scan, SCAN.format("sum(v)", "CURRENT ROW"))
on_orders("adjacent_difference", ag.adjacent_difference, "SELECT pos, v - coalesce(lag(v) OVER (ORDER BY pos), 0) AS v FROM o")

# ---------------------------------------------------------------- runs, histograms, bounds

add("reduce_by_segment_max", lambda s, d: ag.reduce_by_segment(events(s, d), "maximum"), f"WITH {ISLANDS} SELECT CAST(island - 1 AS BIGINT) AS pos, min(k) AS k, max(v) AS v FROM g GROUP BY island")
BY_RUN = "CAST({} OVER (PARTITION BY island ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND {}) AS BIGINT)"
for _name in ("inclusive_scan_by_segment", "inclusive_scan_by_key"):
    add(_name, lambda s, d: ag.inclusive_scan_by_segment(events(s, d)), f"WITH {ISLANDS} SELECT pos, k, {BY_RUN.format('sum(v)', 'CURRENT ROW')} AS v FROM g")
for _name in ("exclusive_scan_by_segment", "exclusive_scan_by_key"):
    add(_name, lambda s, d: ag.exclusive_scan_by_segment(events(s, d), 4), f"WITH {ISLANDS} SELECT pos, k, 4 + coalesce({BY_RUN.format('sum(v)', '1 PRECEDING')}, 0) AS v FROM g")
add("reduce_by_key", QUERIES["reduce_by_segment"], ORACLE["reduce_by_segment"])
on_quantities("histogram", lambda s: ag.histogram(s, 7, 5, 40), "SELECT range AS bin, (SELECT count(*) FROM l WHERE v >= 5 AND v < 40 AND (v - 5) * 7 // 35 = range) AS n FROM range(7)")
on_quantities("histogram_floating", lambda s: ag.histogram(s.withColumn("v", F.col("v") / 2.0), 8, 2.0, 18.0), "SELECT range AS bin, (SELECT count(*) FROM l WHERE v / 2.0 >= 2 AND v / 2.0 < 18 AND floor((v / 2.0 - 2) * 0.5) = range) AS n FROM range(8)")
on_quantities(
    "histogram_bounds",
    lambda s: ag.histogram_bounds(s, [-1, 0, 8, 12, 30, 31]),
    "SELECT CAST(i AS BIGINT) AS bin, (SELECT count(*) FROM l WHERE v >= lo AND v < hi) AS n FROM (VALUES (0, -1, 0), (1, 0, 8), (2, 8, 12), (3, 12, 30), (4, 30, 31)) t(i, lo, hi)",
)


def _every_part(s: SparkSession, d: str) -> DataFrame:
    """Needles that grow with the tables: the key of every part."""
    return src.read_parquet(s, f"{d}/part.parquet", "p_partkey", columns={"v": F.col("p_partkey")})


# counts up to each value by one running sum; a correlated count is too slow for so many needles
UP_TO = (
    f"{P}, q AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_partkey AS v FROM part),"
    " r AS (SELECT v, sum(n) AS same, sum(sum(n)) OVER (ORDER BY v) AS upto FROM (SELECT v, 1 AS n FROM a UNION ALL SELECT DISTINCT v, 0 FROM q) GROUP BY v)"
)
for _name, _op, _sql in (
    ("lower_bound", ag.lower_bound, "CAST(upto - same AS BIGINT)"),
    ("upper_bound", ag.upper_bound, "CAST(upto AS BIGINT)"),
    ("binary_search", ag.binary_search, "same > 0"),
):
    add(_name, lambda s, d, f=_op: f(part_keys(s, d, EARLY), _every_part(s, d)), f"WITH {UP_TO} SELECT pos, v, {_sql} AS result FROM q JOIN r USING (v)")

# ---------------------------------------------------------------- sources and views

add("counting", lambda s, d: src.counting(s, 500, 7), "SELECT range AS pos, range + 7 AS v FROM range(500)")
add("iota_view", lambda s, d: src.iota(s, 100), "SELECT range AS pos, range AS v FROM range(100)")
add("fill_view", lambda s, d: src.filled(s, 100, 3), "SELECT range AS pos, 3 AS v FROM range(100)")
add("generate_view", lambda s, d: src.generated(s, 100, lambda i: i * 2), "SELECT range AS pos, range * 2 AS v FROM range(100)")
on_orders("zip", lambda s: src.zipped(s, re.reverse(s)), "SELECT o.pos, o.v AS v0, r.v AS v1 FROM o JOIN (SELECT (SELECT count(*) FROM o) - 1 - pos AS pos, v FROM o) r USING (pos)")
on_orders("transform_view", lambda s: src.mapped(s, lambda v: v + 1), "SELECT pos, v + 1 AS v FROM o")
on_orders("permutation", lambda s: src.permuted(s, src.counting(s.sparkSession, 100, 50)), "SELECT pos - 50 AS pos, v FROM o WHERE pos BETWEEN 50 AND 149")
on_orders("permutation_function", lambda s: src.permuted(s, lambda i: F.floor(i / 2)), "SELECT x.pos, o.v FROM o x JOIN o ON o.pos = x.pos // 2")
on_events("discard", lambda s: src.discarded(s, "v"), "SELECT pos, k FROM e")
on_orders("all_view", src.all_view, "SELECT pos, v FROM o")
on_orders("take_view", lambda s: src.take(s, 12), "SELECT pos, v FROM o WHERE pos < 12")
on_orders("drop_view", lambda s: src.drop(s, 12), "SELECT pos - 12 AS pos, v FROM o WHERE pos >= 12")
on_orders("guard_view", lambda s: src.guarded(s, 12), "SELECT pos, v FROM o WHERE pos < 12")
on_orders("padded_front_view", lambda s: src.padded_front(s, 3), "SELECT pos + 3 AS pos, v FROM o UNION ALL SELECT range, (SELECT v FROM o WHERE pos = 0) FROM range(3)")
on_orders("reverse_view", re.reverse, "SELECT (SELECT count(*) FROM o) - 1 - pos AS pos, v FROM o")
on_orders("rotate_view", lambda s: re.rotate(s, 9), "SELECT (pos - 9 + n) % n AS pos, v FROM o, (SELECT count(*) AS n FROM o)")
add("buffer_begin_end", lambda s, d: src.read_parquet(s, f"{d}/customer.parquet", "c_custkey", columns={"v": F.col("c_name")}), "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_name AS v FROM customer")

# ---------------------------------------------------------------- memory, loops

on_orders("uninitialized_copy", memory.uninitialized_copy, "SELECT pos, v FROM o")
on_orders("uninitialized_copy_n", lambda s: memory.uninitialized_copy_n(s, 9), "SELECT pos, v FROM o WHERE pos < 9")
on_orders("uninitialized_move", memory.uninitialized_move, "SELECT pos, v FROM o")
on_orders("uninitialized_move_n", lambda s: memory.uninitialized_move_n(s, 9), "SELECT pos, v FROM o WHERE pos < 9")
on_orders("uninitialized_fill", lambda s: memory.uninitialized_fill(s, 3), "SELECT pos, CAST(3 AS BIGINT) AS v FROM o")
add("uninitialized_fill_n", lambda s, d: memory.uninitialized_fill_n(s, 9, 3), "SELECT range AS pos, 3 AS v FROM range(9)")
on_orders("destroy", memory.destroy, "SELECT pos, v FROM o WHERE false")
on_orders("destroy_n", lambda s: memory.destroy_n(s, 9), "SELECT pos, v FROM o WHERE pos >= 9")
on_orders("uninitialized_default_construct", memory.uninitialized_default_construct, "SELECT pos, CAST(NULL AS BIGINT) AS v FROM o")
add("uninitialized_default_construct_n", lambda s, d: memory.uninitialized_default_construct_n(s, 9, "long"), "SELECT range AS pos, CAST(NULL AS BIGINT) AS v FROM range(9)")
on_orders("uninitialized_value_construct", memory.uninitialized_value_construct, "SELECT pos, CAST(0 AS BIGINT) AS v FROM o")
add("uninitialized_value_construct_n", lambda s, d: memory.uninitialized_value_construct_n(s, 9, "long"), "SELECT range AS pos, CAST(0 AS BIGINT) AS v FROM range(9)")
add("for_loop", lambda s, d: loops.for_loop(s, 5, 50, induction={"x": loops.Induction(10, 3)}), "SELECT range + 5 AS i, range * 3 + 10 AS x FROM range(45)")
add("for_loop_n", lambda s, d: loops.for_loop_n(s, 5, 45, reductions={"r": loops.reduction_bit_xor(1, lambda i: i * 3)}), "SELECT xor(1, bit_xor((range + 5) * 3)) AS r FROM range(45)")
add(
    "for_loop_strided",
    lambda s, d: loops.for_loop_strided(
        s, 0, 100, 7, induction={"x": loops.Induction(2, 5)}, reductions={"total": loops.reduction_plus(1, lambda i, x: i + x), "low": loops.reduction_min(9, lambda i, x: x), "high": loops.reduction_max(9, lambda i, x: x)}
    ),
    "SELECT CAST(1 + sum(range * 7 + range * 5 + 2) AS BIGINT) AS total, least(9, min(range * 5 + 2)) AS low, greatest(9, max(range * 5 + 2)) AS high FROM range(15)",
)
add("for_loop_n_strided", lambda s, d: loops.for_loop_n_strided(s, 3, 11, 4, reductions={"r": loops.reduction_multiplies(1, lambda i: i % 3 + 1), "o": loops.reduction_bit_or(0, lambda i: i), "a": loops.reduction_bit_and(255, lambda i: i)}), "SELECT CAST(product((range * 4 + 3) % 3 + 1) AS BIGINT) AS r, bit_or(range * 4 + 3) AS o, bit_and(255 & (range * 4 + 3)) AS a FROM range(11)")

# ---------------------------------------------------------------- asynchronous forms, selection


def _value(s: SparkSession, x) -> DataFrame:
    return s.createDataFrame([(x,)], "result long")


for _name, _op in (
    ("copy", lambda s: asy.copy_async(s)),
    ("fill", lambda s: asy.fill_async(s, 5)),
    ("for_each", lambda s: asy.for_each_async(s, lambda v: v * 2 + 1)),
    ("transform", lambda s: asy.transform_async(s, lambda v: v % 1000)),
    ("inclusive_scan", lambda s: asy.inclusive_scan_async(s)),
    ("exclusive_scan", lambda s: asy.exclusive_scan_async(s, 5)),
    ("transform_inclusive_scan", lambda s: asy.transform_inclusive_scan_async(s, "plus", lambda v: v % 7)),
    ("transform_exclusive_scan", lambda s: asy.transform_exclusive_scan_async(s, 3, "plus", lambda v: v % 7)),
):
    add(f"{_name}_async", lambda s, d, f=_op: f(orders(s, d)).get(), ORACLE[_name])
add("sort_async", lambda s, d: asy.sort_async(lines(s, d)).get(), ORACLE["sort"])
add("reduce_async", lambda s, d: _value(s, asy.reduce_async(prices(s, d), 10).get()), ORACLE["reduce"])
add("transform_reduce_async", lambda s, d: _value(s, asy.transform_reduce_async(prices(s, d), 0, "plus", lambda v: v % 10).get()), ORACLE["transform_reduce"])


def _waited(s: SparkSession, d: str) -> DataFrame:
    first = asy.fill_async(orders(s, d), 5)
    then = asy.reduce_async(prices(s, d), 10, "plus", first)
    asy.wait_for_all(first, then)
    return _value(s, then.get())


add("wait_for_all", _waited, ORACLE["reduce"])
for _name, _policy in (("fixed_resource", sel.FixedResource), ("round_robin", sel.RoundRobin), ("dynamic_load", sel.DynamicLoad), ("auto_tune", sel.AutoTune)):
    add(
        f"policy_{_name}",
        lambda s, d, p=_policy: sel.submit_and_wait(p(["a", "b"]), lambda pool: sel.in_pool(s, pool, lambda: ag.reduce(prices(s, d), 10))),
        ORACLE["reduce"],
    )

# ---------------------------------------------------------------- execution policies

for _name in ("seq", "unseq", "par", "par_unseq", "device_policy"):
    add(f"execution_{_name}", lambda s, d, p=getattr(policy, _name): p(re.copy_if, orders(s, d), lambda v: v % 3 == 0), f"WITH {O} " + KEEP.format("o", "v % 3 = 0"))

# ---------------------------------------------------------------- orders and operations of the caller

BY = "row_number() OVER (ORDER BY v % 7 DESC, v // 7, pos)"
_BY = {"by": lambda v: [v % 7, F.floor(v / 7)], "descending": [True, False]}
on_lines("sort_by", lambda s: so.sort(s, **_BY), f"SELECT {BY} - 1 AS pos, v FROM l")
on_lines("sort_by_proj", lambda s: so.stable_sort(s, proj=lambda v: v % 7, descending=True), "SELECT row_number() OVER (ORDER BY v % 7 DESC, pos) - 1 AS pos, v FROM l")
on_lines("partial_sort_by", lambda s: so.partial_sort(s, 500, **_BY), f"SELECT row_number() OVER (ORDER BY r >= 500, CASE WHEN r < 500 THEN r ELSE pos END) - 1 AS pos, v FROM (SELECT pos, v, {BY} - 1 AS r FROM l)")
on_lines("partial_sort_copy_by", lambda s: so.partial_sort_copy(s, 500, [True, False], _BY["by"]), f"SELECT * FROM (SELECT {BY} - 1 AS pos, v FROM l) WHERE pos < 500")
on_lines("nth_element_by", lambda s: so.nth_value(s, 5000, [True, False], _BY["by"]), f"SELECT v AS result FROM (SELECT v, {BY} - 1 AS r FROM l) WHERE r = 5000")
on_lines("min_element_by", lambda s: so.min_element(s, **_BY), f"SELECT pos AS result, v AS value FROM l ORDER BY {BY} LIMIT 1")
on_lines("max_element_by", lambda s: so.max_element(s, **_BY), "SELECT pos AS result, v AS value FROM l ORDER BY v % 7, v // 7 DESC, pos LIMIT 1")
on_lines("inplace_merge_descending", lambda s: so.inplace_merge(s, descending=True), SORTED.format(" DESC", "l"))
add("merge_descending", lambda s, d: so.merge(so.sort(parts(s, d, EARLY), True), so.sort(parts(s, d, LATE), True), descending=True), f"WITH {P} SELECT row_number() OVER (ORDER BY v DESC) - 1 AS pos, v FROM (SELECT v FROM a UNION ALL SELECT v FROM b)")
# elements are equivalent when a tenth of them is equal; those of the first sequence come first
CLASSES = (
    f"{P}, x AS (SELECT row_number() OVER (ORDER BY v) AS i, v, v // 10 AS k, row_number() OVER (PARTITION BY v // 10 ORDER BY v) AS r, 0 AS f FROM a),"
    " y AS (SELECT row_number() OVER (ORDER BY v) AS i, v, v // 10 AS k, row_number() OVER (PARTITION BY v // 10 ORDER BY v) AS r, 1 AS f FROM b),"
    " m AS (SELECT k, count(*) AS n FROM x GROUP BY k), n AS (SELECT k, count(*) AS n FROM y GROUP BY k),"
    " p AS (SELECT x.*, coalesce(n.n, 0) AS o FROM x LEFT JOIN n USING (k)), q AS (SELECT y.*, coalesce(m.n, 0) AS o FROM y LEFT JOIN m USING (k))"
)
for _name, _op, _sql in (
    ("set_union", so.set_union, "SELECT * FROM p UNION ALL SELECT * FROM q WHERE r > o"),
    ("set_intersection", so.set_intersection, "SELECT * FROM p WHERE r <= o"),
    ("set_difference", so.set_difference, "SELECT * FROM p WHERE r > o"),
    ("set_symmetric_difference", so.set_symmetric_difference, "SELECT * FROM p WHERE r > o UNION ALL SELECT * FROM q WHERE r > o"),
):
    add(f"{_name}_by", lambda s, d, f=_op: f(parts(s, d, EARLY), parts(s, d, LATE), by=lambda v: F.floor(v / 10)), f"WITH {CLASSES} SELECT row_number() OVER (ORDER BY k, f, i) - 1 AS pos, v FROM ({_sql})")
add("includes_by", lambda s, d: se.includes(part_keys(s, d, EARLY), part_keys(s, d, LATE), by=lambda v: F.floor(v / 10)), f"WITH {CLASSES} SELECT NOT EXISTS (SELECT k FROM n LEFT JOIN m USING (k) WHERE n.n > coalesce(m.n, 0)) AS result")
add(
    "lower_bound_descending",
    lambda s, d: ag.lower_bound(part_keys(s, d, EARLY), _every_part(s, d), descending=True),
    f"WITH {UP_TO} SELECT pos, v, CAST((SELECT count(*) FROM a) - upto AS BIGINT) AS result FROM q JOIN r USING (v)",
)
add("reduce_by_segment_custom", lambda s, d: ag.reduce_by_segment(events(s, d), lambda a, b: max(a, b)), ORACLE["reduce_by_segment_max"])
add("inclusive_scan_by_segment_custom", lambda s, d: ag.inclusive_scan_by_segment(events(s, d), lambda a, b: min(a, b)), f"WITH {ISLANDS} SELECT pos, k, {BY_RUN.format('min(v)', 'CURRENT ROW')} AS v FROM g")
add("exclusive_scan_by_segment_max", lambda s, d: ag.exclusive_scan_by_segment(events(s, d), 4, "maximum"), f"WITH {ISLANDS} SELECT pos, k, greatest(4, coalesce({BY_RUN.format('max(v)', '1 PRECEDING')}, 4)) AS v FROM g")
on_prices("reduce_multiplies", lambda s: ag.transform_reduce(s, 1, "multiplies", lambda v: F.when(v % 2 == 0, -1).otherwise(1)), "SELECT CAST(CASE WHEN count(*) FILTER (WHERE v % 2 = 0) % 2 = 0 THEN 1 ELSE -1 END AS BIGINT) AS result FROM o")
on_lines("search_frame", lambda s: se.search(s, src.drop(src.take(s, 1003), 1000)), "SELECT min(l.pos) AS result FROM l, (SELECT max(v) FILTER (WHERE pos = 1000) AS x, max(v) FILTER (WHERE pos = 1001) AS y, max(v) FILTER (WHERE pos = 1002) AS z FROM l), (SELECT pos, lead(v) OVER (ORDER BY pos) AS v1, lead(v, 2) OVER (ORDER BY pos) AS v2 FROM l) n WHERE n.pos = l.pos AND v = x AND v1 = y AND v2 = z")

from . import registry_ranges, registry_scalars  # noqa: E402, F401  (they add their queries to the same tables)
