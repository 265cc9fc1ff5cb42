"""Queries of the range forms, with projections where a form takes one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import ranges
from .registry import EARLY, FIRST, ISLANDS, KEEP, LAGGED, LATE, NEXT, P, SCAN, UNIQUE, O, add, events, on_lines, on_orders, on_prices, on_quantities, orders, parts
from .sources.sequences import mapped

fifth = lambda v: v % 5

# ---------------------------------------------------------------- predicates and searches

on_quantities("ranges_any_of", lambda s: ranges.any_of(s, lambda v: v > 7, proj=fifth), "SELECT coalesce(bool_or(v % 5 > 7), false) AS result FROM l")
on_quantities("ranges_all_of", lambda s: ranges.all_of(s, lambda v: v < 5, proj=fifth), "SELECT coalesce(bool_and(v % 5 < 5), true) AS result FROM l")
on_quantities("ranges_none_of", lambda s: ranges.none_of(s, lambda v: v == 3, proj=fifth), "SELECT NOT coalesce(bool_or(v % 5 = 3), false) AS result FROM l")
on_orders("ranges_for_each", lambda s: ranges.for_each(s, lambda v: v * 2 + 1, proj=lambda v: v % 1000), "SELECT pos, v % 1000 * 2 + 1 AS v FROM o")
on_quantities("ranges_count", lambda s: ranges.count(s, 2, proj=fifth), "SELECT count(*) FILTER (WHERE v % 5 = 2) AS result FROM l")
on_quantities("ranges_count_if", lambda s: ranges.count_if(s, lambda v: v == 0, proj=fifth), "SELECT count(*) FILTER (WHERE v % 5 = 0) AS result FROM l")
on_lines("ranges_find", lambda s: ranges.find(s, 4, proj=fifth), FIRST.format("v % 5 = 4", "l"))
on_lines("ranges_find_if", lambda s: ranges.find_if(s, lambda v: v == 3, proj=fifth), FIRST.format("v % 5 = 3", "l"))
on_lines("ranges_find_if_not", lambda s: ranges.find_if_not(s, lambda v: v < 4, proj=fifth), FIRST.format("NOT v % 5 < 4", "l"))
on_lines("ranges_find_end", lambda s: ranges.find_end(s, [2, 3], proj=fifth), f"SELECT coalesce(max(pos) FILTER (WHERE v % 5 = 2 AND v1 % 5 = 3), count(*)) AS result FROM ({NEXT})")
on_lines("ranges_find_first_of", lambda s: ranges.find_first_of(s, [49, 50]), FIRST.format("v IN (49, 50)", "l"))
on_lines("ranges_adjacent_find", lambda s: ranges.adjacent_find(s, lambda a, b: a == b + 4, proj=fifth), f"SELECT coalesce(min(pos) FILTER (WHERE v % 5 = v1 % 5 + 4), count(*)) AS result FROM ({NEXT})")
on_lines("ranges_search", lambda s: ranges.search_range(s, [1, 1], proj=fifth), f"SELECT coalesce(min(pos) FILTER (WHERE v % 5 = 1 AND v1 % 5 = 1), count(*)) AS result FROM ({NEXT})")
on_lines("ranges_search_n", lambda s: ranges.search_n(s, 3, 4, proj=fifth), f"SELECT coalesce(min(pos) FILTER (WHERE v % 5 = 4 AND v1 % 5 = 4 AND v2 % 5 = 4), count(*)) AS result FROM ({NEXT})")
add("ranges_equal", lambda s, d: ranges.equal(orders(s, d), orders(s, d).withColumn("v", F.col("v") + 1), proj=lambda v: v + 1), f"WITH {O} SELECT coalesce(bool_and(x.v + 1 = y.v + 1), true) AS result FROM o x JOIN o y USING (pos)")
on_lines("ranges_is_sorted", lambda s: ranges.is_sorted(s, proj=lambda v: v * 0), "SELECT coalesce(bool_and(NOT v * 0 < p * 0), true) AS result FROM (SELECT v, lag(v) OVER (ORDER BY pos) AS p FROM l)")
on_orders("ranges_is_sorted_until", lambda s: ranges.is_sorted_until(s, proj=lambda v: -v), FIRST.format("-v < -p", LAGGED))

# ---------------------------------------------------------------- copies and re-orderings

on_orders("ranges_copy", ranges.copy, "SELECT pos, v FROM o")
on_orders("ranges_move", ranges.move, "SELECT pos, v FROM o")
on_lines("ranges_copy_if", lambda s: ranges.copy_if(s, lambda v: v == 0, proj=fifth), KEEP.format("l", "v % 5 = 0"))
on_lines("ranges_copy_if_limited", lambda s: ranges.copy_if_limited(s, lambda v: v == 0, 20, proj=fifth), f"SELECT * FROM ({KEEP.format('l', 'v % 5 = 0')}) WHERE pos < 20")
on_orders("ranges_swap_ranges", lambda s: ranges.swap_ranges(s, s.withColumn("v", -F.col("v"))), "SELECT pos, -v AS a, v AS b FROM o")
on_lines("ranges_transform", lambda s: ranges.transform(s, lambda v: v + 1, proj=lambda v: v * 2), "SELECT pos, v * 2 + 1 AS v FROM l")
for _name in ("remove", "remove_copy"):
    on_lines(f"ranges_{_name}", lambda s, f=getattr(ranges, _name): f(s, 7), KEEP.format("l", "v <> 7"))
for _name in ("remove_if", "remove_copy_if"):
    on_lines(f"ranges_{_name}", lambda s, f=getattr(ranges, _name): f(s, lambda v: v < 25), KEEP.format("l", "NOT v < 25"))
for _name in ("replace", "replace_copy"):
    on_lines(f"ranges_{_name}", lambda s, f=getattr(ranges, _name): f(s, 7, 70), "SELECT pos, CASE WHEN v = 7 THEN 70 ELSE v END AS v FROM l")
for _name in ("replace_if", "replace_copy_if"):
    on_lines(f"ranges_{_name}", lambda s, f=getattr(ranges, _name): f(s, lambda v: v > 40, 0), "SELECT pos, CASE WHEN v > 40 THEN 0 ELSE v END AS v FROM l")
for _name in ("unique", "unique_copy"):
    on_lines(f"ranges_{_name}", lambda s, f=getattr(ranges, _name): f(s), KEEP.format(UNIQUE, "p IS NULL OR v <> p"))
for _name in ("reverse", "reverse_copy"):
    on_orders(f"ranges_{_name}", getattr(ranges, _name), "SELECT (SELECT count(*) FROM o) - 1 - pos AS pos, v FROM o")
on_orders("ranges_rotate_copy", lambda s: ranges.rotate_copy(s, 100), "SELECT (pos - 100 + n) % n AS pos, v FROM o, (SELECT count(*) AS n FROM o)")

# ---------------------------------------------------------------- sorts, merges, extremes

on_lines("ranges_sort", lambda s: ranges.sort(s, proj=fifth), "SELECT row_number() OVER (ORDER BY v % 5, pos) - 1 AS pos, v FROM l")
on_lines("ranges_stable_sort", lambda s: ranges.stable_sort(s, proj=lambda v: -v), "SELECT row_number() OVER (ORDER BY -v, pos) - 1 AS pos, v FROM l")


def _merged(s, d: str) -> DataFrame:
    """Part keys of both halves, the second half negated and projected back."""
    return ranges.merge(parts(s, d, EARLY), mapped(parts(s, d, LATE), lambda v: -v), proj=lambda v: v, proj_b=lambda v: -v)


add("ranges_merge", _merged, f"WITH {P} SELECT row_number() OVER (ORDER BY abs(v), v < 0) - 1 AS pos, v FROM (SELECT v FROM a UNION ALL SELECT -v FROM b)")
on_lines("ranges_min_element", lambda s: ranges.min_element(s, proj=fifth), "SELECT arg_min(pos, (v % 5, pos)) AS result, arg_min(v, (v % 5, pos)) AS value FROM l")
on_lines("ranges_max_element", lambda s: ranges.max_element(s, proj=fifth), "SELECT arg_max(pos, (v % 5, -pos)) AS result, arg_max(v, (v % 5, -pos)) AS value FROM l")
on_lines("ranges_minmax_element", lambda s: ranges.minmax_element(s, proj=fifth), "SELECT arg_min(pos, (v % 5, pos)) AS min_pos, arg_max(pos, (v % 5, pos)) AS max_pos FROM l")

# ---------------------------------------------------------------- reductions and scans

on_prices("ranges_reduce", lambda s: ranges.reduce(s, 10), "SELECT CAST(10 + sum(v) AS BIGINT) AS result FROM o")
on_prices("ranges_transform_reduce", lambda s: ranges.transform_reduce(s, 0, "plus", lambda v: v % 10), "SELECT CAST(sum(v % 10) AS BIGINT) AS result FROM o")
add("ranges_reduce_by_segment", lambda s, d: ranges.reduce_by_segment(events(s, d), "minimum"), f"WITH {ISLANDS} SELECT CAST(island - 1 AS BIGINT) AS pos, min(k) AS k, min(v) AS v FROM g GROUP BY island")
on_orders("ranges_inclusive_scan", ranges.inclusive_scan, SCAN.format("sum(v)", "CURRENT ROW"))
on_orders("ranges_exclusive_scan", lambda s: ranges.exclusive_scan(s, 5), f"SELECT pos, coalesce(v, 0) + 5 AS v FROM ({SCAN.format('sum(v)', '1 PRECEDING')})")
on_orders("ranges_transform_inclusive_scan", lambda s: ranges.transform_inclusive_scan(s, "plus", lambda v: v % 7), SCAN.format("sum(v % 7)", "CURRENT ROW"))
on_orders("ranges_transform_exclusive_scan", lambda s: ranges.transform_exclusive_scan(s, 3, "plus", lambda v: v % 7), f"SELECT pos, coalesce(v, 0) + 3 AS v FROM ({SCAN.format('sum(v % 7)', '1 PRECEDING')})")
