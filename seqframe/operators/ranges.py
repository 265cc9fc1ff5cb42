"""Range forms: the same operators with a projection of the elements, and bounded outputs.

Operators whose iterator form already takes a projection have the same function under both names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import aggregate, rearrange, search, sorting


def projected(s: DataFrame, proj) -> DataFrame:
    """The sequence of ``proj`` of each element."""
    return s.withColumn("v", proj(F.col("v")))


any_of, all_of, none_of = search.any_of, search.all_of, search.none_of
find, find_if, find_if_not, find_end, find_first_of = search.find, search.find_if, search.find_if_not, search.find_end, search.find_first_of
adjacent_find, count, count_if, search_n, equal = search.adjacent_find, search.count, search.count_if, search.search_n, search.equal
is_sorted, is_sorted_until, for_each = search.is_sorted, search.is_sorted_until, search.for_each
copy, copy_if, move, swap_ranges, transform = rearrange.copy, rearrange.copy_if, rearrange.move, rearrange.swap_ranges, rearrange.transform
remove, remove_if, remove_copy, remove_copy_if = rearrange.remove, rearrange.remove_if, rearrange.remove_copy, rearrange.remove_copy_if
unique, unique_copy, reverse, reverse_copy, rotate_copy = rearrange.unique, rearrange.unique_copy, rearrange.reverse, rearrange.reverse_copy, rearrange.rotate_copy
replace, replace_if, replace_copy, replace_copy_if = rearrange.replace, rearrange.replace_if, rearrange.replace_copy, rearrange.replace_copy_if
sort, stable_sort, merge = sorting.sort, sorting.stable_sort, sorting.merge
min_element, max_element, minmax_element = sorting.min_element, sorting.max_element, sorting.minmax_element
reduce, transform_reduce, reduce_by_segment = aggregate.reduce, aggregate.transform_reduce, aggregate.reduce_by_segment
inclusive_scan, exclusive_scan = aggregate.inclusive_scan, aggregate.exclusive_scan
transform_inclusive_scan, transform_exclusive_scan = aggregate.transform_inclusive_scan, aggregate.transform_exclusive_scan


def search_range(s: DataFrame, pattern, test=search._same, proj=lambda c: c) -> DataFrame:
    return search.search(s, pattern, test, proj)


def copy_if_limited(s: DataFrame, pred, size: int, proj=lambda c: c) -> DataFrame:
    """At most ``size`` elements fit into the output."""
    return rearrange.copy_if(s, pred, proj).filter(F.col("pos") < size)
