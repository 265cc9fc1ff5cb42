"""Predicates, searches and comparisons."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import neighbour, running
from .sorting import By, keyed

Pred = Callable[[Column], Column]
Test = Callable[[Column, Column], Column]


def _same(a: Column, b: Column) -> Column:
    return a == b


def _less(a: Column, b: Column) -> Column:
    return a < b


def _one(df: DataFrame, value: Column) -> DataFrame:
    return df.agg(value.alias("result"))


def _first(df: DataFrame, hit: Column) -> DataFrame:
    return _one(df, F.coalesce(F.min(F.when(hit, F.col("pos"))), F.count(F.lit(1))))


def any_of(s: DataFrame, pred: Pred, proj: Pred = lambda c: c) -> DataFrame:
    return _one(s, F.coalesce(F.bool_or(pred(proj(F.col("v")))), F.lit(False)))


def all_of(s: DataFrame, pred: Pred, proj: Pred = lambda c: c) -> DataFrame:
    return _one(s, F.coalesce(F.bool_and(pred(proj(F.col("v")))), F.lit(True)))


def none_of(s: DataFrame, pred: Pred, proj: Pred = lambda c: c) -> DataFrame:
    return _one(s, ~F.coalesce(F.bool_or(pred(proj(F.col("v")))), F.lit(False)))


def for_each(s: DataFrame, f: Pred, proj: Pred = lambda c: c) -> DataFrame:
    """Apply ``f`` to every projected element in place."""
    return s.withColumn("v", f(proj(F.col("v"))))


def for_each_n(s: DataFrame, n: int, f: Pred) -> DataFrame:
    return s.withColumn("v", F.when(F.col("pos") < n, f(F.col("v"))).otherwise(F.col("v")))


def find_if(s: DataFrame, pred: Pred, proj: Pred = lambda c: c) -> DataFrame:
    return _first(s, pred(proj(F.col("v"))))


def find_if_not(s: DataFrame, pred: Pred, proj: Pred = lambda c: c) -> DataFrame:
    return _first(s, ~pred(proj(F.col("v"))))


def find(s: DataFrame, value, proj: Pred = lambda c: c) -> DataFrame:
    return _first(s, proj(F.col("v")) == F.lit(value))


def find_first_of(s: DataFrame, values: Sequence, test: Test = _same) -> DataFrame:
    """First element that passes ``test`` with any of the given values (a bounded list)."""
    if not len(values):
        return _one(s, F.count(F.lit(1)))
    hit = F.col("v").isin(list(values)) if test is _same else F.exists(F.array(*map(F.lit, values)), lambda x: test(F.col("v"), x))
    return _first(s, hit)


def find_first_of_frame(s: DataFrame, values: DataFrame) -> DataFrame:
    """`find_first_of` for values in a frame of any size."""
    hit = s.join(values.select("v").distinct(), "v", "left_semi").agg(F.min("pos").alias("p"))
    return hit.join(s.agg(F.count(F.lit(1)).alias("n"))).select(F.coalesce("p", "n").alias("result"))


def adjacent_find(s: DataFrame, test: Test = _same, proj: Pred = lambda c: c) -> DataFrame:
    """First position whose projected element passes ``test`` with the next one."""
    out = neighbour(s.select("pos", "v"), "v", 1, "_next")
    return _first(out, ~F.col("_edge") & test(proj(F.col("v")), proj(F.col("_next"))))


def count(s: DataFrame, value, proj: Pred = lambda c: c) -> DataFrame:
    return count_if(s, lambda v: v == F.lit(value), proj)


def count_if(s: DataFrame, pred: Pred, proj: Pred = lambda c: c) -> DataFrame:
    return _one(s, F.count_if(pred(proj(F.col("v")))))


def _matches(s: DataFrame, pattern: Sequence, test: Test) -> DataFrame:
    """``start`` of every occurrence of a pattern (a bounded list)."""
    wanted = F.array(*map(F.lit, pattern))
    fits = functools.reduce(lambda x, y: x | y, [F.coalesce(test(F.col("v"), F.lit(x)), F.lit(False)) for x in dict.fromkeys(pattern)])
    offsets = F.filter(F.sequence(F.lit(0), F.lit(len(pattern) - 1)), lambda i: test(F.col("v"), F.element_at(wanted, i + 1)))
    starts = s.filter(fits).select("pos", F.explode(offsets).alias("_i")).select((F.col("pos") - F.col("_i")).alias("start")).filter("start >= 0")
    return starts.groupBy("start").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(pattern))


def _matches_frame(s: DataFrame, pattern: DataFrame, proj: Pred) -> DataFrame:
    """The same for a pattern that is a sequence of any length.

    Its value that is rarest in ``s`` gives the candidates; each is compared element by element.
    """
    x, y = s.select("pos", proj(F.col("v")).alias("v")), pattern.select(F.col("pos").alias("i"), F.col("v").alias("w"))
    freq = y.join(x.groupBy("v").agg(F.count(F.lit(1)).alias("n")), F.col("v").eqNullSafe(F.col("w")), "left")
    anchor = freq.agg(F.min_by(F.struct("i", "w"), F.struct(F.coalesce("n", F.lit(0)), "i")).alias("a"), F.count(F.lit(1)).alias("m")).select("a.i", "a.w", "m")
    found = x.join(F.broadcast(anchor), F.col("v").eqNullSafe(F.col("w"))).select((F.col("pos") - F.col("i")).alias("start"), "m").filter("start >= 0")
    each = found.select("start", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("i"))
    at = each.join(y, "i").withColumn("pos", F.col("start") + F.col("i"))
    same = at.join(x, "pos").filter(F.col("v").eqNullSafe(F.col("w")))
    return same.groupBy("start", "m").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == F.col("m"))


def _with_default(s: DataFrame, hit: DataFrame, known: int | None = None) -> DataFrame:
    """A one-row position, or the length."""
    if known is not None:
        return hit.select(F.coalesce("p", F.lit(known).cast("long")).alias("result"))
    return hit.join(s.agg(F.count(F.lit(1)).alias("_n"))).select(F.coalesce("p", "_n").alias("result"))


def search(s: DataFrame, pattern: Sequence | DataFrame, test: Test = _same, proj: Pred = lambda c: c) -> DataFrame:
    """First start of ``pattern``, a list or a sequence; 0 for an empty one.  ``test`` holds for lists."""
    if isinstance(pattern, DataFrame):
        empty = pattern.agg((F.count(F.lit(1)) == 0).alias("_none"))
        out = _with_default(s, _matches_frame(s, pattern, proj).agg(F.min("start").alias("p")))
        return out.join(F.broadcast(empty)).select(F.when(F.col("_none"), F.lit(0).cast("long")).otherwise(F.col("result")).alias("result"))
    if not len(pattern):
        return _one(s, F.lit(0).cast("long"))
    return _with_default(s, _matches(s.withColumn("v", proj(F.col("v"))), pattern, test).agg(F.min("start").alias("p")), getattr(s, "_rows", None))


def find_end(s: DataFrame, pattern: Sequence | DataFrame, test: Test = _same, proj: Pred = lambda c: c) -> DataFrame:
    """Last start of ``pattern``, a list or a sequence; the length for an empty one."""
    if isinstance(pattern, DataFrame):
        return _with_default(s, _matches_frame(s, pattern, proj).agg(F.max("start").alias("p")))
    if not len(pattern):
        return _one(s, F.count(F.lit(1)))
    return _with_default(s, _matches(s.withColumn("v", proj(F.col("v"))), pattern, test).agg(F.max("start").alias("p")), getattr(s, "_rows", None))


def search_n(s: DataFrame, n: int, value, test: Test = _same, proj: Pred = lambda c: c) -> DataFrame:
    """First start of ``n`` consecutive projected elements that pass ``test`` with ``value``; 0 for n <= 0."""
    if n <= 0:
        return _one(s, F.lit(0).cast("long"))
    hit = test(proj(F.col("v")), F.lit(value))
    out = running(s.select("pos", "v"), F.when(~F.coalesce(hit, F.lit(False)), F.col("pos")), "max", "_gap")
    long = F.col("pos") - F.coalesce("_gap", F.lit(-1)) >= n
    return _one(out, F.coalesce(F.min(F.when(long, F.col("pos") - n + 1)), F.count(F.lit(1))))


def _zip(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    x = a.select("pos", F.col("v").alias("a"), F.lit(True).alias("in_a"))
    y = b.select("pos", F.col("v").alias("b"), F.lit(True).alias("in_b"))
    return x.join(y, "pos", how)


def mismatch(a: DataFrame, b: DataFrame, test: Test = _same) -> DataFrame:
    """First position where the sequences differ, or the length of the shorter."""
    both = F.col("in_a") & F.col("in_b")
    out = _zip(a, b, "full").agg(
        F.min(F.when(both & ~F.coalesce(test(F.col("a"), F.col("b")), F.lit(False)), F.col("pos"))).alias("p"), F.count_if(both).alias("n")
    )
    return out.select(F.coalesce("p", "n").alias("result"))


def equal(a: DataFrame, b: DataFrame, test: Test = _same, proj: Pred = lambda c: c, proj_b: Pred = lambda c: c) -> DataFrame:
    """Equal lengths and equal projected elements; two empty sequences are equal."""
    passes = F.col("in_a") & F.col("in_b") & test(proj(F.col("a")), proj_b(F.col("b")))
    return _zip(a, b, "full").agg(F.coalesce(F.bool_and(F.coalesce(passes, F.lit(False))), F.lit(True)).alias("result"))


def lexicographical_compare(a: DataFrame, b: DataFrame, less: Test = _less) -> DataFrame:
    """Whether ``a`` comes before ``b``; a proper prefix comes first."""
    x, y = F.col("a"), F.col("b")
    verdict = F.when(F.col("in_a").isNull(), F.lit(True)).when(F.col("in_b").isNull(), F.lit(False)).when(less(x, y), F.lit(True)).when(less(y, x), F.lit(False))
    out = _zip(a, b, "full").withColumn("_r", verdict).agg(F.min_by("_r", F.when(F.col("_r").isNotNull(), F.col("pos"))).alias("r"))
    return out.select(F.coalesce("r", F.lit(False)).alias("result"))


def is_sorted_until(s: DataFrame, less: Test = _less, proj: Pred = lambda c: c) -> DataFrame:
    out = neighbour(s.select("pos", "v"), "v", -1, "_before")
    return _first(out, ~F.col("_edge") & less(proj(F.col("v")), proj(F.col("_before"))))


def is_sorted(s: DataFrame, less: Test = _less, proj: Pred = lambda c: c) -> DataFrame:
    out = neighbour(s.select("pos", "v"), "v", -1, "_before")
    return _one(out, F.coalesce(F.bool_and(F.col("_edge") | ~less(proj(F.col("v")), proj(F.col("_before")))), F.lit(True)))


def is_partitioned(s: DataFrame, pred: Pred) -> DataFrame:
    p = pred(F.col("v"))
    last, first = F.max(F.when(p, F.col("pos"))), F.min(F.when(~p, F.col("pos")))
    return _one(s, F.coalesce(last < first, F.lit(True)))


def is_heap_until(s: DataFrame, less: Test = _less) -> DataFrame:
    """First element greater than its parent in a binary heap."""
    parents = s.select(F.col("pos").alias("_up"), F.col("v").alias("_parent"))
    out = s.withColumn("_up", F.when(F.col("pos") > 0, F.floor((F.col("pos") - 1) / 2))).join(parents, "_up", "left")
    return _first(out, (F.col("pos") > 0) & less(F.col("_parent"), F.col("v")))


def is_heap(s: DataFrame, less: Test = _less) -> DataFrame:
    n = s.agg(F.count(F.lit(1)).alias("n"))
    return is_heap_until(s, less).join(n).select((F.col("result") == F.col("n")).alias("result"))


def includes(a: DataFrame, b: DataFrame, by: By | None = None, proj: Pred = lambda c: c) -> DataFrame:
    """Whether ``a`` holds every element of ``b`` at least as often; elements with equal keys of ``by`` are the same."""
    x, names, _ = keyed(a.select("v"), by or (lambda c: c), proj=proj)
    y, other, _ = keyed(b.select("v"), by or (lambda c: c), proj=proj)
    x = x.groupBy(F.struct(*[F.col(k) for k in names]).alias("v")).agg(F.count(F.lit(1)).alias("n_a"))
    y = y.groupBy(F.struct(*[F.col(o).alias(k) for o, k in zip(other, names)]).alias("v")).agg(F.count(F.lit(1)).alias("n_b"))
    short = F.coalesce("n_a", F.lit(0)) < F.col("n_b")
    return y.join(x, x["v"].eqNullSafe(y["v"]), "left").agg((F.count_if(short) == 0).alias("result"))
