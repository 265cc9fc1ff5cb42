"""Sorts, selections, merges, extremes, and multiset operations on sorted sequences.

The order of elements is natural unless ``by`` and ``descending`` say otherwise: ``by`` maps an element to
one Column or several, which are compared one after another, and ``descending`` holds for all of them or is
a list with one flag for each.  Nulls come first in rising order, NaN last.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import dense_pos
from ..plans.ranking import BUCKET, MOST, Late, Order, as_order, attach, carried, chained, col, fresh, gathered, grouped_pos, length, leveled, order_of, ordering, reordered, sized

By = Callable[[Column], "Column | Sequence[Column]"]
#: Copies of one value that a generator row expands at once.
CHUNK = 1_000_000


def keyed(s: DataFrame, by: By | None = None, descending: bool | Sequence[bool] = False, proj: Callable | None = None, element: str = "v") -> tuple[DataFrame, list[str], list[str]]:
    """``s`` with the columns to compare, their names, and the names of the falling ones."""
    if by is None and proj is None:
        names, work = [element], s
    else:
        x = proj(col(element)) if proj else col(element)
        keys = by(x) if by else x
        keys = list(keys) if isinstance(keys, list | tuple) else [keys]
        names = fresh(s, *["_key"] * len(keys))
        work = s.withColumns(dict(zip(names, keys)))
    flags = [descending] * len(names) if isinstance(descending, bool) else list(descending)
    if len(flags) != len(names):
        raise ValueError(f"{len(names)} keys need as many directions, not {len(flags)}")
    return work, names, [n for n, d in zip(names, flags) if d]


def _reordered(o: Order, element: str, by: By | None, descending, proj=None) -> Order:
    """A sequence without positions in the order of its elements, equal ones in the order they had."""
    return reordered(o, *keyed(o.frame, by, descending, proj, element))


def _front(o: Order, k: int) -> DataFrame:
    """The first ``k`` rows, at most `BUCKET`, by a distributed top-k, with the positions ``pos``."""
    first = sized(o.frame.orderBy(*o.by).limit(k), min(k, o.rows))
    return dense_pos(first, *o.keys, descending=o.falling).select("pos", *map(col, o.columns))


def _sorted(s: DataFrame, element: str, by: By | None, descending, proj=None, rows: int = BUCKET) -> DataFrame:
    if (o := order_of(s)) is not None:
        return Late(_reordered(o, element, by, descending, proj), rows)
    work, names, down = keyed(s, by, descending, proj, element)
    old = fresh(work, "_old")[0]
    n = length(s)
    moved = sized(work.withColumnRenamed("pos", old), n)
    return sized(dense_pos(moved, *names, descending=down, tie=old, rows=rows).select(*map(col, s.columns)), n)


def sort(s: DataFrame, descending: bool | Sequence[bool] = False, proj=None, by: By | None = None, rows: int = BUCKET) -> DataFrame:
    """In order; equal elements keep theirs.  ``rows`` is what one task's bucket is meant to hold."""
    return _sorted(s, "v", by, descending, proj, rows)


stable_sort = sort


def sort_by_key(s: DataFrame, descending: bool | Sequence[bool] = False, by: By | None = None, rows: int = BUCKET) -> DataFrame:
    """Order by column ``k``; values move with their keys, equal keys keep their order."""
    return _sorted(s, "k", by, descending, None, rows)


stable_sort_by_key = sort_by_key


def _selected(s: DataFrame, n: int, by: By | None, descending) -> tuple[DataFrame, list[str], list[str], str, str, int | None, int]:
    """Rows dealt into ordered buckets, and the bucket that holds rank ``n`` with the rows before it (None: no such rank)."""
    work, names, down = keyed(s, by, descending)
    old, level = fresh(work, "_old", "_level")
    work = sized(work.withColumnRenamed("pos", old), length(s))
    dealt, total = leveled(work, level, names, down, old)
    if not 0 <= n < total:
        return dealt, names, down, old, level, None, total
    if total <= BUCKET:
        return dealt, names, down, old, level, 0, 0
    before = 0
    for r in sorted(gathered(dealt, [level], F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r[0]):
        if n < before + r.n:
            return dealt, names, down, old, level, r[0], before
        before += r.n
    return dealt, names, down, old, level, None, total


def partial_sort_copy(s: DataFrame, k: int, descending: bool | Sequence[bool] = False, by: By | None = None) -> DataFrame:
    """The ``k`` smallest in order: only the buckets that hold them are sorted."""
    if 0 < k <= BUCKET and (o := order_of(s)) is not None:
        return _front(_reordered(o, "v", by, descending), k)
    dealt, names, down, old, level, at, before = _selected(s, k - 1, by, descending)
    if k <= 0:
        return s.filter(F.lit(False))
    front = dealt if at is None else dealt.filter(F.col(level) <= at)
    out = dense_pos(front.drop(level), *names, descending=down, tie=old)
    return out.filter(F.col("pos") < k).select(*map(col, s.columns))


def _pivot(s: DataFrame, n: int, by: By | None, descending) -> DataFrame | None:
    """One row with the element that a sort puts at ``n``, its keys, and its position under the name that follows."""
    if 0 <= n < BUCKET and (o := order_of(s)) is not None and n < o.rows:
        o = _reordered(o, "v", by, descending)
        return o.frame.orderBy(*o.by).offset(n).limit(1)
    dealt, names, down, old, level, at, before = _selected(s, n, by, descending)
    if at is None:
        return None
    return dealt.filter(F.col(level) == at).orderBy(*ordering(names, down, old)).offset(n - before).limit(1).drop(level).withColumnRenamed(old, "pos")


def nth_value(s: DataFrame, n: int, descending: bool | Sequence[bool] = False, by: By | None = None) -> DataFrame:
    """The element of rank ``n``, found in the one bucket that holds it."""
    found = _pivot(s, n, by, descending)
    return (s.filter(F.lit(False)) if found is None else found).select(F.col("v").alias("result"))


def _beside(frame: DataFrame, one: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Attach the keys of the only row of ``one`` to every row: a literal would change the type of some values."""
    picks = fresh(frame, *[f"_pivot{i}" for i in range(len(keys))])
    held = one.select(*[col(k).alias(p) for k, p in zip(keys, picks)])
    return frame.join(F.broadcast(held)), dict(zip(keys, map(F.col, picks)))


def _behind(keys: Sequence[str], down: Sequence[str], out: Column, pivot: dict[str, Column]) -> Column:
    """-1 or 1 for rows before and behind the pivot, ``out`` for equal keys; nulls and NaN have their place in the order."""
    for k in reversed(keys):
        a, b = F.struct(col(k).alias("x")), F.struct(pivot[k].alias("x"))
        first, last = (1, -1) if k in down else (-1, 1)
        out = F.when(a < b, first).when(a > b, last).otherwise(out)
    return out


def nth_element(s: DataFrame, n: int, descending: bool | Sequence[bool] = False, by: By | None = None) -> DataFrame:
    """The element of rank ``n`` at ``n``, smaller or equal ones before, others after, each in order."""
    found = _pivot(s, n, by, descending)
    row = found and found.collect()
    if not row:
        return s.select("*")
    if n < BUCKET and (o := order_of(s)) is not None:
        r = _reordered(o, "v", by, descending)
        both, picks = _beside(r.frame, s.sparkSession.createDataFrame(row, found.schema), r.keys)
        group = fresh(both, "_group")[0]
        parted = both.withColumn(group, _behind(r.keys, r.falling, F.lit(0), picks)).drop(*[p for p in both.columns if p not in r.frame.columns])
        return Late(Order(parted, (group, *o.keys), o.falling, o.columns, o.rows))
    work, names, down = keyed(s, by, descending)
    old = fresh(work, "_old")[0]
    # the pivot is attached as one row: literals would change the type of some values
    held = s.sparkSession.createDataFrame(row, found.schema)
    pick = fresh(work, *[f"_pivot{i}" for i in range(len(names) + 1)])
    held = held.select(*[col(k).alias(p) for k, p in zip([*names, "pos"], pick)])
    both = work.withColumnRenamed("pos", old).join(F.broadcast(held))
    picks = dict(zip(names, map(F.col, pick)))
    at = F.col(pick[-1])
    group = _behind(names, down, F.when(col(old) < at, -1).when(col(old) > at, 1).otherwise(0), picks)
    return grouped_pos(both, group, old).select(*map(col, s.columns))


def partial_sort(s: DataFrame, middle: int, descending: bool | Sequence[bool] = False, by: By | None = None) -> DataFrame:
    """The ``middle`` smallest sorted in front; the others behind them in their old order.

    Only the buckets that hold the front are sorted; the others keep their order and are moved once.
    """
    if middle <= 0:
        return s.select("*")
    dealt, names, down, old, level, at, before = _selected(s, middle - 1, by, descending)
    if at is None:
        return sort(s, descending, by=by)
    ranked = dense_pos(dealt.filter(F.col(level) <= at).drop(level), *names, descending=down, tie=old)
    front = ranked.filter(F.col("pos") < middle).select(*map(col, s.columns))
    rest = ranked.filter(F.col("pos") >= middle).drop("pos").select(old, *[col(c) for c in s.columns if c != "pos"])
    rest = rest.unionByName(dealt.filter(F.col(level) > at).select(old, *[col(c) for c in s.columns if c != "pos"]))
    behind = grouped_pos(rest, F.lit(0), old).withColumn("pos", F.col("pos") + middle)
    return front.unionByName(behind.select(*map(col, s.columns)))


def _together(a: DataFrame, b: DataFrame, by: By | None, descending, proj: Callable | None, proj_b: Callable | None) -> tuple[Order, list[str], str]:
    """Both sorted sequences in the order of a merge, which moves each once; the names of its keys, and of what tells ``a`` (0) from ``b`` (1)."""
    x, y = as_order(a), as_order(b)
    fx, names, down = keyed(x.frame, by, descending, proj)
    fy, other, _ = keyed(y.frame, by, descending, proj_b)
    both, which = chained(replace(x, frame=fx), replace(y, frame=fy), names, other, down)
    return both, list(both.keys[: len(names)]), which


def merge(a: DataFrame, b: DataFrame, limit: int | None = None, descending: bool | Sequence[bool] = False, by: By | None = None, proj: Callable | None = None, proj_b: Callable | None = None) -> DataFrame:
    """Stable merge of two sorted sequences, ties from ``a`` first; at most ``limit`` elements.

    ``proj`` and ``proj_b`` project the elements of each for the comparison (``proj_b`` as ``proj`` if not given).
    """
    if order_of(a) is not None or order_of(b) is not None:
        both, _, _ = _together(a, b, by, descending, proj, proj_b or proj)
        if limit is not None and limit <= BUCKET:
            return _front(both, limit) if limit > 0 else a.select("pos", "v").filter(F.lit(False))
        return Late(both) if limit is None else Late(both).filter(F.col("pos") < limit)
    x, names, down = keyed(a, by, descending, proj)
    y, other, _ = keyed(b, by, descending, proj_b or proj)
    n, old = length(a), fresh(x, "_old")[0]
    left = x.select(F.col("pos").alias(old), "v", *[col(k) for k in names if k != "v"])
    right = y.select((F.col("pos") + n).alias(old), "v", *[col(o).alias(k) for o, k in zip(other, names) if k != "v"])
    both = sized(left.unionByName(right), n + length(b))
    if limit is not None:
        return partial_sort_copy(both.withColumnRenamed(old, "pos"), limit, [k in down for k in names], (lambda _: [col(k) for k in names])).select("pos", "v")
    return dense_pos(both, *names, descending=down, tie=old).select("pos", "v")


def inplace_merge(s: DataFrame, descending: bool | Sequence[bool] = False, by: By | None = None) -> DataFrame:
    """Merge two consecutive sorted halves of one sequence."""
    return _sorted(s, "v", by, descending)


def _extreme(s: DataFrame, by: By, descending, proj, last: bool) -> DataFrame:
    """The first element of the order, or the last one of the opposite order: a distributed top-1."""
    work, names, down = keyed(s, by, descending, proj)
    down = [k for k in names if k not in down] if last else down
    return work.orderBy(*ordering(names, down, "pos")).limit(1).select("pos", "v")


def min_element(s: DataFrame, proj=lambda c: c, by: By | None = None, descending: bool | Sequence[bool] = False) -> DataFrame:
    """Position of the first smallest element, and its value; the length where there is none."""
    if by is not None or descending is not False:
        if (o := order_of(s)) is not None:
            return _extreme_of(o, by or (lambda c: c), descending, proj, False)
        return _placed(s, _extreme(s, by or (lambda c: c), descending, proj, False))
    x = F.min(F.struct(proj(F.col("v")).alias("k"), "pos", "v"))
    return s.agg(x.alias("x"), F.count(F.lit(1)).alias("n")).select(F.coalesce("x.pos", "n").alias("result"), F.col("x.v").alias("value"))


def max_element(s: DataFrame, proj=lambda c: c, by: By | None = None, descending: bool | Sequence[bool] = False) -> DataFrame:
    """Position of the first largest element."""
    if by is not None or descending is not False:
        if (o := order_of(s)) is not None:
            return _extreme_of(o, by or (lambda c: c), descending, proj, True)
        return _placed(s, _extreme(s, by or (lambda c: c), descending, proj, True))
    x = F.max(F.struct(proj(F.col("v")).alias("k"), (-F.col("pos")).alias("p"), "v"))
    return s.agg(x.alias("x"), F.count(F.lit(1)).alias("n")).select(F.coalesce(-F.col("x.p"), F.col("n")).alias("result"), F.col("x.v").alias("value"))


def _extreme_of(o: Order, by: By, descending, proj, last: bool) -> DataFrame:
    """The same without positions: a distributed top-1, and a count of the elements before the one that is found."""
    work, names, down = keyed(o.frame, by, descending, proj)
    r = reordered(o, work, names, [k for k in names if k not in down] if last else down)
    found = r.frame.orderBy(*r.by).limit(1)
    both, picks = _beside(o.frame.select(*map(col, o.keys)), found, [*o.keys, "v"])
    before = _behind(o.keys, o.falling, F.lit(0), picks) < 0
    return both.agg(F.count_if(before).alias("result"), F.first(picks["v"]).alias("value"))


def _placed(s: DataFrame, found: DataFrame) -> DataFrame:
    one = found.agg(F.max("pos").alias("p"), F.max("v").alias("value"))
    return one.join(F.broadcast(s.agg(F.count(F.lit(1)).alias("n")))).select(F.coalesce("p", "n").alias("result"), "value")


def minmax_element(s: DataFrame, proj=lambda c: c) -> DataFrame:
    """Positions of the first smallest and of the last largest element."""
    x = F.struct(proj(F.col("v")).alias("k"), "pos")
    out = s.agg(F.min(x).alias("l"), F.max(x).alias("h"), F.count(F.lit(1)).alias("n"))
    return out.select(F.coalesce("l.pos", "n").alias("min_pos"), F.coalesce("h.pos", "n").alias("max_pos"))


def _multiset(a: DataFrame, b: DataFrame, copies) -> DataFrame:
    """Values with ``copies(count in a, count in b)``, sorted.

    Only counts of values are moved and ordered; a value's copies follow from the count of those before it,
    and are made in chunks, so a value of most rows is expanded by many tasks.
    """
    x = a.groupBy("v").agg(F.count(F.lit(1)).alias("_a"))
    y = b.groupBy(F.col("v").alias("_w")).agg(F.count(F.lit(1)).alias("_b"))
    both = x.join(y, F.col("v").eqNullSafe(F.col("_w")), "full")
    value = F.when(F.col("_a").isNotNull(), F.col("v")).otherwise(F.col("_w")).alias("v")
    n = both.select(value, copies(F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0))).alias("_n")).filter("_n > 0")
    placed = running_by(n, ["v"], "_n", "_upto")
    chunks = placed.select("v", (F.col("_upto") - F.col("_n")).alias("_from"), "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / CHUNK))).alias("_k"))
    spread = chunks.repartition("_from", "_k")
    first = F.col("_from") + F.col("_k") * CHUNK
    return spread.select(F.explode(F.sequence(first, first + F.least(F.lit(CHUNK), F.col("_n") - F.col("_k") * CHUNK) - 1)).alias("pos"), "v")


def running_by(df: DataFrame, keys: Sequence[str], value: str, name: str, descending: Sequence[str] = ()) -> DataFrame:
    """Add the running sum of ``value`` in the order of the ``keys``, which are distinct."""
    level, near, far = fresh(df, "_level", "_near", "_far")
    work, total = leveled(df, level, keys, descending)
    frame = Window.partitionBy(level).orderBy(*ordering(keys, descending)).rowsBetween(Window.unboundedPreceding, 0)
    local = work.withColumn(near, F.sum(value).over(frame))
    if total <= BUCKET:
        return local.withColumn(name, F.col(near)).drop(level, near)
    known = gathered(work, [level], F.sum(value).alias("t"))
    out = attach(local, level, carried(known, level, F.sum("t"), far), {far: "long"})
    return out.withColumn(name, F.col(near) + F.coalesce(far, F.lit(0))).drop(level, near, far)


def _classes(a: DataFrame, b: DataFrame, by: By, descending, proj) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """Elements of both sorted sequences with their rank among the equivalent ones (``_rank``) and the number of
    equivalent ones here (``_own``) and in the other sequence (``_others``)."""
    by = by or (lambda c: c)
    x, names, down = keyed(a, by, descending, proj)
    y, other, _ = keyed(b, by, descending, proj)
    y = y.select("pos", "v", *[col(o).alias(k) for o, k in zip(other, names)])
    x = x.select("pos", "v", *map(col, names))
    same = lambda p, q: F.struct(*[p[k].alias(k) for k in names]).eqNullSafe(F.struct(*[q[k].alias(k) for k in names]))
    count = lambda d: d.groupBy(*names).agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_own"))
    cx, cy = count(x), count(y)

    def ranked(s: DataFrame, own: DataFrame, others: DataFrame) -> DataFrame:
        both = own.join(others.withColumnRenamed("_own", "_others").drop("_first"), same(own, others), "left")
        both = both.select(*[own[k].alias(f"{k}_") for k in names], "_first", "_own", F.coalesce("_others", F.lit(0)).alias("_others"))
        match = F.struct(*[s[k].alias(k) for k in names]).eqNullSafe(F.struct(*[both[f"{k}_"].alias(k) for k in names]))
        return s.join(both, match).withColumn("_rank", F.col("pos") - F.col("_first")).drop("_first", *[f"{k}_" for k in names])

    return ranked(x, cx, cy), ranked(y, cy, cx), names, down


#: From which rank to which the equivalent elements of a sequence are kept, by their number here and in the other sequence.
KEPT = {
    "all": lambda own, other: (F.lit(0), own),
    "first": lambda own, other: (F.lit(0), F.least(own, other)),
    "rest": lambda own, other: (F.least(own, other), own),
    "none": lambda own, other: (F.lit(0), F.lit(0)),
}


def _by_class(both: Order, names: list[str], which: str, keep_a: str, keep_b: str) -> DataFrame:
    """The kept elements, in the order of a merge, which moves every element once.

    A class is one block of the merge, elements of ``a`` first; so its rank and its new position follow from
    where its block begins in the merge and in the result.
    """
    sizes = both.frame.groupBy(*map(col, names)).agg(F.count_if(col(which) == 0).alias("_a"), F.count_if(col(which) == 1).alias("_b"))
    a, b = KEPT[keep_a](F.col("_a"), F.col("_b")), KEPT[keep_b](F.col("_b"), F.col("_a"))
    sizes = sizes.withColumns({"_n": F.col("_a") + F.col("_b"), "_out": (a[1] - a[0] + b[1] - b[0]).cast("long")}).persist()
    down, classes = [k for k in names if k in both.falling], sizes.count()
    blocks = running_by(sized(sizes, classes), names, "_n", "_first", down)
    blocks = running_by(sized(blocks, classes), names, "_out", "_place", down)
    blocks = blocks.select(*[col(k).alias(f"{k}_") for k in names], "_a", "_b", (F.col("_first") - F.col("_n")).alias("_first"), (F.col("_place") - F.col("_out")).alias("_place"))
    rows = Late(replace(both, columns=("v", which, *names)))
    same = F.struct(*[rows[k].alias(k) for k in names]).eqNullSafe(F.struct(*[blocks[f"{k}_"].alias(k) for k in names]))
    found = rows.join(F.broadcast(blocks) if classes <= 8 * MOST else blocks, same)
    ours = col(which) == 0
    rank = F.col("pos") - F.col("_first") - F.when(ours, 0).otherwise(F.col("_a"))
    low, high = F.when(ours, a[0]).otherwise(b[0]), F.when(ours, a[1]).otherwise(b[1])
    place = F.col("_place") + F.when(ours, 0).otherwise(a[1] - a[0]) + rank - low
    return found.filter((rank >= low) & (rank < high)).select(place.alias("pos"), "v")


def _by_key(a: DataFrame, b: DataFrame, by, descending, proj, keep_a: str, keep_b: str) -> DataFrame:
    """The kept elements of both (names in `KEPT`), those of ``a`` before equivalent ones of ``b``."""
    if order_of(a) is not None or order_of(b) is not None:
        return _by_class(*_together(a, b, by or (lambda c: c), descending, proj, proj), keep_a, keep_b)
    x, y, names, down = _classes(a, b, by, descending, proj)

    def kept(s: DataFrame, keep: str) -> DataFrame:
        low, high = KEPT[keep](F.col("_own"), F.col("_others"))
        return s.filter((F.col("_rank") >= low) & (F.col("_rank") < high))

    found = kept(x, keep_a).withColumn("_from", F.lit(0)).unionByName(kept(y, keep_b).withColumn("_from", F.lit(1)))
    return dense_pos(found.select("v", *map(col, names), F.col("_from"), F.col("pos").alias("_old")), *names, "_from", "_old", descending=down).select("pos", "v")


def set_union(a: DataFrame, b: DataFrame, by: By | None = None, descending: bool | Sequence[bool] = False, proj=None) -> DataFrame:
    """Each element as often as where it is more frequent.  With an order of its own, equivalent elements come
    from ``a`` first, as in all four set operations; both must then be sorted sequences."""
    if by is None and descending is False and proj is None:
        return _multiset(a, b, F.greatest)
    return _by_key(a, b, by, descending, proj, "all", "rest")


def set_intersection(a: DataFrame, b: DataFrame, by: By | None = None, descending: bool | Sequence[bool] = False, proj=None) -> DataFrame:
    if by is None and descending is False and proj is None:
        return _multiset(a, b, F.least)
    return _by_key(a, b, by, descending, proj, "first", "none")


def set_difference(a: DataFrame, b: DataFrame, by: By | None = None, descending: bool | Sequence[bool] = False, proj=None) -> DataFrame:
    if by is None and descending is False and proj is None:
        return _multiset(a, b, lambda m, n: m - n)
    return _by_key(a, b, by, descending, proj, "rest", "none")


def set_symmetric_difference(a: DataFrame, b: DataFrame, by: By | None = None, descending: bool | Sequence[bool] = False, proj=None) -> DataFrame:
    if by is None and descending is False and proj is None:
        return _multiset(a, b, lambda m, n: F.abs(m - n))
    return _by_key(a, b, by, descending, proj, "rest", "rest")
