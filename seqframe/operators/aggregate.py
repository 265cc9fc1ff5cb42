"""Reductions, scans, differences, run-grouped operators, histograms and vectorised binary searches."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..plans import islands, neighbour, running, scan_with, segment_scan
from ..plans.ranking import col, fresh
from ..plans.scan import AGGREGATES as _TOTALS
from ..plans.scan import COMBINE as _PAIRS
from .sorting import By, keyed, running_by

#: Names of operations, and what they are called in the recipes.
SCANS = {
    "plus": "sum",
    "multiplies": "product",
    "minimum": "min",
    "maximum": "max",
    "bit_and": "bit_and",
    "bit_or": "bit_or",
    "bit_xor": "bit_xor",
    "logical_and": "and",
    "logical_or": "or",
}
AGGREGATES = {name: _TOTALS[op] for name, op in SCANS.items()}
COMBINE = {name: _PAIRS[op] for name, op in SCANS.items()}
identity = lambda c: c


def constant(value) -> Column:
    """A literal whose type an accumulator takes: whole numbers are 64 bits wide."""
    return F.lit(value).cast("long") if isinstance(value, int) and not isinstance(value, bool) else F.lit(value)


def operation(op: str | Callable, kind: T.DataType) -> str | Callable:
    """The operation as a known name, or as a function of two Python values.

    Products of whole numbers are exact: they are folded as Python numbers, as user operations are.
    """
    if callable(op):
        return op
    if op not in SCANS:
        raise ValueError(f"unknown operation {op!r}; use one of {', '.join(SCANS)} or a function")
    return _times if op == "multiplies" and isinstance(kind, T.IntegralType | T.DecimalType) else op


def _times(a, b):
    return a * b


def transform_reduce(s: DataFrame, init, op: str | Callable = "plus", unary: Callable[[Column], Column] = identity) -> DataFrame:
    """``init`` combined with ``unary`` of all elements; ``op`` is a name or an associative, commutative function."""
    kind = s.select(constant(init).alias("i")).schema["i"].dataType
    x = unary(F.col("v"))
    op = operation(op, kind)
    if callable(op):
        return _reduce_with(s.select(x.cast(kind).alias("v")), init, op, kind)
    total = AGGREGATES[op](x)
    return s.agg(F.coalesce(COMBINE[op](constant(init), total), constant(init)).cast(kind).alias("result"))


def _reduce_with(s: DataFrame, init, op: Callable, kind: T.DataType) -> DataFrame:
    """Fold each partition in Arrow batches, then the partial values, one a task, on the driver."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for x in batch.column(0).drop_null().to_pylist():
                now = x if now is None else op(now, x)
        yield pa.RecordBatch.from_arrays([pa.array([] if now is None else [now], to_arrow_type(kind))], ["v"])

    parts = [r.v for r in s.mapInArrow(fold, T.StructType([T.StructField("v", kind)])).collect()]
    return s.sparkSession.createDataFrame([(functools.reduce(op, parts, init),)], T.StructType([T.StructField("result", kind)]))


def reduce(s: DataFrame, init=0, op: str | Callable = "plus") -> DataFrame:
    return transform_reduce(s, init, op)


def inner_product(a: DataFrame, b: DataFrame, init=0, op: str = "plus", binary=lambda x, y: x * y) -> DataFrame:
    """The two-sequence form of `transform_reduce`; a sum of whole numbers is exact, whatever its size."""
    both = a.select("pos", F.col("v").alias("_a")).join(b.select("pos", F.col("v").alias("_b")), "pos")
    pairs = both.select(binary(F.col("_a"), F.col("_b")).alias("v"))
    whole = isinstance(init, int) and not isinstance(init, bool) and isinstance(pairs.schema["v"].dataType, T.IntegralType)
    return _whole_sum(pairs, init) if op == "plus" and whole else transform_reduce(pairs, init, op)


def _whole_sum(s: DataFrame, init: int) -> DataFrame:
    """``init`` and all whole numbers of ``s``, summed with 38 digits: a long, or a decimal where 64 bits do not hold it."""
    total = init + int(s.agg(F.sum(F.col("v").cast("decimal(20,0)")).cast("decimal(38,0)")).head()[0] or 0)
    kind = "long" if -(1 << 63) <= total < 1 << 63 else "decimal(38,0)"
    return s.sparkSession.createDataFrame([(total if kind == "long" else Decimal(total),)], f"result {kind}")


def inclusive_scan(s: DataFrame, op: str | Callable = "plus", init=None, unary: Callable[[Column], Column] = identity, bucket: int | None = None) -> DataFrame:
    """Running value with each element; ``init``, if given, goes first and sets the type."""
    return _scanned(s, op, init, unary, True, bucket)


def exclusive_scan(s: DataFrame, init=0, op: str | Callable = "plus", unary: Callable[[Column], Column] = identity) -> DataFrame:
    """Running value before each element; the first is ``init``, which sets the type."""
    return _scanned(s, op, init, unary, False, None)


def _scanned(s: DataFrame, op: str | Callable, init, unary: Callable, inclusive: bool, bucket: int | None) -> DataFrame:
    work = s.withColumn("v", unary(F.col("v")))
    kind = work.schema["v"].dataType if init is None else s.select(constant(init).alias("i")).schema["i"].dataType
    op, r, more = operation(op, kind), fresh(work, "_r")[0], {"bucket": bucket} if bucket else {}
    if callable(op):
        out = scan_with(work.withColumn("v", F.col("v").cast(kind)), "v", op, init, r, inclusive, **more)
        return out.withColumn("v", F.col(r)).drop(r)
    out = running(work, F.col("v"), SCANS[op], r, inclusive, **more)
    value = F.col(r) if init is None else F.coalesce(COMBINE[op](F.lit(init), F.col(r)), F.lit(init))
    return out.withColumn("v", value.cast(kind)).drop(r)


def transform_inclusive_scan(s: DataFrame, op: str | Callable, unary: Callable[[Column], Column], init=None) -> DataFrame:
    return inclusive_scan(s, op, init, unary)


def transform_exclusive_scan(s: DataFrame, init, op: str | Callable, unary: Callable[[Column], Column]) -> DataFrame:
    return exclusive_scan(s, init, op, unary)


def adjacent_difference(s: DataFrame, op: Callable[[Column, Column], Column] = lambda a, b: a - b) -> DataFrame:
    """The first element, then ``op`` of each element and the one before."""
    before, edge = fresh(s, "_before", "_edge")
    out = neighbour(s, "v", -1, before, edge)
    return out.withColumn("v", F.when(F.col(edge), F.col("v")).otherwise(op(F.col("v"), F.col(before)))).select(*map(col, s.columns))


def reduce_by_segment(s: DataFrame, op: str | Callable = "plus", same=None) -> DataFrame:
    """One row for each run of consecutive equal keys ``k``: ``pos, k, v``; the first key stands for the run.

    ``op`` is a name or an associative function of two values, ``same`` a test of neighbouring keys.
    """
    op = operation(op, s.schema["v"].dataType)
    work = s.select("pos", "k", "v")
    if callable(op):
        work = scan_with(work, "v", op, None, "r", key="k", same=same)
        total = F.max_by("r", "pos")
    else:
        total = AGGREGATES[op](F.col("v"))
    out = islands(work, "k", same).groupBy("island").agg(F.min_by("k", "pos").alias("k"), total.alias("v"))
    return out.select((F.col("island") - 1).alias("pos"), "k", "v")


def inclusive_scan_by_segment(s: DataFrame, op: str | Callable = "plus", same=None) -> DataFrame:
    """Running value that begins anew with each run of equal keys.

    A run may be as long as the sequence, so it is scanned in buckets whose totals are carried on.
    """
    return _by_segment(s, op, True, None, same)


def exclusive_scan_by_segment(s: DataFrame, init=0, op: str | Callable = "plus", same=None) -> DataFrame:
    """Running value before each element of its run; the first of each run is ``init``."""
    return _by_segment(s, op, False, init, same)


def _by_segment(s: DataFrame, op: str | Callable, inclusive: bool, init, same) -> DataFrame:
    r, op = fresh(s, "_r")[0], operation(op, s.schema["v"].dataType)
    if callable(op):
        out = scan_with(s, "v", op, init, r, inclusive, "k", same)
        return out.withColumn("v", F.col(r)).select(*map(col, s.columns))
    out = segment_scan(s, "k", F.col("v"), SCANS[op], r, inclusive, same)
    value = F.col(r) if inclusive else F.coalesce(COMBINE[op](F.lit(init), F.col(r)), F.lit(init))
    return out.withColumn("v", value).select(*map(col, s.columns))


reduce_by_key, inclusive_scan_by_key, exclusive_scan_by_key = reduce_by_segment, inclusive_scan_by_segment, exclusive_scan_by_segment


def _all_bins(counts: DataFrame, bins: int) -> DataFrame:
    empty = counts.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return empty.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(s: DataFrame, bins: int, low, high) -> DataFrame:
    """Counts in ``bins`` equal bins of [low, high); others are left out, empty bins are 0.

    Whole numbers use whole-number arithmetic, as bin = (v - low) * bins div (high - low).
    """
    v = F.col("v")
    if s.schema["v"].dataType.typeName() in ("float", "double"):
        bin_ = F.floor((v - low) * F.lit(bins / (high - low)))
    else:
        bin_ = F.expr(f"CAST((CAST(v AS DECIMAL(20,0)) - {low}) * {bins} AS DECIMAL(38,0)) div {high - low}")
    inside = s.filter((v >= low) & (v < high)).select(F.least(bin_, F.lit(bins - 1)).cast("long").alias("bin"))
    return _all_bins(inside.groupBy("bin").agg(F.count(F.lit(1)).alias("n")), bins)


def below(bounds: list[float], c: Column) -> Column:
    """How many of the sorted ``bounds`` are below ``c``, by nested comparisons."""

    def tree(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        mid = (a + b) // 2
        return F.when(c <= F.lit(bounds[mid]), tree(a, mid)).otherwise(tree(mid + 1, b))

    return tree(0, len(bounds))


def histogram_bounds(s: DataFrame, bounds: Sequence) -> DataFrame:
    """Counts between consecutive sorted ``bounds`` (a bounded list), each bin half open."""
    v = F.col("v").cast("double")
    edges = [float(b) for b in bounds]
    # bounds at or below v: those below the next larger value
    at_most = below(edges, v) + F.when(v.isin(edges), 1).otherwise(0)
    inside = s.filter((v >= edges[0]) & (v < edges[-1])).select((at_most - 1).cast("long").alias("bin"))
    return _all_bins(inside.groupBy("bin").agg(F.count(F.lit(1)).alias("n")), len(edges) - 1)


def _answer(s: DataFrame, queries: DataFrame, name: str, by: By | None, descending, proj) -> DataFrame:
    """Counts of elements before each query (``lower``), and not behind it (``upper``).

    Only counts of distinct values are ordered; a query may be null, which stands first.
    """
    x, names, down = keyed(s.select("v"), by or (lambda c: c), descending, proj)
    y, other, _ = keyed(queries.select("pos", "v"), by or (lambda c: c), descending, proj)
    points = x.select(F.struct(*[col(k) for k in names]).alias("p"), F.lit(1).alias("c"))
    points = points.unionByName(y.select(F.struct(*[col(o).alias(k) for o, k in zip(other, names)]).alias("p"), F.lit(0).alias("c")))
    counts = points.groupBy("p").agg(F.sum("c").alias("c")).select(*[F.col("p")[k].alias(k) for k in names], "c")
    out = running_by(counts, names, "c", "upper", down)
    out = out.select(F.struct(*names).alias("p"), (F.col("upper") - F.col("c")).alias("lower"), "upper", (F.col("c") > 0).alias("found"))
    asked = y.select("pos", "v", F.struct(*[col(o).alias(k) for o, k in zip(other, names)]).alias("_q"))
    return asked.join(out, F.col("_q").eqNullSafe(F.col("p"))).select("pos", "v", F.col(name).alias("result"))


def lower_bound(s: DataFrame, queries: DataFrame, by: By | None = None, descending: bool | Sequence[bool] = False, proj=None) -> DataFrame:
    """For each query the first place where it could be inserted."""
    return _answer(s, queries, "lower", by, descending, proj)


def upper_bound(s: DataFrame, queries: DataFrame, by: By | None = None, descending: bool | Sequence[bool] = False, proj=None) -> DataFrame:
    """For each query the last place where it could be inserted."""
    return _answer(s, queries, "upper", by, descending, proj)


def binary_search(s: DataFrame, queries: DataFrame, by: By | None = None, descending: bool | Sequence[bool] = False, proj=None) -> DataFrame:
    """For each query whether the sequence holds it."""
    return _answer(s, queries, "found", by, descending, proj)
