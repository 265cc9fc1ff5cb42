"""Running values, neighbours and runs over a dense position, in buckets of positions.

Rows meet in windows over buckets; what one bucket passes on to the next is aggregated in a job of its own
(`ranking.gathered`), so the input is moved once.  A neighbour in another bucket is seen through a copy of
the row at the border, made before the exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .ranking import BUCKET, MOST, attach, carried, col, div, fresh, gathered

AGGREGATES = {
    "sum": F.sum,
    "product": F.product,
    "min": F.min,
    "max": F.max,
    "bit_and": F.bit_and,
    "bit_or": F.bit_or,
    "bit_xor": F.bit_xor,
    "and": F.bool_and,
    "or": F.bool_or,
}
COMBINE = {
    "sum": lambda a, b: a + b,
    "product": lambda a, b: a * b,
    "min": F.least,
    "max": F.greatest,
    "bit_and": lambda a, b: a.bitwiseAND(b),
    "bit_or": lambda a, b: a.bitwiseOR(b),
    "bit_xor": lambda a, b: a.bitwiseXOR(b),
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
}


def joined(op: str, a: Column, b: Column) -> Column:
    """``op`` of two values, of which either may be missing."""
    return F.coalesce(COMBINE[op](a, b), a, b)


def _upto(inclusive: bool, *parts: str):
    return Window.partitionBy(*parts).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)


def running(df: DataFrame, value: Column, op: str = "sum", name: str = "running", inclusive: bool = True, bucket: int = BUCKET) -> DataFrame:
    """Add the running ``op`` of ``value`` up to each position (before it, if not ``inclusive``).

    Nulls are skipped; where nothing came before the value is null.
    """
    b, v, near, far = fresh(df, "_b", "_v", "_near", "_far")
    while True:
        work = df.withColumns({b: div(F.col("pos"), bucket), v: value})
        known = gathered(work, [b], AGGREGATES[op](F.col(v)).alias("t"))
        if known is not None:
            break
        bucket <<= 8
    kind = known.schema["t"].dataType.simpleString()
    local = work.withColumn(near, AGGREGATES[op](F.col(v)).over(_upto(inclusive, b)))
    out = attach(local, b, carried(known, b, AGGREGATES[op]("t"), far), {far: kind})
    return out.withColumn(name, joined(op, F.col(far), F.col(near))).drop(b, v, near, far)


def beside(df: DataFrame, names: list[str], step: int, bucket: int, b: str, near: str) -> DataFrame:
    """Add the bucket ``b`` of each row and ``near``: the columns ``names`` of the row one position before (-1)
    or after (1) as a struct, null where there is none."""
    own = div(F.col("pos"), bucket)
    edge = F.pmod("pos", F.lit(bucket)) == (bucket - 1 if step < 0 else 0)
    both = df.withColumn(b, F.explode(F.when(edge, F.array(own, own - step)).otherwise(F.array(own))))
    frame = Window.partitionBy(b).orderBy("pos")
    seen = (F.lag if step < 0 else F.lead)(F.struct(*map(col, names)), 1).over(frame)
    return both.withColumn(near, seen).filter(F.col(b) == own)


def neighbour(df: DataFrame, name: str, step: int, alias: str, edge: str = "_edge", bucket: int = BUCKET) -> DataFrame:
    """Add the value of column ``name`` one position before (-1) or after (1); null at the end.

    ``edge`` tells whether there is no such position.
    """
    b, near = fresh(df, "_b", "_near")
    out = beside(df, [name], step, bucket, b, near)
    return out.withColumns({alias: F.col(near)[name], edge: F.col(near).isNull()}).drop(b, near)


def _begins(df: DataFrame, name: str, same: Callable[[Column, Column], Column] | None, bucket: int, b: str, new: str) -> DataFrame:
    """Add the bucket, and 1 where a run of equal values of ``name`` begins."""
    test = same or (lambda x, y: x.eqNullSafe(y))
    near = fresh(df, "_near")[0]
    work = beside(df, [name], -1, bucket, b, near)
    first = F.col(near).isNull() | ~F.coalesce(test(F.col(near)[name], col(name)), F.lit(False))
    return work.withColumn(new, F.when(first, 1).otherwise(0)).drop(near)


def islands(df: DataFrame, name: str, same: Callable[[Column, Column], Column] | None = None, alias: str = "island", begin: str | None = None, bucket: int = BUCKET) -> DataFrame:
    """Number the runs of consecutive equal values of ``name`` from 1; ``begin``, if given, marks their first rows."""
    b, new, far = fresh(df, "_b", "_new", "_far")
    while True:
        work = _begins(df, name, same, bucket, b, new)
        known = gathered(work, [b], F.sum(new).alias("t"))
        if known is not None:
            break
        bucket <<= 8
    out = attach(work.withColumn(alias, F.sum(new).over(_upto(True, b))), b, carried(known, b, F.sum("t"), far), {far: "long"})
    out = out.withColumn(alias, F.col(alias) + F.coalesce(far, F.lit(0)))
    return (out.withColumn(begin, F.col(new) == 1) if begin else out).drop(b, new, far)


def segment_scan(df: DataFrame, key: str, value: Column, op: str, name: str, inclusive: bool = True, same: Callable | None = None, bucket: int = BUCKET) -> DataFrame:
    """Add the running ``op`` of ``value`` that begins anew with each run of equal ``key``; null before anything came.

    A run may be as long as the sequence: a bucket passes the total of its last run on to the next.
    """
    b, new, v, run, near, far = fresh(df, "_b", "_new", "_v", "_run", "_near", "_far")
    total = AGGREGATES[op]
    while True:
        work = _begins(df, key, same, bucket, b, new).withColumn(v, value)
        work = work.withColumn(run, F.sum(new).over(_upto(True, b)))
        pieces = work.groupBy(b, run).agg(total(F.col(v)).alias("t"))
        known = gathered(pieces, [b], F.max(run).alias("runs"), F.max_by("t", run).alias("tail"))
        if known is not None:
            break
        bucket <<= 8
    ends = known.withColumn("part", F.sum(F.when(F.col("runs") > 0, 1).otherwise(0)).over(Window.orderBy(b)))
    ends = ends.withColumn("upto", total(F.col("tail")).over(Window.partitionBy("part").orderBy(b).rowsBetween(Window.unboundedPreceding, 0)))
    passed = ends.select(b, F.lag("upto", 1).over(Window.orderBy(b)).alias(far))
    kind = known.schema["tail"].dataType.simpleString()
    local = work.withColumn(near, total(F.col(v)).over(_upto(inclusive, b, run)))
    out = attach(local, b, passed, {far: kind})
    result = F.when(F.col(run) == 0, joined(op, F.col(far), F.col(near))).otherwise(F.col(near))
    return out.withColumn(name, result).drop(b, new, v, run, near, far)


def scan_with(df: DataFrame, value: str, op: Callable, init=None, name: str = "running", inclusive: bool = True, key: str | None = None, same: Callable | None = None, bucket: int = BUCKET) -> DataFrame:
    """Running value of any associative ``op`` of two Python values: for operations without a built-in.

    With ``key`` it begins anew with each run of equal keys.  Nulls are skipped.  Buckets are folded in
    parallel, in Arrow batches; one value for each, at most `ranking.MOST`, is combined on the driver.
    """
    b, new, far = fresh(df, "_b", "_new", "_far")
    kind = df.schema[value].dataType

    def steps(values: list, news: list, now) -> Iterator:
        """The value before and after each element."""
        for x, n in zip(values, news):
            if n:
                now = init
            before = now
            if x is not None:
                now = x if now is None else op(now, x)
            yield before, now

    while True:
        work = _begins(df, key, same, bucket, b, new) if key else df.withColumns({b: div(F.col("pos"), bucket), new: F.lit(0)})
        dealt = work.repartition(b).sortWithinPartitions(b, "pos")

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, now, runs, rows = None, None, 0, []
            for batch in batches:
                for bucket_, x, n in zip(*(batch.column(c).to_pylist() for c in (b, value, new))):
                    if bucket_ != at:
                        if at is not None:
                            rows.append((at, runs, now))
                        at, now, runs = bucket_, None, 0
                    if n:
                        now, runs = init, runs + 1
                    if x is not None:
                        now = x if now is None else op(now, x)
            if at is not None:
                rows.append((at, runs, now))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ends)], [f.name for f in ends])

        folded_schema = work.select(b, F.lit(0).cast("long").alias("runs"), col(value).alias("tail")).schema
        ends = to_arrow_schema(folded_schema)
        known = dealt.select(b, new, col(value)).mapInArrow(fold, folded_schema).limit(MOST + 1).collect()
        if len(known) <= MOST:
            break
        bucket <<= 8
    starts, now = [], init
    for r in sorted(known, key=lambda r: r[0]):
        starts.append((r[0], now))
        now = r.tail if r.runs else now if r.tail is None else r.tail if now is None else op(now, r.tail)
    passed = df.sparkSession.createDataFrame(starts, work.select(b, col(value).alias(far)).schema) if starts else None
    out_schema = df.select("*", col(value).alias(name)).schema
    fields, columns, added_type = to_arrow_schema(out_schema), df.columns, to_arrow_schema(folded_schema).field("tail").type

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, None
        for batch in batches:
            out = []
            for bucket_, x, n, start in zip(*(batch.column(c).to_pylist() for c in (b, value, new, far))):
                if bucket_ != at:
                    at, now = bucket_, start
                before, now = next(steps([x], [n], now))
                out.append(now if inclusive else before)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(out, added_type)], fields.names)

    moved = attach(work, b, passed, {far: kind.simpleString()}).repartition(b).sortWithinPartitions(b, "pos")
    return moved.mapInArrow(walk, out_schema)
