"""Dense positions and running totals in an order, without a window over one partition.

Rows are dealt into ordered buckets whose number follows from the number of rows.  What is known of a
whole bucket (its count, its total) is aggregated in a job of its own and comes back as a small frame of
at most `MOST` rows, so that the plan which is returned reads its input once and moves it once.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.classic.dataframe import DataFrame as ClassicDataFrame
from pyspark.sql.internal import InternalFunction

#: Rows that a bucket is meant to hold.
BUCKET = 1 << 16
#: Buckets of one sequence at most: the bound on what the driver and a broadcast hold.
MOST = 1 << 17
#: Bounds of other types than whole numbers that are compared in compiled code; more are searched in an array.
TREE = 255
#: Sequences of more rows are known by the keys of their order until something reads their positions.
LATE = 1 << 18
#: Sampled keys from which bounds are chosen, at most.
SAMPLE = 1 << 20


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` does not use, whatever its columns are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def div(a: Column, b: Column | int) -> Column:
    """Whole-number division, exact for 64-bit numbers."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def attach(df: DataFrame, on: str, known: DataFrame | None, names: dict[str, str]) -> DataFrame:
    """Add what is known of each bucket ``on``.  ``known`` has at most `MOST` rows; None stands for no row.

    ``names`` maps the added columns to their types.
    """
    if known is None:
        return df.withColumns({n: F.lit(None).cast(t) for n, t in names.items()})
    key = fresh(df, "_on")[0]
    small = known.select(F.col(on).alias(key), *names)
    return df.join(F.broadcast(small), df[on] == small[key], "left").drop(key)


def carried(known: DataFrame, on: str, total: Column, name: str) -> DataFrame | None:
    """``on, name``: ``total`` (an aggregate) over the buckets before each; None for one bucket.  At most `MOST` rows meet."""
    if length(known) <= 1:
        return None
    return known.select(on, total.over(Window.orderBy(on).rowsBetween(Window.unboundedPreceding, -1)).alias(name))


def gathered(df: DataFrame, keys: Sequence[str], *totals: Column) -> DataFrame | None:
    """Totals of each bucket as a local frame, or None if there are more than `MOST` of them."""
    found = df.groupBy(*keys).agg(*totals).limit(MOST + 1)
    rows = found.collect()
    return None if len(rows) > MOST else sized(df.sparkSession.createDataFrame(rows, found.schema), len(rows))


def length(df: DataFrame) -> int:
    """Number of rows; counted once for a frame that a recipe made (`sized`)."""
    known = getattr(df, "_rows", None)
    return df.count() if known is None else known


def sized(df: DataFrame, rows: int) -> DataFrame:
    """Remember how many rows this frame has.  Frames derived from it do not inherit that."""
    df._rows = rows
    return df


def _monotone(df: DataFrame, name: str) -> Column:
    """The column in a type whose values pass through the driver unchanged and in the same order."""
    kind, c = df.schema[name].dataType, col(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.to_utc_timestamp(c, "UTC"))
    return F.unix_date(c) if isinstance(kind, T.DateType) else c


def leveled(df: DataFrame, level: str, keys: Sequence[str], descending: Sequence[str] = (), tie: str | None = None, rows: int = BUCKET) -> tuple[DataFrame, int]:
    """Add the number of each row's bucket in the order of ``keys``, then ``tie``; and how many rows there are.

    Bounds are whole keys, of any type and with the tie, taken at even ranks of a sample: neither a value
    that many rows hold nor a prefix that many strings share brings them together.  Where directions are
    mixed, numbers and dates are turned round; only the keys before another type of the other direction choose the bucket.
    """
    down = keys[0] in descending
    lead = []
    for k in keys:
        if (k in descending) == down:
            lead.append(_monotone(df, k))
        elif (other := _inverted(df, k)) is not None:
            lead += other
        else:
            break
    else:
        if tie:
            lead.append(-col(tie) if down else col(tie))
    total = length(df)
    buckets = min(MOST, -(-total // rows))
    if buckets <= 1:
        return df.withColumn(level, F.lit(0)), total
    key = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(lead)])
    share = min(1.0, min(64 * buckets, SAMPLE) / total)
    sampled = df.select(key.alias("k")) if share == 1.0 else df.select(key.alias("k")).sample(share, 17)
    ranks = F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)), lambda i: F.get("s", F.floor(i.cast("long") * F.size("s") / buckets).cast("int")))
    found = sampled.agg(F.sort_array(F.collect_list("k")).alias("s")).select(F.array_distinct(F.filter(ranks, lambda x: x.isNotNull())).alias("b"))
    bounds = found.head()[0]
    fields = found.schema["b"].dataType.elementType.fields
    # as many keys as tell the bounds apart: one, unless a value is frequent
    n = next((n for n in range(1, len(lead) + 1) if len({tuple(x[:n]) for x in bounds}) == len(bounds)), len(lead))
    if all(isinstance(f.dataType, T.IntegralType) for f in fields[:n]):
        below = _ranked(bounds, lead[:n])
    else:
        below = _tree(bounds, lead[:n], fields[:n]) if len(bounds) <= TREE else _halving(bounds, lead[:n], fields)
    return df.withColumn(level, F.lit(len(bounds)) - below if down else below), total


def _inverted(df: DataFrame, name: str) -> list[Column] | None:
    """Keys in whose rising order the column falls, nulls last and NaN first; None for types that cannot be turned round."""
    kind, c = df.schema[name].dataType, _monotone(df, name)
    if isinstance(kind, T.IntegralType | T.TimestampType | T.TimestampNTZType | T.DateType):
        return [c.isNull().cast("int"), F.bitwise_not(c)]
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return [c.isNull().cast("int"), (~F.isnan(c)).cast("int"), -c]
    return None


def _found(values: list[int], key: Column) -> Column:
    """The index of ``key`` in ascending whole numbers, or -1 - the index where it would be."""
    return InternalFunction.array_binary_search(F.from_json(F.lit(json.dumps(values)), T.ArrayType(T.LongType())), key.cast("long"))


def _ranked(bounds: list, lead: list[Column]) -> Column:
    """How many bounds are below a row's key of whole numbers, by one binary search for each of its columns.

    A column's place among its values in the bounds, odd where it equals one, is as good as the column: the
    places of all columns make one number, which is searched among those of the bounds.
    """
    place = lambda at: F.abs(at * F.lit(2.0) + F.lit(1.5)) - F.lit(0.5)  # noqa: E731  (at is used once: it is not computed twice)
    now, codes = None, [0] * len(bounds)
    for i, c in enumerate(lead):
        held = sorted({b[i] for b in bounds if b[i] is not None})
        index = {x: 2 * k + 2 for k, x in enumerate(held)}
        ranks = [0 if b[i] is None else index[b[i]] for b in bounds]
        rank = F.coalesce((place(_found(held, c)) + F.lit(1.0)).cast("long"), F.lit(0).cast("long"))
        if now is None:
            now, codes = rank, ranks
            continue
        if i > 1:
            distinct = sorted(set(codes))
            index = {x: 2 * k + 1 for k, x in enumerate(distinct)}
            now, codes = place(_found(distinct, now)).cast("long"), [index[x] for x in codes]
        width = 2 * len(held) + 2
        now, codes = now * F.lit(width).cast("long") + rank, [x * width + r for x, r in zip(codes, ranks)]
    return (F.abs(_found(codes, now) + F.lit(0.5)) - F.lit(0.5)).cast("int")


def _tree(bounds: list, lead: list[Column], fields: list[T.StructField]) -> Column:
    """How many bounds are below a row's key, by nested comparisons (compiled)."""
    literal = lambda x, f: F.lit(x).cast(f.dataType)

    def at_most(bound) -> Column:
        if len(lead) > 1:
            return F.struct(*[c.alias(f.name) for c, f in zip(lead, fields)]) <= F.struct(*[literal(x, f).alias(f.name) for x, f in zip(bound, fields)])
        return lead[0].isNull() if bound[0] is None else F.coalesce(lead[0] <= literal(bound[0], fields[0]), F.lit(True))

    def node(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        mid = (a + b) // 2
        return F.when(at_most(bounds[mid]), node(a, mid)).otherwise(node(mid + 1, b))

    return node(0, len(bounds))


def _halving(bounds: list, lead: list[Column], fields: list[T.StructField]) -> Column:
    """The same for many bounds, as a search in one literal array."""
    kind = T.ArrayType(T.StructType(fields[: len(lead)]))
    rows = F.from_json(F.lit(_json([tuple(b[: len(lead)]) for b in bounds], fields)), kind) if _jsonable(fields[: len(lead)]) else F.array(*[F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(b, fields[: len(lead)])]) for b in bounds])
    key = F.struct(*[c.alias(f.name) for c, f in zip(lead, fields)])
    strides = F.array(*[F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(strides, F.lit(0), lambda at, s: F.when(F.get(rows, at + s - 1) < key, at + s).otherwise(at))


def _jsonable(fields: list[T.StructField]) -> bool:
    return all(isinstance(f.dataType, T.IntegralType | T.StringType) for f in fields)


def _json(bounds: list[tuple], fields: list[T.StructField]) -> str:
    return json.dumps([{f.name: x for x, f in zip(b, fields)} for b in bounds])


def ordering(keys: Sequence[str], descending: Sequence[str] = (), tie: str | None = None) -> list[Column]:
    order = [col(k).desc_nulls_last() if k in descending else col(k).asc_nulls_first() for k in keys]
    return [*order, col(tie).asc()] if tie else order


def dense_pos(df: DataFrame, *keys: str, descending: Sequence[str] = (), tie: str | None = None, pos: str = "pos", rows: int = BUCKET) -> DataFrame:
    """Add ``pos``: dense from 0 in the order of ``keys`` (nulls first, NaN last), then ``tie``.

    ``tie`` is an integer column, such as an older position.  ``rows`` is what a bucket is meant to hold.
    """
    level, own, start = fresh(df, "_level", "_own", "_start")
    work, total = leveled(df, level, keys, descending, tie, rows)
    place = F.row_number().over(Window.partitionBy(level).orderBy(*ordering(keys, descending, tie)))
    if total <= rows:
        return sized(work.withColumn(pos, place.cast("long") - 1).drop(level), total)
    counts = gathered(work, [level], F.count(F.lit(1)).alias("n"))
    out = attach(work.withColumn(own, place), level, carried(counts, level, F.sum("n"), start), {start: "long"})
    return sized(out.withColumn(pos, F.coalesce(start, F.lit(0)).cast("long") + F.col(own) - 1).drop(level, own, start), total)


@dataclass(frozen=True)
class Order:
    """Rows without positions and the keys, together unique, of their order; ``columns`` are those of the sequence."""

    frame: DataFrame
    keys: tuple[str, ...]
    falling: tuple[str, ...]
    columns: tuple[str, ...]
    rows: int

    @property
    def by(self) -> list[Column]:
        return ordering(self.keys, self.falling)


class Late(ClassicDataFrame):
    """A sequence whose positions are made when something reads them.

    Operators that only need the order of the elements take ``order`` and move the rows once, not once for the
    positions and once more for themselves.
    """

    def __new__(cls, order: Order, rows: int = BUCKET) -> Late:
        return object.__new__(cls)

    def __init__(self, order: Order, rows: int = BUCKET):
        self._session, self._sc = order.frame.sparkSession, order.frame.sparkSession.sparkContext
        self.is_cached = self._support_repr_html = False
        self.order, self._bucket, self._rows = order, rows, order.rows

    @cached_property
    def _jdf(self):
        o = self.order
        return dense_pos(sized(o.frame.select("*"), o.rows), *o.keys, descending=o.falling, rows=self._bucket).select(*map(col, self.columns))._jdf

    @cached_property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("pos", T.LongType(), False), *[self.order.frame.schema[c] for c in self.order.columns]])


def order_of(s: DataFrame) -> Order | None:
    """The order of a sequence whose positions were not made yet."""
    return s.order if isinstance(s, Late) else None


def reordered(o: Order, frame: DataFrame, names: Sequence[str], down: Sequence[str]) -> Order:
    """``frame`` by ``names`` first and then by the order it had."""
    rest = [k for k in o.keys if k not in names]
    return Order(frame, (*names, *rest), (*down, *[k for k in rest if k in o.falling]), o.columns, o.rows)


def chosen(o: Order, keep: Column) -> Order:
    """The rows that pass."""
    frame = o.frame.filter(keep)
    return Order(frame, o.keys, o.falling, o.columns, frame.count())


def as_order(s: DataFrame) -> Order:
    """The order of any sequence; where positions were made they are its key."""
    if (o := order_of(s)) is not None:
        return o
    at = fresh(s, "_at")[0]
    return Order(s.withColumnRenamed("pos", at), (at,), (), tuple(c for c in s.columns if c != "pos"), length(s))


def chained(a: Order, b: Order, names_a: Sequence[str], names_b: Sequence[str], down: Sequence[str]) -> tuple[Order, str]:
    """Elements ``v`` of both by their keys (``names_a`` is what both are called then), those of ``a`` before equal ones
    of ``b``; and the name of the column that is 0 for ``a`` and 1 for ``b``."""
    which = "_from"
    kinds = lambda o: [(o.frame.schema[k].dataType, k in o.falling) for k in o.keys]
    shared = kinds(a) == kinds(b)
    own_a = [f"_o{i}" for i in range(len(a.keys))]
    own_b = own_a if shared else [f"_p{i}" for i in range(len(b.keys))]
    keys = [f"_n{i}" for i in range(len(names_a))]

    def side(o: Order, n: int, names: Sequence[str], own: list[str]) -> DataFrame:
        cols = [col("v"), *[col(x).alias(k) for x, k in zip(names, keys)], F.lit(n).alias(which)]
        return o.frame.select(*cols, *[col(k).alias(x) for k, x in zip(o.keys, own)])

    frame = side(a, 0, names_a, own_a).unionByName(side(b, 1, names_b, own_b), allowMissingColumns=not shared)
    falling = [k for k, n in zip(keys, names_a) if n in down]
    falling += [x for k, x in zip(a.keys, own_a) if k in a.falling] + ([] if shared else [x for k, x in zip(b.keys, own_b) if k in b.falling])
    return Order(frame, (*keys, which, *own_a, *([] if shared else own_b)), tuple(falling), ("v",), a.rows + b.rows), which


def grouped_pos(df: DataFrame, group: Column, old: str, pos: str = "pos", bucket: int = BUCKET) -> DataFrame:
    """Add ``pos``: dense from 0 in the order of ``group`` (few values), then of the old position ``old``."""
    g, b, own, start, gb = fresh(df, "_g", "_b", "_own", "_start", "_gb")
    while True:
        work = df.withColumns({g: group, b: div(col(old), bucket)})
        counts = gathered(work, [g, b], F.count(F.lit(1)).alias("n"))
        if counts is not None:
            break
        bucket <<= 8
    before = F.sum("n").over(Window.orderBy(g, b).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.struct(g, b).alias(gb), F.coalesce(before, F.lit(0)).alias(start))
    place = F.row_number().over(Window.partitionBy(g, b).orderBy(old))
    out = work.withColumn(own, place)
    joined = out.join(F.broadcast(starts), F.struct(out[g].alias(g), out[b].alias(b)) == starts[gb], "left")
    return joined.withColumn(pos, F.col(start) + F.col(own) - 1).drop(g, b, own, start, gb)


def compact(df: DataFrame, pos: str = "pos", bucket: int = BUCKET) -> DataFrame:
    """Close the gaps that a filter left in ``pos``, keeping the order."""
    old = fresh(df, "_old")[0]
    return grouped_pos(df.withColumnRenamed(pos, old), F.lit(0), old, pos, bucket).select(*map(col, df.columns))
