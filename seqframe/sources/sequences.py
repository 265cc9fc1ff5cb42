"""Sources of sequences and lazy views.  None of them moves data beyond what its join needs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import dense_pos
from ..plans import ranking
from ..plans.ranking import Late, Order, fresh, length, order_of, sized


def read_parquet(spark: SparkSession, path: str, *keys: str, columns: dict[str, Column] | None = None) -> DataFrame:
    """A table as a sequence in the order of ``keys`` (together unique), with the named columns."""
    return sequence(spark.read.parquet(path), *keys, columns=columns)


def sequence(df: DataFrame, *keys: str, columns: dict[str, Column] | None = None) -> DataFrame:
    """``pos`` by ``keys``.  Only keys and wanted columns are read and moved."""
    picked = columns or {c: F.col(c) for c in df.columns}
    names = [f"_k{i}" for i in range(len(keys))]
    slim = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[c.alias(n) for n, c in picked.items()])
    if (total := length(slim)) > ranking.LATE:
        return Late(Order(slim, tuple(names), (), tuple(picked), total))
    out = dense_pos(sized(slim, total), *names)
    return sized(out.select("pos", *picked), length(out))


def counting(spark: SparkSession, n: int, start: int = 0) -> DataFrame:
    return sized(spark.range(n).select(F.col("id").alias("pos"), (F.col("id") + start).alias("v")), n)


iota = counting


def filled(spark: SparkSession, n: int, value) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), F.lit(value).alias("v"))


def generated(spark: SparkSession, n: int, g: Callable[[Column], Column]) -> DataFrame:
    """Element i is ``g(i)``."""
    return spark.range(n).select(F.col("id").alias("pos"), g(F.col("id")).alias("v"))


def zipped(*parts: DataFrame) -> DataFrame:
    """Tuples of the elements at equal positions: ``pos, v0, v1, ...``, as long as the shortest."""
    out = parts[0].select("pos", F.col("v").alias("v0"))
    for i, s in enumerate(parts[1:], 1):
        out = out.join(s.select("pos", F.col("v").alias(f"v{i}")), "pos")
    return out


def mapped(s: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    if (o := order_of(s)) is not None:
        was = fresh(o.frame, "_was")[0]
        again = lambda names: tuple(was if k == "v" else k for k in names)
        frame = o.frame.withColumn(was, F.col("v")) if "v" in o.keys else o.frame
        return Late(Order(frame.withColumn("v", f(F.col("v"))), again(o.keys), again(o.falling), o.columns, o.rows))
    return s.withColumn("v", f(F.col("v")))


def permuted(s: DataFrame, index: DataFrame | Callable[[Column], Column]) -> DataFrame:
    """Element i is the element of ``s`` at index i: a frame ``pos, v``, or a function of the position."""
    where = index.select("pos", F.col("v").alias("_at")) if isinstance(index, DataFrame) else s.select("pos", index(F.col("pos")).alias("_at"))
    return where.join(s.select(F.col("pos").alias("_at"), "v"), "_at").select("pos", "v")


def discarded(s: DataFrame, *columns: str) -> DataFrame:
    """Writes to these columns go nowhere."""
    return s.drop(*columns)


def all_view(s: DataFrame) -> DataFrame:
    return s


def take(s: DataFrame, n: int) -> DataFrame:
    return s.filter(F.col("pos") < n)


def drop(s: DataFrame, n: int) -> DataFrame:
    return s.filter(F.col("pos") >= n).withColumn("pos", F.col("pos") - n)


def guarded(s: DataFrame, size: int) -> DataFrame:
    """Positions outside [0, size) are not seen."""
    return s.filter((F.col("pos") >= 0) & (F.col("pos") < size))


def padded_front(s: DataFrame, n: int) -> DataFrame:
    """The first element ``n`` more times in front."""
    head = s.filter("pos = 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("pos"), "v") if n > 0 else s.filter("false")
    return head.unionByName(s.withColumn("pos", F.col("pos") + n).select("pos", "v"))
