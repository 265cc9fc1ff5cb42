"""Shards of near equal size from indivisible groups of equal texts.

Method: best-fit-decreasing bin packing with a balanced tree, in two levels so that no task and not
the driver holds all groups.  Tasks pack their groups, sorted by size, into crates of a fixed small
capacity; the driver packs the crates (their number depends on shards, not on documents) into the
smallest capacity for which the wanted number of shards suffices.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._packing import best_fit_decreasing, even_bins
from ._shared import cut, named

#: Groups that one packing step holds in memory.
STEP = 1 << 18


def crates(groups: DataFrame, capacity: int) -> DataFrame:
    """``key, crate``: groups (``key, bytes``) packed into crates of ``capacity``; larger groups stand alone."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, step = TaskContext.get().partitionId(), 0

        def packed(keys: list[int], sizes: list[int], step: int) -> pa.RecordBatch:
            where, _ = best_fit_decreasing(sizes, capacity)
            base = (part << 44) | (step << 28)
            cols = [pa.array(keys, pa.int64()), pa.array([base | w for w in where], pa.int64()), pa.array(sizes, pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["key", "crate", "bytes"])

        keys: list[int] = []
        sizes: list[int] = []
        for batch in batches:
            keys += batch.column("key").to_pylist()
            sizes += batch.column("bytes").to_pylist()
            if len(keys) >= STEP:
                yield packed(keys, sizes, step)
                keys, sizes, step = [], [], step + 1
        if keys:
            yield packed(keys, sizes, step)

    return groups.select("key", "bytes").sortWithinPartitions("key").mapInArrow(fill, "key long, crate long, bytes long")


def shard(docs: DataFrame, shards: int = 16, carry: list[str] | None = None, crates_per_shard: int = 128, rows_per_cell: int = 200_000) -> DataFrame:
    """Put every row into a shard so that equal texts stay together and shard sizes are near equal.

    Needs ``doc_id`` and ``text``; the columns named in ``carry`` are kept (default: all, which
    moves the texts through two shuffles), and ``size`` (UTF-8 bytes of the text plus 1;
    a null text counts as empty and forms a group with it), ``shard`` (from 0) and ``slot`` (from 0
    without gaps within a shard) replace columns of these names.  A group above the mean fills a shard
    alone.  Rows may repeat; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    names = [c for c in (docs.columns if carry is None else carry) if c not in ("size", "shard", "slot")]
    text = F.coalesce("text", F.lit(""))
    row = F.struct(*[c.alias(n) for c, n in zip(named(names), names)]) if names else F.struct(F.lit(None).alias("none"))
    # the caller's columns travel as one struct, whatever they are called
    sized = docs.select(row.alias("row"), F.col("doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.xxhash64(text).alias("key"))
    groups = cut(sized.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "groups")
    total, rows = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).head()
    packed = cut(crates(groups, max(1, total // (shards * crates_per_shard))), "crates")
    loads = packed.groupBy("crate").agg(F.sum("bytes").alias("bytes")).orderBy("crate").collect()
    bins = even_bins([r.bytes for r in loads], shards)
    plan = spark.createDataFrame([(r.crate, b) for r, b in zip(loads, bins)], "crate long, shard int")
    placed = cut(packed.join(plan, "crate").select("key", "shard"), "placed")
    cells = max(64, -(-rows // (shards * rows_per_cell)))
    put = sized.join(placed, "key").withColumn("cell", F.pmod(F.xxhash64("doc_id", "key"), F.lit(cells)))
    per_cell = put.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = cut(per_cell.select("shard", "cell", F.coalesce(before, F.lit(0)).alias("start")), "starts")
    place = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "key"))
    slots = put.withColumn("place", place).join(starts, ["shard", "cell"])
    return slots.select(*[F.col("row")[n].alias(n) for n in names], "size", "shard", (F.col("start") + F.col("place") - 1).alias("slot"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns; the texts themselves stay where they are."""
    slim = docs.select("doc_id", "text", F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"))
    return shard(slim, carry=["doc_id", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
