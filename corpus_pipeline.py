"""From raw documents to shards: toxic texts and near copies go, benchmark passages go, sources are mixed.

Each stage is a function of (spark, docs, sf_dir); the columns of ``documents`` pass through all stages
but the last.  No stage can be written in SQL as a whole (trained model, signatures), so ``ORACLE_SQL``
is None and the tests compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.llm import decontamination, minhash_dedup, mixing, sharding, toxicity
from seqframe.llm._shared import cut, packed, table

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies stays."""
    return minhash_dedup.without_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources reach their token targets."""
    row = packed(docs, "doc_id", "text", "source")
    mixed = mixing.mix(row, carry=["_row"])
    copies = F.explode(F.array_repeat("_row", F.col("copies").cast("int"))).alias("_row")
    return mixed.select(copies).select("_row.*")


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with their shard and place in it; equal texts share a shard."""
    return sharding.shard(docs, carry=["doc_id", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", into_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
