"""Incremental removal of word windows that were seen before.

Method: a log-structured fingerprint index.  Each batch of documents becomes a sorted immutable run: the
distinct phrases of its texts, a phrase being all windows around one trigger (`_tokens.runs`), with their
first occurrence.  Runs are bucketed by fingerprint, so a batch is merge-joined with the runs of earlier
batches bucket by bucket, and history is read but never moved.  Phrases that share a fingerprint are
compared word by word unless the 64-bit BLAKE2b digests of their words are equal too.  Once ``fanout`` runs
have gathered they are compacted, bucket by bucket, into one.  A manifest in the folder names the runs, so
an index can be opened again.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._repeats import apply_spans, covered_spans, occurrence, phrases, unpack
from ._shared import Scratch, delete, shared_dir


def seen_windows(rows: list[dict], width: int) -> list[np.ndarray]:
    """For each phrase, in order of trigger and position, which windows an earlier phrase of the trigger holds."""
    out, seen, key = [], set(), None
    for row in rows:
        if row["key"] != key:
            key, seen = row["key"], set()
        words, n = row["segment"].split(b" "), int(unpack(row["place"])[1])
        windows = [b" ".join(words[j : j + width]) for j in range(n)]
        out.append(np.array([w in seen for w in windows], bool))
        seen.update(windows)
    return out


def _firsts(first: str) -> list:
    return [F.col(f"{first}.{c}").alias(c) for c in ("doc", "mark", "place")]


class FingerprintIndex:
    """Runs of window fingerprints in a folder that all executors see.

    ``width`` words form a window, ``gram`` of them its fingerprint.  ``fanout`` runs are compacted.  All runs
    have the same number of ``buckets``; one task reads a bucket of each.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, width: int = 20, gram: int = 5, fanout: int = 4, buckets: int = 8):
        self.spark, self.width, self.gram, self.fanout, self.buckets = spark, width, gram, fanout, buckets
        self.path = path or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        self.runs: list[str] = []
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index that another session left in ``path``."""
        last = spark.read.json(f"{path}/manifest-*").orderBy(F.desc("version")).head()
        index = cls(spark, path, last["width"], last["gram"], last["fanout"], last["buckets"])
        index.version, index.runs = last["version"], list(last["runs"])
        for run in index.runs:
            columns = "doc BIGINT, mark INT, place BIGINT, key BIGINT, ext BIGINT"
            spark.sql(f"CREATE TABLE IF NOT EXISTS {run} ({columns}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {index.buckets} BUCKETS LOCATION '{path}/{run}'")
        return index

    def _write(self, run: DataFrame, label: str) -> str:
        name = f"seqframe_{label}_{uuid.uuid4().hex}"
        picked = run.select("doc", "mark", "place", "key", "ext").sortWithinPartitions("key")
        picked.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.path}/{name}").saveAsTable(name, format="parquet")
        return name

    def _commit(self, runs: list[str]) -> None:
        """The manifest of the next version; files of runs that it no longer names are deleted after it."""
        gone, self.runs, self.version = [r for r in self.runs if r not in runs], runs, self.version + 1
        row = [(self.version, self.width, self.gram, self.fanout, self.buckets, runs)]
        kinds = "version long, width int, gram int, fanout int, buckets int, runs array<string>"
        self.spark.createDataFrame(row, kinds).coalesce(1).write.json(f"{self.path}/manifest-{self.version:06d}")
        for run in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
            delete(self.spark, f"{self.path}/{run}")

    def met(self, run: str) -> DataFrame | None:
        """What earlier runs hold under the fingerprints of ``run``: a merge join of buckets."""
        keys, found = self.spark.table(run).select("key"), None
        for old in self.runs:
            part = self.spark.table(old).join(keys, "key", "left_semi")
            found = part if found is None else found.unionByName(part)
        return found

    def add(self, batch: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
        """Index ``batch`` and return what is left of it (see `substring_dedup` for the columns).

        ``earlier`` gives ``doc_id, text`` of the batches added before; hits that differ as phrases are compared on it.
        """
        with Scratch(self.spark) as scratch:
            runs, texts = scratch.cut(phrases(batch, "words", self.width, self.gram), "phrases"), batch.select("doc_id", "text")
            firsts = runs.groupBy("key", "ext").agg(F.min(occurrence()).alias("first")).select("key", "ext", *_firsts("first"))
            run = self._write(firsts.repartition(self.buckets, "key"), "run")
            if self.runs:
                runs = runs.unionByName(scratch.cut(self.met(run), "met"))
                texts = texts.unionByName(earlier.select("doc_id", "text"))
            spans = covered_spans(texts, kind="words", width=self.width, gram=self.gram, mode="earlier", resolve=seen_windows, runs=runs)
        self._commit([*self.runs, run])
        if len(self.runs) >= self.fanout:
            self.compact()
        return apply_spans(batch, spans, "words")

    def compact(self) -> None:
        """Merge all runs, bucket by bucket, into one run of first occurrences."""
        setting = "spark.sql.requireAllClusterKeysForCoPartition"
        before = self.spark.conf.get(setting)
        # rows of equal key and ext are in the same bucket of every run already
        self.spark.conf.set(setting, "false")
        try:
            merged = None
            for run in self.runs:
                own = self.spark.table(run).select("key", "ext", occurrence().alias("own"))
                if merged is None:
                    merged = own.withColumnRenamed("own", "first")
                else:
                    merged = merged.join(own, ["key", "ext"], "full").select("key", "ext", F.least("first", "own").alias("first"))
            name = self._write(merged.select("key", "ext", *_firsts("first")), "compact")
        finally:
            self.spark.conf.set(setting, before)
        self._commit([name])


def substring_dedup(docs: DataFrame, width: int = 20, gram: int = 5, batches: int = 2, fanout: int = 4, bucket_bytes: int = 64 << 20) -> DataFrame:
    """Remove every word covered by a window of ``width`` words that also starts earlier.

    Earlier means in a document of smaller ``doc_id``, or before in the same text; windows are judged
    on the input.  Words are runs of characters other than 0x20 and 0x09 to 0x0D.  Needs ``doc_id``
    (integer) and ``text``; other columns are ignored.  ``batches`` ranges of ``doc_id`` pass through
    one `FingerprintIndex` in order, which is compacted at ``fanout`` runs; neither changes the result.
    A bucket of the index is meant for ``bucket_bytes`` of text.

    Returns one row per input row: ``doc_id, n_tokens`` (words), ``n_removed, spans`` (maximal removed
    word ranges), ``kept`` (UTF-8, one space between words).  Null texts count as empty; shorter texts
    than a window lose nothing.  Rows sharing a ``doc_id`` but not the text stand in the order of a hash
    of their texts; rows equal in both are one document, and the first of equal windows stays in each.
    Rows with a null ``doc_id`` stand behind all others.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ranks = [i / batches for i in range(1, batches)] or [1.0]
    known = docs.agg(F.percentile_approx("doc_id", ranks).alias("b"), F.sum(F.octet_length("text")).alias("n")).head()
    bounds = sorted(set((known.b or [])[: batches - 1]))
    index = FingerprintIndex(spark, width=width, gram=gram, fanout=fanout, buckets=min(1 << 16, max(8, -(-(known.n or 0) // bucket_bytes))))
    out, low = None, None
    for high in [*bounds, None]:
        part = docs if low is None else docs.filter((F.col("doc_id") > low) | F.col("doc_id").isNull())
        part = part if high is None else part.filter(F.col("doc_id") <= high)
        left = index.add(part, docs.filter(F.col("doc_id") <= low) if low is not None else None)
        out, low = left if out is None else out.unionByName(left), high
    return out


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", F.col("n_tokens").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (
  SELECT doc_id, i, word, count(*) OVER (PARTITION BY doc_id) AS n,
    string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS win
  FROM (SELECT doc_id, unnest(x) AS word, generate_subscripts(x, 1) AS i
    FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS x FROM documents WHERE text IS NOT NULL))),
h AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS hit FROM w WHERE i + 19 <= n),
g AS (
  SELECT doc_id, i, word, coalesce(bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
  FROM w LEFT JOIN h USING (doc_id, i)),
k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS r, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)
"""
