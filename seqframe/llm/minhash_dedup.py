"""Near-duplicate groups of documents by their word shingles.

Method: signature-coordinate inverted join.  A signature has ``coordinates`` values, each mixed from
``minima`` minimum hashes.  Documents are posted under each coordinate-value pair of the prefix: two
signatures that agree in at least ``matches`` coordinates agree in one of the first ``coordinates -
matches + 1``, so the other postings are skipped.  Collisions are counted on the signatures and pairs
of at least ``matches`` are confirmed on the full shingle sets.

Groups are found without listing all pairs of a posting list.  Equal sets are one class.  Every list
first links its members to its smallest one; the confirmed links give components.  Members of lists that
still hold several components are not counted pair by pair, which would take the square of a list: they are
paired across components by an exact prefix filter on their shingles (`prefix_pairs`), an addition to the
method that overlooks nothing, and those pairs are confirmed too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _tokens as tk
from ._repeats import longs
from ._shared import Scratch, cut, named
from ._shingles import shingle_sets, signatures

SIGNATURE_SCHEMA = "doc_id long, mark long, n_shingles long, set_hash binary, signature array<long>"


def sketch(docs: DataFrame, words: int, coordinates: int, minima: int) -> DataFrame:
    """Set size, 128-bit hash of the set's 64-bit shingle hashes, and signature (null for an empty set) of every text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.small(batches):
            raw, off = tk.utf8(batch.column("text"))
            for i, j, h, o in shingle_sets(raw, off, words):
                size = np.diff(o)
                sig = signatures(h, o, coordinates, minima)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * coordinates, pa.int32()), longs(sig.ravel()), mask=pa.array(size == 0))
                sets = pa.array([xxhash.xxh3_128_digest(h[a:b].tobytes()) if b > a else None for a, b in zip(o[:-1], o[1:])], pa.binary())
                own = [batch.column(c).slice(i, j - i) for c in ("doc_id", "mark")]
                yield pa.RecordBatch.from_arrays([*own, longs(size), sets, lists], ["doc_id", "mark", "n_shingles", "set_hash", "signature"])

    return marked(docs).mapInArrow(scan, SIGNATURE_SCHEMA)


def marked(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, text``; the mark, a hash of the text, tells rows of one id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")


def shingle_set(text: bytes, words: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves: tuples of lower-case words; one shorter tuple for a text of fewer words."""
    w = text.lower().split()
    return set(zip(*[w[i:] for i in range(words)])) if len(w) >= words else {tuple(w)} - {()}


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int, scratch: Scratch, chunk: int = 512) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets hold ``100 * intersection >= percent * union``, by the words themselves.

    ``texts`` gives ``id, text``.  The set of ``b`` meets those of its partners one after another; a ``b`` of
    many partners is dealt over several tasks.
    """
    parts = scratch.cut(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("parts")), "parts")
    sides = pairs.join(parts, "b").select("b", F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part"), F.lit(1).alias("side"), F.col("a").alias("id"))
    heads = parts.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("b").alias("id"))
    rows = sides.unionByName(heads).join(texts, "id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, at = set(), None
        for batch in tk.small(batches):
            b, side, ids = (batch.column(c).to_numpy() for c in ("b", "side", "id"))
            left, right = [], []
            for k, text in enumerate(batch.column("text")):
                own = shingle_set(text.as_py().encode(), words)
                if side[k] == 0:
                    head, at = own, b[k]
                elif at == b[k]:
                    common = len(head & own)
                    if 100 * common >= percent * (len(head) + len(own) - common):
                        left.append(ids[k])
                        right.append(b[k])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return rows.repartition("b", "part").sortWithinPartitions("b", "part", "side").select("b", "side", "id", "text").mapInArrow(meet, "a long, b long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, component`` (smallest id reachable) of every id in ``edges`` (``a``, ``b``).

    Alternates large-star and small-star steps; each step cuts lineage in the shared folder and the
    number of steps grows with the logarithm of the longest path.
    """
    now = scratch.cut(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).head()
        if mark == state:
            ends = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
            return scratch.cut(ends.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()), "components")
        state = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = scratch.cut(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = scratch.cut(small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a != b").distinct(), "small-star")


def prefix_pairs(members: DataFrame, texts: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs of ``members`` (id, n_shingles, component) across components that may be linked.

    Exact prefix and position filter: with the shingles of all members in one order, rare ones first, a
    linked pair shares one within the first (1 - t) of the larger set and the first (1 - t) / (1 + t) of
    the smaller one, and no more shingles than either has left from there.  Copies with many edits of
    their own thus meet hardly anybody, however large their group is.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.small(batches):
            raw, off = tk.utf8(batch.column("text"))
            for i, j, h, o in shingle_sets(raw, off, words):
                ids = np.repeat(batch.column("id").to_numpy()[i:j], np.diff(o))
                yield pa.RecordBatch.from_arrays([longs(ids), longs(h)], ["id", "h"])

    some = texts.join(members.select("id"), "id", "left_semi")
    each = scratch.cut(some.mapInArrow(explode, "id long, h long"), "shingles")
    df = scratch.cut(each.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("id").alias("id")), "frequencies")
    alone = df.filter("df = 1").groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    n = F.col("n_shingles")
    long = n - F.ceil(n * percent / 100) + 1
    short = n - F.ceil(2 * percent * n / (100 + percent)) + 1
    able = members.join(alone, "id", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    able = scratch.cut(able.withColumns({"long": long, "short": short}).filter("alone < long"), "able")
    shared = each.join(df.filter("df > 1").select("h", "df"), "h").join(able, "id")
    place = F.col("alone") + F.row_number().over(Window.partitionBy("id").orderBy("df", "h")) - 1
    first = scratch.cut(shared.withColumn("place", place).filter("place < long").select("h", "id", "component", "n_shingles", "place", "short"), "prefixes")
    x = first.select("h", F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("component").alias("c_a"), F.col("place").alias("p_a"))
    y = first.filter("place < short").select("h", F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("component").alias("c_b"), F.col("place").alias("p_b"))
    most = F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b"))
    sizes = (F.col("n_b") <= F.col("n_a")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
    fits = sizes & (F.col("c_a") != F.col("c_b")) & ((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b")))
    return x.join(y, "h").filter(fits).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def without_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one of smallest id; all columns stay.

    Rows with a null ``doc_id`` stay.  Rows sharing a ``doc_id`` are one document and stay together.
    """
    kept = near_duplicates(docs, words, percent).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(cut(kept, "kept"), "doc_id", "left_semi").select(*named(docs.columns)).unionByName(docs.filter("doc_id IS NULL"))


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, coordinates: int = 32, minima: int | None = None, matches: int = 4
) -> DataFrame:
    """Group documents whose sets of ``words``-word shingles have a Jaccard similarity of ``percent`` or more.

    Needs ``doc_id`` (integer) and ``text``; other columns are ignored.  Returns one row per input
    row: ``doc_id, n_shingles, component_id`` (smallest ``doc_id`` reachable over links, itself
    included), ``kept`` (``doc_id`` = ``component_id``).

    A text of fewer than ``words`` words is one shingle; a text without words, or null, is linked with
    nothing.  Rows sharing a ``doc_id`` belong to one group, whatever their texts; those without words stay
    alone.  A row whose ``doc_id`` is null is linked with nothing and kept.  An empty table gives an empty
    result.  By default ``minima`` is chosen so that a pair at the threshold agrees in half of the
    coordinates or more; it is then overlooked with a probability below 1e-6.
    """
    minima = minima or max(1, int(np.log(0.5) / np.log(percent / 100)))
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        sketches = cut(sketch(docs, words, coordinates, minima), "sketches")
        known = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        classes, same = numbered(known, scratch)
        reps = known.join(classes.select("set_hash", "doc_id", "mark", "id"), ["set_hash", "doc_id", "mark"])
        reps = scratch.cut(reps.select("id", "doc_id", "mark", "n_shingles", "signature"), "representatives")
        postings = reps.select("id", "n_shingles", F.explode(F.slice("signature", 1, coordinates - matches + 1)).alias("key"))
        lists = scratch.cut(postings.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("head")).filter("n > 1").select("key", "head"), "lists")
        members = scratch.cut(postings.join(lists, "key"), "members")
        met = members.filter("id != head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
        left = reps.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("signature").alias("s_a"))
        right = reps.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("signature").alias("s_b"))
        fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
        pairs = met.join(left, "a").join(right, "b").filter(fits & (F.size(F.array_intersect("s_a", "s_b")) >= matches)).select("a", "b")
        wanted = scratch.cut(reps.join(members.select("id").distinct(), "id", "left_semi").select("id", "doc_id", "mark").distinct(), "wanted")
        # a merge join at every size: the plan does not change where the wanted rows no longer fit a broadcast
        texts = scratch.cut(marked(docs).join(wanted.hint("merge"), ["doc_id", "mark"]).select("id", "text"), "texts")
        if texts.count() > wanted.count():  # rows equal in id and text
            texts = scratch.cut(texts.dropDuplicates(["id"]), "texts")
        links = scratch.cut(confirm(scratch.cut(pairs, "pairs"), texts, words, percent, scratch).unionByName(same), "links")
        found = components(links, scratch)

        placed = members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        placed = scratch.cut(placed.select("key", "id", "n_shingles", "component"), "placed")
        split = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("key")
        apart = scratch.cut(placed.join(scratch.cut(split, "split"), "key").select("id", "n_shingles", "component").distinct(), "apart")
        cross = scratch.cut(prefix_pairs(apart, texts, words, percent, scratch), "pairs")
        more = scratch.cut(confirm(cross, texts, words, percent, scratch), "links")
        if not more.isEmpty():
            found = components(links.unionByName(more), scratch)
        grouped = scratch.cut(classes.join(found, "id", "left").select("set_hash", "doc_id", F.coalesce("component", "id").alias("component")), "grouped")
        least = scratch.cut(grouped.groupBy("component").agg(F.min("doc_id").alias("least")), "least")
        groups = cut(grouped.join(least, "component").select("set_hash", "least"), "groups")
    out = sketches.join(groups, "set_hash", "left")
    one = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    out = out.select("doc_id", "n_shingles", one.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def numbered(known: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets: ``set_hash``, the first row (``doc_id, mark``) and a number ``id``; and the links
    (``a, b``) between the classes of rows that share a ``doc_id``.

    The number is the smallest ``doc_id``, so that a group's smallest number is its smallest id; only where
    one id stands first in several classes, all but one of them take a hash instead.
    """
    classes = known.groupBy("set_hash").agg(F.min(F.struct("doc_id", "mark")).alias("rep")).select("set_hash", "rep.doc_id", "rep.mark")
    classes = scratch.cut(classes, "classes")
    heads = scratch.cut(classes.groupBy("doc_id").agg(F.min("set_hash").alias("head")), "heads")
    number = F.when(F.col("set_hash") == F.col("head"), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "set_hash"))
    classes = scratch.cut(classes.join(heads, "doc_id").select("set_hash", "doc_id", "mark", number.alias("id")), "numbered")
    several = known.groupBy("doc_id").agg(F.min("set_hash").alias("low"), F.max("set_hash").alias("high")).filter("low != high")
    several = scratch.cut(several.select("doc_id", "low"), "several")
    rows = known.select("doc_id", "set_hash").join(several, "doc_id").filter("set_hash != low").distinct()
    a, b = classes.select("set_hash", F.col("id").alias("a")), classes.select(F.col("set_hash").alias("low"), F.col("id").alias("b"))
    return classes, rows.join(a, "set_hash").join(b, "low").select("a", "b")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id) AS n,
    string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s
  FROM (SELECT doc_id, unnest(x) AS word, generate_subscripts(x, 1) AS i
    FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents WHERE text IS NOT NULL))),
s AS (SELECT DISTINCT doc_id, s FROM w WHERE i + 4 <= n OR (n < 5 AND i = 1)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS doc_id, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id),
g AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM documents LEFT JOIN z USING (doc_id) LEFT JOIN g USING (doc_id)
"""
