"""Repeated windows of a corpus, found through phrases instead of through every position.

`covered_spans` returns, for each row, the token ranges covered by windows that also start elsewhere
(``mode="elsewhere"``) or earlier (``mode="earlier"``).  The plan:

1. one scan cuts every text into phrases (`_tokens.runs`);
2. phrases whose trigger string occurs once are dropped: no window of theirs can repeat
   (counted with map-side partial aggregation, so a frequent trigger costs one row per task);
3. the rest form the dictionary: distinct phrases (by trigger and BLAKE2b digest of their bytes) with a
   count and a first occurrence.  A phrase that occurs again is settled as a whole;
4. only distinct phrases that share a trigger but differ elsewhere are compared window by window,
   with their bytes (`resolve`), in tasks keyed by trigger.  The windows of a trigger with more than
   ``hot`` different phrases are compared by 128-bit BLAKE2b digests in a partially aggregated group-by:
   the exact way for groups that do not fit one task, with the same results.

A row is known by `identified`: its ``doc_id`` and a hash of its text, so rows that share an id keep their
own ranges, and rows without an id take part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _tokens as tk
from ._shared import Scratch, cut

RUN_SCHEMA = "doc long, mark int, place long, key long, ext long"
SEGMENT_SCHEMA = "key long, doc long, mark int, place long, times long, segment binary"
SPAN_SCHEMA = "doc long, mark int, s long, e long"
HASH_SCHEMA = "h0 long, h1 long, doc long, mark int, start long, times long"

#: A place packs first token, number of windows and trigger distance of a phrase.
_BITS = 12


def identified(docs: DataFrame) -> DataFrame:
    """``doc, mark, text``: what a row is known by, and its text.

    ``doc`` is the ``doc_id``, or a hash of the text where there is none; ``mark`` is another hash of the
    text, odd where there is no id.  Rows equal in id and text share both and get the same result.
    """
    none = F.col("doc_id").isNull()
    doc = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    mark = F.hash("text").bitwiseAND(F.lit(-2)).bitwiseOR(none.cast("int"))
    return docs.select(doc.alias("doc"), mark.alias("mark"), "text")


def occurrence(place: str = "place"):
    """Orders occurrences: rows with an id before those without, smaller ids, then hashes of texts, then places."""
    return F.struct(F.col("mark").bitwiseAND(1).alias("late"), "doc", "mark", place)


def tokens_of(kind: str, raw: np.ndarray, off: np.ndarray) -> tk.Tokens:
    """Tokens of texts; words are taken from texts with one space between them."""
    return tk.byte_tokens(raw, off) if kind == "bytes" else tk.word_tokens(raw, off)


def pack(lo: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (lo << 2 * _BITS) | (n << _BITS) | at


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mask = (1 << _BITS) - 1
    return place >> 2 * _BITS, (place >> _BITS) & mask, place & mask


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def phrases(docs: DataFrame, kind: str, width: int, gram: int) -> DataFrame:
    """Every phrase of every text: one narrow row each."""

    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.small(batches):
            raw, off = tk.utf8(batch.column("text"))
            if kind == "words":
                raw, off = tk.spaced(raw, off)
            doc, mark = batch.column("doc"), batch.column("mark")
            for i, j in tk.blocks(off):
                r = tk.runs(tokens_of(kind, raw[off[i] : off[j]], off[i : j + 1] - off[i]), width, gram)
                if len(r.lo):
                    at = pa.array(r.text + i)
                    cols = [doc.take(at), mark.take(at), longs(pack(r.lo, r.n, r.at)), longs(r.key), longs(r.ext)]
                    yield pa.RecordBatch.from_arrays(cols, ["doc", "mark", "place", "key", "ext"])

    return identified(docs).mapInArrow(cut_texts, RUN_SCHEMA)


def tokens_in(text: pa.Array, at: int, kind: str) -> bytes | list[bytes]:
    value = text[at].as_py()
    raw = b"" if value is None else value.encode()
    return raw if kind == "bytes" else raw.split()


def segments(docs: DataFrame, wanted: DataFrame, kind: str, width: int) -> DataFrame:
    """The tokens of chosen phrases.  ``wanted``: doc, mark, key, place, times."""
    places = wanted.groupBy("doc", "mark").agg(F.collect_list(F.struct("key", "place", "times")).alias("places"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.small(batches):
            doc, mark, text, lists = (batch.column(c) for c in ("doc", "mark", "text", "places"))
            out: list[tuple] = []
            for i in range(batch.num_rows):
                x = tokens_in(text, i, kind)
                for p in lists[i].as_py():
                    lo, n, _ = unpack(p["place"])
                    if lo + n + width - 1 <= len(x):
                        part = x[lo : lo + n + width - 1]
                        out.append((p["key"], doc[i].as_py(), mark[i].as_py(), p["place"], p["times"], part if kind == "bytes" else b" ".join(part)))
            cols = zip(*out) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["key", "doc", "mark", "place", "times", "segment"])

    return identified(docs).join(places, ["doc", "mark"]).mapInArrow(take, SEGMENT_SCHEMA)


def resolved(found: DataFrame, kind: str, width: int, resolve: Callable) -> DataFrame:
    """Spans of the windows that ``resolve`` settles, group by group of equal keys, in bounded batches."""

    def settle(rows: list[dict]) -> pa.RecordBatch:
        spans: list[tuple[int, int, int, int]] = []
        for row, hit in zip(rows, resolve(rows, width)):
            lo = row["place"] >> 2 * _BITS
            at = np.flatnonzero(hit)
            spans += [(row["doc"], row["mark"], lo + int(s), lo + int(e)) for s, e in zip(*tk.union(at, at + width))]
        cols = zip(*spans) if spans else [[]] * 4
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["doc", "mark", "s", "e"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in tk.small(batches):
            for row in batch.to_pylist():
                if held and all(row[c] == held[-1][c] for c in ("key", "doc", "mark", "place")):
                    continue  # rows equal in id and text give their phrases once
                if len(held) >= 4096 and row["key"] != held[-1]["key"]:
                    yield settle(held)
                    held = []
                held.append(row)
        if held:
            yield settle(held)

    order = found.withColumn("late", F.col("mark").bitwiseAND(1)).repartition("key").sortWithinPartitions("key", "late", "doc", "mark", "place")
    return order.drop("late").mapInArrow(stream, SPAN_SCHEMA)


def hot_windows(docs: DataFrame, wanted: DataFrame, scratch: Scratch, kind: str, width: int, mode: str) -> DataFrame:
    """The same for triggers with very many phrases: digests of whole windows, partially aggregated."""
    found = segments(docs, wanted, kind, width).dropDuplicates(["key", "doc", "mark", "place"])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lo, n, _ = unpack(row["place"])
                raw = np.frombuffer(row["segment"], np.uint8)
                h = tk.window_digests(tokens_of(kind, raw, np.array([0, len(raw)])), int(n), width)
                same = [pa.array([row[c]] * n, t) for c, t in (("doc", pa.int64()), ("mark", pa.int32()))]
                cols = [longs(h[:, 0]), longs(h[:, 1]), *same, longs(lo + np.arange(n)), pa.array([row["times"]] * n, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["h0", "h1", "doc", "mark", "start", "times"])

    windows = scratch.cut(found.mapInArrow(explode, HASH_SCHEMA), "windows")
    total = scratch.cut(windows.groupBy("h0", "h1").agg(F.sum("times").alias("total"), F.min(occurrence("start")).alias("first")).filter("total > 1"), "frequent")
    hits = windows.join(total, ["h0", "h1"])
    if mode == "earlier":
        hits = hits.filter(occurrence("start") != F.col("first"))
    return hits.select("doc", "mark", F.col("start").alias("s"), (F.col("start") + width).alias("e"))


def covered_spans(docs: DataFrame, *, kind: str, width: int, gram: int, mode: str, resolve: Callable, runs: DataFrame | None = None, hot: int = 20_000) -> DataFrame:
    """``doc, mark, spans array<struct<s, e>>``; ``docs`` needs ``doc_id`` and ``text``.

    ``runs`` may give the phrases of ``docs`` if they are stored already.
    """
    if not 0 < gram <= width < 1 << _BITS:
        raise ValueError(f"0 < gram <= width < {1 << _BITS} is needed")
    with Scratch(docs.sparkSession) as scratch:
        if runs is None:
            runs = scratch.cut(phrases(docs, kind, width, gram), "phrases")
        spans = found_spans(docs, runs, scratch, kind, width, mode, resolve, hot)
        return cut(spans.groupBy("doc", "mark").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")


def found_spans(docs: DataFrame, runs: DataFrame, scratch: Scratch, kind: str, width: int, mode: str, resolve: Callable, hot: int) -> DataFrame:
    # stored first, so that both sides of the join are plain exchanges and a frequent trigger can be split
    often = scratch.cut(runs.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("key"), "frequent")
    some = scratch.cut(runs.join(often, "key"), "candidates")
    entries = scratch.cut(some.groupBy("key", "ext").agg(F.count(F.lit(1)).alias("times"), F.min(occurrence()).alias("first")), "dictionary")
    if mode == "elsewhere":
        whole = some.join(entries.filter("times > 1").select("key", "ext"), ["key", "ext"])
    else:
        again = entries.filter("times > 1").select("key", "ext", "first")
        whole = some.join(again, ["key", "ext"]).filter(occurrence() != F.col("first"))
    lo, n = F.shiftrightunsigned("place", 2 * _BITS), F.shiftright("place", _BITS).bitwiseAND((1 << _BITS) - 1)
    # each part is stored by itself: its exchanges are gone before the next part's, which carry texts
    whole = scratch.cut(whole.select("doc", "mark", lo.alias("s"), (lo + n + (width - 1)).alias("e")), "whole")
    mixed = entries.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    wanted = scratch.cut(entries.join(mixed, "key").select("key", "kinds", "times", F.col("first.doc").alias("doc"), F.col("first.mark").alias("mark"), F.col("first.place").alias("place")), "mixed")
    spans = whole.unionByName(scratch.cut(resolved(segments(docs, wanted.filter(F.col("kinds") <= hot), kind, width), kind, width, resolve), "resolved"))
    if not wanted.filter(F.col("kinds") > hot).isEmpty():
        spans = spans.unionByName(hot_windows(docs, wanted.filter(F.col("kinds") > hot), scratch, kind, width, mode))
    return spans


def removed(text: bytes | list[bytes], spans: list[dict] | None) -> tuple[list, list[tuple[int, int]]]:
    """What is left of a token sequence, and the removed ranges."""
    if not spans:
        return [text], []
    s, e = tk.union(np.array([x["s"] for x in spans]), np.minimum(np.array([x["e"] for x in spans]), len(text)))
    gone = [(int(a), int(b)) for a, b in zip(s, e) if a < b]
    left, at = [], 0
    for a, b in gone:
        left.append(text[at:a])
        at = b
    return [*left, text[at:]], gone


OUT_SCHEMA = "doc_id long, n_tokens long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"


def apply_spans(docs: DataFrame, spans: DataFrame, kind: str) -> DataFrame:
    """One row per document: token count, tokens removed, maximal removed ranges, the rest."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.small(batches):
            doc, mark, text, lists = (batch.column(c) for c in ("doc", "mark", "text", "spans"))
            ids = pa.array(doc.to_numpy(), pa.int64(), mask=(mark.to_numpy() & 1).astype(bool))
            n, gone, ranges, kept = [], [], [], []
            for i in range(batch.num_rows):
                x = tokens_in(text, i, kind)
                left, cuts = removed(x, lists[i].as_py())
                n.append(len(x))
                gone.append(sum(b - a for a, b in cuts))
                ranges.append([{"start": a, "end": b} for a, b in cuts])
                kept.append(b"".join(left) if kind == "bytes" else b" ".join(w for part in left for w in part))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(ranges, span), pa.array(kept, pa.binary())],
                ["doc_id", "n_tokens", "n_removed", "spans", "kept"],
            )

    return identified(docs).join(spans, ["doc", "mark"], "left").mapInArrow(strip, OUT_SCHEMA)
