"""Passages of benchmark items in documents, up to a small edit distance.

Method: pigeonhole edit matching.  An item with an error budget of e is split into e + 1 pieces; a
passage within the budget holds one of them unchanged.  An Aho-Corasick automaton finds all pieces in
one pass over a text, and Myers' bit-parallel distance verifies the surroundings of each hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import packed
from ._tokens import small

#: Length of the substrings that the filter before the distance counts.
GRAM = 4


def grams(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


HIT_SCHEMA = "doc_id long, item_id long, distance int, n_chars int, end long"


def normal(text: str | None) -> str:
    """Lower case, white space collapsed."""
    return " ".join((text or "").lower().split())


@dataclass
class Item:
    item_id: int
    text: str
    budget: int

    def pieces(self) -> list[tuple[int, str]]:
        cut = [len(self.text) * i // (self.budget + 1) for i in range(self.budget + 2)]
        return [(a, self.text[a:b]) for a, b in zip(cut, cut[1:])]

    def masks(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for i, c in enumerate(self.text):
            out[c] = out.get(c, 0) | 1 << i
        return out


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern of ``m`` characters to any stretch of ``text``, and its first end."""
    ones, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = ones, 0, m
    best, at = m, 0
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (~(xh | up) & ones)
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, at = score, i + 1
        ph = (ph << 1) & ones
        mh = (mh << 1) & ones
        up = mh | (~(xv | ph) & ones)
        down = ph & xv
    return best, at


class Matcher:
    """All items of one block, compiled."""

    def __init__(self, items: list[Item]):
        self.items = items
        self.masks = [x.masks() for x in items]
        self.grams = [grams(x.text) for x in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(items):
            for offset, piece in item.pieces():
                where.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in where.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """item_id, distance, item length, end of the best passage, for each item within its budget."""
        starts: dict[int, set[int]] = {}
        for end, (size, uses) in self.automaton.iter(text):
            for n, offset in uses:
                starts.setdefault(n, set()).add(end + 1 - size - offset)
        out = []
        for n, found in starts.items():
            item, best = self.items[n], None
            m, e = len(item.text), item.budget
            low = high = None
            for s in [*sorted(found), None]:
                # hits whose windows overlap are verified together, at most four item lengths at once
                if low is not None and (s is None or s - high > 2 * e or s - low > 4 * m):
                    a = max(0, low - e)
                    around = text[a : high + m + e]
                    # an edit spoils at most GRAM of the item's grams: the rest must stand in the surroundings
                    if len(self.grams[n] - grams(around)) <= GRAM * e:
                        d, at = myers(self.masks[n], m, around)
                        if d <= e and (best is None or d < best[1]):
                            best = (item.item_id, d, m, a + at)
                    low = None
                if s is not None:
                    low, high = (s if low is None else low), s
            if best:
                out.append(best)
        return out


def item_blocks(benchmark: DataFrame, rate: float, chars: int) -> Iterator[list[Item]]:
    """Items in blocks of ``chars`` characters: the bound on what a task holds besides its rows."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").filter("item_id IS NOT NULL").toLocalIterator():
        text = normal(row.text)
        if text:
            if block and size + len(text) > chars:
                yield block
                block, size = [], 0
            block.append(Item(row.item_id, text, int(len(text) * rate)))
            size += len(text)
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block_chars: int = 1 << 21) -> DataFrame:
    """Every pair of a document and an item of which it holds a passage within the error budget.

    ``docs`` needs ``doc_id`` and ``text``, ``benchmark`` ``item_id`` and ``text``; other columns are
    ignored.  Texts are compared in lower case with white space collapsed; the budget of an item is
    ``rate`` times its length in characters, rounded down (0: exact).  Returns ``doc_id, item_id,
    distance, n_chars`` (length of the item), ``end`` (of the best passage in the normal form).

    The items are the query set: they reach the tasks in blocks of ``block_chars`` characters, each
    block with its own pass over the documents.  Null or empty texts and null item ids match nothing;
    repeated rows give repeated results; empty tables give an empty result.
    """
    spark = docs.sparkSession
    out = None
    for items in item_blocks(benchmark, rate, block_chars):

        def scan(batches: Iterator[pa.RecordBatch], items: list[Item] = items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items)
            for batch in small(batches):
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
                rows = [(i, *hit) for i, t in zip(ids, texts) for hit in matcher.find(normal(t.as_py()))]
                cols = list(zip(*rows)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "distance", "n_chars", "end"])

        found = docs.select("doc_id", "text").mapInArrow(scan, HIT_SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], HIT_SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block_chars: int = 1 << 21) -> DataFrame:
    """``docs`` without the documents that hold a passage of an item; all columns and other rows stay.

    Rows with a null ``doc_id`` are judged like the others: the decision is made on the row itself.
    """
    out = packed(docs, "text")
    for items in item_blocks(benchmark, rate, block_chars):

        def keep(batches: Iterator[pa.RecordBatch], items: list[Item] = items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items)
            for batch in small(batches):
                yield batch.filter(pa.array([not matcher.find(normal(t.as_py())) for t in batch.column("text")], pa.bool_()))

        out = out.mapInArrow(keep, out.schema)
    return out.select("_row.*")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "item_id", "distance", "n_chars", "end", F.lit(True).alias("contaminated"))
