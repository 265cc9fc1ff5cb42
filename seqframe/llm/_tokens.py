"""Vectorised token hashing over Arrow string columns: the shared base of the window operators.

A text is a sequence of tokens (bytes or words).  A *window* is ``width`` consecutive tokens of
one text.  Every window has one *trigger*: the leftmost minimum of the rolling hash of the
``gram``-token strings inside it.  Consecutive windows with the same trigger form a *phrase*
(`Runs`), so equal windows always sit at the same distance from equal triggers.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []
#: Bytes of text that one vectorised step works on; longer texts are cut with overlap.
SLICE = 1 << 18
#: Rows of an Arrow batch that a Python worker handles at once: its memory stays small.
ROWS = 1024


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + 4096)
        up = np.full(size, _BASE, U)
        down = np.full(size, pow(_BASE, -1, 1 << 64), U)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers


BYTE_HASH = mix(np.arange(256, dtype=U) + U(0x1234567))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which `span` takes the rolling hash of any stretch."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * _tables(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rolling hashes of the stretches [start, end), independent of where they stand.

    They choose triggers and bring candidates together, nothing more: a hash that is a polynomial modulo
    2**64 has equal values for some built texts, so what decides a result is `word_hashes` or `digests`.
    """
    return mix((sums[end] - sums[start]) * _tables(len(sums))[1][start] + (end - start).astype(U))


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, long: int = 256) -> np.ndarray:
    """64-bit hashes of the byte ranges: eight bytes after another through a finaliser; xxh3 for ``long`` ones."""
    n = end - start
    out = mix(n.astype(U) + U(0x9E3779B97F4A7C15))
    eights = np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    live, at = np.flatnonzero((n > 0) & (n <= long)), 0
    while len(live):
        left = n[live] - at
        v = eights[start[live] + at]
        short = left < 8
        v[short] &= (U(1) << (left[short] * 8).astype(U)) - U(1)
        out[live] = mix((out[live] ^ v) + U(0xD1B54A32D192ED03))
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(n > long):
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]])
    return out


def digests(raw: np.ndarray, start: np.ndarray, end: np.ndarray, size: int = 8) -> np.ndarray:
    """BLAKE2b digests of the byte ranges, as rows of 64-bit numbers: equal for equal bytes alone, as far as is known."""
    data = memoryview(np.ascontiguousarray(raw))
    found = b"".join([blake2b(data[a:b], digest_size=size).digest() for a, b in zip(start.tolist(), end.tolist())])
    return np.frombuffer(found, U).reshape(-1, size // 8)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values, in linear time."""
    n = len(v)
    pad = np.full(-(-n // w) * w, np.iinfo(U).max, U)
    pad[:n] = v
    blocks = pad.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    size = len(column)
    if size == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + size + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `ROWS`; afterwards the worker, which may idle, gives free memory back."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def blocks(off: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of ``limit`` bytes together, or one longer text."""
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


@dataclass
class Tokens:
    """Tokens of consecutive texts: byte ranges in ``raw``, text number, hashes."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray  # number of the first token of every text, and the total
    hashes: np.ndarray


def byte_tokens(raw: np.ndarray, off: np.ndarray) -> Tokens:
    at = np.arange(len(raw))
    return Tokens(raw, at, at + 1, np.repeat(np.arange(len(off) - 1), np.diff(off)), off, BYTE_HASH[raw])


def word_tokens(raw: np.ndarray, off: np.ndarray, lower: bool = False, breaks: np.ndarray | None = None) -> Tokens:
    """Words are maximal runs of bytes other than 0x20 and 0x09 to 0x0D; ``lower`` maps A-Z to a-z.

    ``breaks`` may mark other bytes that part words (256 flags).
    """
    n = len(raw)
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13))) if breaks is None else ~breaks[raw]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1] | cut[1:n]
    closes[:-1] &= ~word[1:] | cut[1:n]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    text = np.searchsorted(off, start, "right") - 1
    return Tokens(raw, start, end, text, np.searchsorted(text, np.arange(len(off))), word_hashes(raw, start, end))


def spaced(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with one space between words, so that equal word sequences are equal bytes."""
    texts = [b" ".join(raw[a:b].tobytes().split()) for a, b in zip(off[:-1], off[1:])]
    return np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)


@dataclass
class Runs:
    """Phrases: ``n`` windows from token ``lo`` of text ``text`` share the trigger at token ``lo + at``.

    ``key`` is the rolling hash of the trigger string, ``ext`` the digest of the bytes of all tokens of the
    run together with the trigger's place.
    """

    text: np.ndarray
    lo: np.ndarray
    n: np.ndarray
    at: np.ndarray
    key: np.ndarray
    ext: np.ndarray


def runs(t: Tokens, width: int, gram: int, step: int = SLICE) -> Runs:
    """The phrases of all texts; a text of fewer than ``width`` tokens has none.  Words stand one space apart (`spaced`)."""
    parts: list[list[np.ndarray]] = []
    total = len(t.start)
    c = 0
    while total - c >= width:
        d = min(total, c + step + width - 1)
        text = t.text[c:d]
        sums = prefix(t.hashes[c:d])
        grams = np.arange(d - c - gram + 1)
        key = span(sums, grams, grams + gram)
        packed = (key & U(0xFFFFFFFF00000000)) | grams.astype(U)
        trigger = (sliding_min(packed, width - gram + 1) & U(0xFFFFFFFF)).astype(np.int64)
        windows = d - c - width + 1
        trigger[text[:windows] != text[width - 1 :]] = -1  # never across texts
        begin = np.flatnonzero(np.diff(trigger, prepend=-2))
        n = np.diff(begin, append=windows)
        keep = trigger[begin] >= 0
        lo, n, at = begin[keep], n[keep], trigger[begin[keep]]
        ext = digests(t.raw, t.start[c + lo], t.end[c + lo + n + width - 2])[:, 0] ^ mix((at - lo).astype(U))
        parts.append([text[lo], c + lo - t.first[text[lo]], n, at - lo, key[at], ext])
        c += step
    cols = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, U)] * 2
    return Runs(*cols)


def window_digests(t: Tokens, n: int, width: int) -> np.ndarray:
    """128-bit digests of the first ``n`` windows of the one text in ``t``: rows of two numbers."""
    return digests(t.raw, t.start[:n], t.end[width - 1 : width - 1 + n], 16)


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching ranges joined, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
    return starts[new], np.r_[reach[new[1:] - 1], reach[-1]]
