"""Word shingles of texts as 64-bit hashes, and signatures of minima over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import _tokens as tk
from ._tokens import U


def shingles(raw: np.ndarray, off: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, and their offsets.

    A-Z are lower-cased.  A text of 1 to ``words - 1`` words has its whole sequence as one shingle.
    """
    t = tk.word_tokens(raw, off, lower=True)
    count = np.diff(t.first)
    size = np.maximum(count - words + 1, (count > 0).astype(np.int64))
    first = np.repeat(t.first[:-1], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    last = np.minimum(first + words, np.repeat(t.first[1:], size))
    # the words of a shingle one after another through a finaliser
    h = tk.mix((last - first).astype(U))
    for k in range(words):
        in_it = first + k < last
        if in_it.all():
            h = tk.mix(h ^ t.hashes[first + k])
        else:
            h[in_it] = tk.mix(h[in_it] ^ t.hashes[first[in_it] + k])
    parts, out = [], np.zeros(len(size) + 1, np.int64)
    ends = np.cumsum(size)
    for i, e in enumerate(ends):
        own = np.sort(h[e - size[i] : e])
        if len(own):
            own = own[np.r_[True, own[1:] != own[:-1]]]
        parts.append(own)
        out[i + 1] = out[i] + len(own)
    return (np.concatenate(parts) if parts else h), out


def shingle_sets(raw: np.ndarray, off: np.ndarray, words: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """`shingles` in blocks: first text, end, hashes, offsets."""
    for i, j in tk.blocks(off):
        h, o = shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i], words)
        yield i, j, h, o


def signatures(h: np.ndarray, off: np.ndarray, coordinates: int, minima: int, seed: int = 1) -> np.ndarray:
    """One row of ``coordinates`` keys for each text: key c mixes c with ``minima`` minimum values.

    Rows of empty sets are zero.
    """
    n = len(off) - 1
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 1 << 63, (coordinates, minima), dtype=np.uint64) * U(2) + U(1)
    out = np.zeros((n, coordinates), U)
    full = np.flatnonzero(np.diff(off))
    if not len(full):
        return out
    start = off[full]
    for c in range(coordinates):
        key = np.full(len(full), (c + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, U)
        for k in range(minima):
            key = tk.mix(key ^ np.minimum.reduceat(h * factors[c, k], start))
        out[full, c] = key
    return out
