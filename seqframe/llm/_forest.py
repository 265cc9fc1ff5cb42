"""A small random forest over NumPy arrays: bootstrap samples, random feature subsets, Gini splits."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Forest:
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean of the trees' leaf probabilities."""
        total = np.zeros(len(x))
        for feature, cut, left, right, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                go = np.flatnonzero(inner)
                at = node[go]
                node[go] = np.where(x[go, feature[at]] <= cut[at], left[at], right[at])
            total += value[node]
        return total / max(1, len(self.trees))


def _split(x: np.ndarray, y: np.ndarray, features: np.ndarray) -> tuple[float, int, float]:
    best = (np.inf, -1, 0.0)
    n = len(y)
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, pos = x[order, f], np.cumsum(y[order])
        k = np.flatnonzero(v[1:] > v[:-1]) + 1
        if len(k):
            a, b = pos[k - 1] / k, (pos[-1] - pos[k - 1]) / (n - k)
            gini = (k * a * (1 - a) + (n - k) * b * (1 - b)) / n
            i = int(np.argmin(gini))
            if gini[i] < best[0]:
                best = (float(gini[i]), int(f), float((v[k[i]] + v[k[i] - 1]) / 2))
    return best


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 8, leaf: int = 3, seed: int = 7) -> Forest:
    rng = np.random.default_rng(seed)
    some = max(1, round(np.sqrt(x.shape[1])))
    out = Forest()
    for _ in range(trees):
        nodes: list[list] = []

        def grow(rows: np.ndarray, level: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
            if level < depth and len(rows) >= 2 * leaf and 0 < y[rows].sum() < len(rows):
                _, f, cut = _split(x[rows], y[rows], rng.choice(x.shape[1], some, replace=False))
                if f >= 0:
                    low = x[rows, f] <= cut
                    if min(low.sum(), (~low).sum()) >= leaf:
                        nodes[at][:4] = [f, cut, grow(rows[low], level + 1), 0]
                        nodes[at][3] = grow(rows[~low], level + 1)
            return at

        grow(rng.integers(0, len(y), len(y)), 0)
        cols = list(zip(*nodes))
        out.trees.append((np.array(cols[0]), np.array(cols[1]), np.array(cols[2]), np.array(cols[3]), np.array(cols[4])))
    return out
