"""The plan of a mix is distributed: no bound on the number of sources."""

from collections import Counter

import numpy as np

from seqframe.llm import mixing


def shares(sizes, weights, total, most):
    """Fill by weight; what is above ``most`` times a size is dealt again."""
    targets, left, rest = [0.0] * len(sizes), total, [i for i, n in enumerate(sizes) if n]
    while rest:
        unit = left / sum(weights[i] for i in rest)
        full = [i for i in rest if unit * weights[i] > most * sizes[i]]
        for i in full or rest:
            targets[i] = most * sizes[i] if full else unit * weights[i]
        left -= sum(targets[i] for i in full)
        rest = [i for i in rest if i not in full] if full else []
    return targets


def test_more_sources_than_the_driver_took(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 3, raising=False)
    rng = np.random.default_rng(3)
    names = [None, *[f"host-{i:03d}.example" for i in range(300)]]
    rows = [(i, "w " * int(rng.integers(0, 12) ** 2), names[i % 301]) for i in range(1500)]
    rows.append((1500, None, "silent"))
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, shares([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()), 2.0)))
    assert len(got) == len(rows) and all(abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] for r in got)
    assert all(abs(taken[s] - want[s]) <= 2 * 121 for s in order) and want["silent"] == 0
