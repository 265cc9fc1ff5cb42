"""Near-duplicate groups against all pairs."""

import numpy as np
import pytest

from seqframe.llm import minhash_dedup
from seqframe.llm._shared import Scratch

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, words=5):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(docs, percent):
    sets = {k: shingle_set(x) for k, x in docs}
    ids = sorted(k for k in sets if k is not None)
    parent = {k: k for k in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k), find(k) == k) for k in ids}


@pytest.mark.parametrize("percent", [80, 85])
def test_groups(spark, percent):
    rng = np.random.default_rng(percent)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for base in range(12):
        words = list(rng.choice(vocabulary, rng.integers(30, 200)))
        for copy in range(15):
            own = words.copy()
            for _ in range(rng.integers(0, 1 + len(own) // 12)):
                own[rng.integers(len(own))] = f"n{rng.integers(10**9)}"
            docs.append((len(docs), " ".join(own).upper() if copy % 2 else "\t".join(own)))
    docs += [(900, ""), (901, None), (902, "  \n"), (903, "one two"), (904, "ONE  two"), (905, "one two three")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df, percent=percent).collect()}
    assert got == brute(docs, percent)
    assert len({g[1] for g in got.values()}) < len(got)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    with Scratch(spark) as scratch:
        got = {r.id: r.component for r in minhash_dedup.components(edges, scratch).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_null_ids_and_columns(spark):
    rows = [(None, "a b c d e f", 1), (None, "a b c d e f", 2), (3, "a b c d e f", 3), (4, "a b c d e f", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `n.head` int")
    assert sorted(r[2] for r in minhash_dedup.without_copies(df).collect()) == [1, 2, 3]
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0


def test_rows_sharing_an_id(spark):
    p, q = (" ".join(f"{c}{i}" for i in range(30)) for c in "pq")
    rows = [(0, p), (5, p), (5, q), (2, q), (2, q), (9, "other words stand here alone"), (9, None), (7, "")]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == {(0, 0), (5, 0), (2, 0), (9, 9), (7, 7)}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_id_for_many_texts(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 10**6, 40)) for _ in range(30)]
    rows = [(3, t) for t in texts] + [(i + 10, texts[i]) for i in range(20)] + [(4, texts[0])] * 3
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    assert {r.component_id for r in got} == {3}


def test_texts_with_equal_polynomial_hashes(spark):
    t = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    rows = [(1, t), (2, t.translate(str.maketrans("ab", "ba")))]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (2, 2, True)}
