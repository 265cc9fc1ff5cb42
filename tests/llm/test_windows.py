"""Suffix-array and substring removal against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from seqframe.llm import _repeats, substring_dedup, suffix_dedup
from seqframe.llm._shared import table


def strip(x, width, hits):
    gone = np.zeros(len(x), bool)
    for i in range(len(x) - width + 1):
        if hits(i):
            gone[i : i + width] = True
    return gone


def brute_bytes(docs, width):
    count = Counter(x[i : i + width] for _, x in docs for i in range(len(x) - width + 1))
    out = []
    for k, x in docs:
        gone = strip(x, width, lambda i: count[x[i : i + width]] > 1)
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        out.append((k, len(x), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_words(docs, width):
    seen, out = set(), []
    for k, x in sorted(docs):
        w = x.split()
        windows = [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]
        hits = []
        for t in windows:
            hits.append(t in seen)
            seen.add(t)
        gone = strip(w, width, lambda i: hits[i])
        out.append((k, len(w), int(gone.sum()), hashlib.sha256(b" ".join(a for a, b in zip(w, gone) if not b)).hexdigest()))
    return sorted(out)


def fixture(seed, n=60):
    rng = np.random.default_rng(seed)
    words = ["a", "bb", "ccc", "é", "dd", "x\ty"]
    passage = " ".join(rng.choice(words, 60))
    docs = []
    for i in range(n):
        body = " ".join(rng.choice(words + [f"w{rng.integers(50)}"] * 3, rng.integers(0, 80)))
        if i % 3 == 0:
            body = body[: len(body) // 2] + " " + passage[rng.integers(20) :] + "\n" + body[len(body) // 2 :]
        if i % 7 == 0:
            body = "ab" * int(rng.integers(1, 60))
        docs.append((i, body))
    docs += [(n + i, docs[i][1]) for i in range(5)]
    return docs + [(n + 5, ""), (n + 6, "short")]


@pytest.mark.parametrize("hot", [20_000, 2])
@pytest.mark.parametrize("width,gram", [(40, 10), (24, 24), (16, 3)])
def test_bytes(spark, width, gram, hot, monkeypatch):
    docs = fixture(width + gram)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spans = _repeats.covered_spans(df, kind="bytes", width=width, gram=gram, mode="elsewhere", resolve=suffix_dedup.repeated_windows, hot=hot)
    got = suffix_dedup.digest(_repeats.apply_spans(df, spans, "bytes")).collect()
    assert sorted(map(tuple, got)) == brute_bytes([(k, x.encode()) for k, x in docs], width)


@pytest.mark.parametrize("batches", [1, 3])
def test_words(spark, batches):
    docs = fixture(5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = substring_dedup.digest(substring_dedup.substring_dedup(df, width=8, gram=3, batches=batches)).collect()
    assert sorted(map(tuple, got)) == brute_words([(k, x.encode()) for k, x in docs], 8)


def test_words_hot(spark):
    docs = fixture(6)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spans = _repeats.covered_spans(df, kind="words", width=8, gram=2, mode="earlier", resolve=substring_dedup.seen_windows, hot=2)
    got = substring_dedup.digest(_repeats.apply_spans(df, spans, "words")).collect()
    assert sorted(map(tuple, got)) == brute_words([(k, x.encode()) for k, x in docs], 8)


def test_index_compacts(spark):
    docs = fixture(9)
    index = substring_dedup.FingerprintIndex(spark, width=8, gram=3, fanout=2)
    got, before = [], None
    for part in (docs[:20], docs[20:40], docs[40:]):
        df = spark.createDataFrame(part, "doc_id long, text string")
        got += map(tuple, substring_dedup.digest(index.add(df, before)).collect())
        before = df if before is None else before.unionByName(df)
    assert len(index.runs) == 1 and index.version == 5
    again = substring_dedup.FingerprintIndex.open(spark, index.path)
    assert (again.runs, again.version, again.buckets, again.fanout) == (index.runs, 5, 8, 2)
    assert sorted(got) == brute_words([(k, x.encode()) for k, x in docs], 8)


def test_long_text_in_steps(spark):
    text = ("0123456789" * 3 + "é") * 60_000  # over one slice
    df = spark.createDataFrame([(1, text), (2, None), (None, text)], "doc_id long, text string")
    rows = {r.doc_id: r for r in suffix_dedup.digest(suffix_dedup.suffix_dedup(df)).collect()}
    assert rows[1].n_removed == rows[1].n_bytes == len(text.encode())
    assert rows[2].n_bytes == 0 and rows[None].n_removed == len(text.encode())


def test_history_is_not_moved(spark, monkeypatch):
    """Large runs are joined bucket by bucket: no exchange, neither to meet a batch nor to compact."""
    monkeypatch.setattr(substring_dedup.FingerprintIndex, "compact", lambda self: None)
    index, docs = substring_dedup.FingerprintIndex(spark, width=8, gram=3, fanout=9), fixture(9)
    for part in (docs[:30], docs[30:]):
        index.add(spark.createDataFrame(part, "doc_id long, text string"), spark.createDataFrame(docs[:30], "doc_id long, text string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.met(index.runs.pop())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_shared_ids_null_ids_and_built_texts(spark):
    rng = np.random.default_rng(1)
    x, y = (" ".join(f"{c}{i}" for i in rng.integers(0, 10**6, 200)) for c in "xy")
    n = lambda t: len(t.encode())
    df = spark.createDataFrame([(1, x), (2, x), (2, y), (None, x), (None, None)], "doc_id long, text string")
    got = rows_of(suffix_dedup.suffix_dedup(df).select("doc_id", "n_tokens", "n_removed"))
    assert got == sorted([(1, n(x), n(x)), (2, n(x), n(x)), (2, n(y), 0), (None, n(x), n(x)), (None, 0, 0)], key=repr)
    got = rows_of(substring_dedup.substring_dedup(df).select("doc_id", "n_tokens", "n_removed"))
    assert got == sorted([(1, 200, 0), (2, 200, 200), (2, 200, 0), (None, 200, 200), (None, 0, 0)], key=repr)
    # words whose polynomial hashes modulo 2**64 are equal
    t = thue_morse(2048)
    u = t.translate(str.maketrans("ab", "ba"))
    around = [f"w{i}" for i in range(24)]
    df = spark.createDataFrame([(i, " ".join([*around[:12], w, *around[12:]])) for i, w in enumerate((t, u))], "doc_id long, text string")
    assert rows_of(substring_dedup.substring_dedup(df).select("doc_id", "n_tokens", "n_removed")) == [(0, 25, 0), (1, 25, 0)]


def test_clashing_columns(spark):
    more = "doc long, mark int, place long, spans string, `t.x` int"
    docs = [(k, x, 1, 1, 1, "s", 1) for k, x in fixture(3, 20)]
    df = spark.createDataFrame(docs, f"doc_id long, text string, {more}")
    assert rows_of(suffix_dedup.digest(suffix_dedup.suffix_dedup(df, 24, 8))) == sorted(brute_bytes([(r[0], r[1].encode()) for r in docs], 24), key=repr)
    assert rows_of(substring_dedup.digest(substring_dedup.substring_dedup(df, 8, 3))) == sorted(brute_words([(r[0], r[1].encode()) for r in docs], 8), key=repr)


def test_registered_bytes(spark, sf):
    docs = [(r.doc_id, (r.text or "").encode()) for r in table(spark, sf, "documents").collect()]
    from seqframe.llm import queries

    assert rows_of(queries.op2_suffix_array_dedup(spark, sf)) == sorted(brute_bytes(docs, 400), key=repr)


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, spans string, kept int")
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_table(spark, sf):
    docs = [(r.doc_id, (r.text or "").encode()) for r in table(spark, sf, "documents").collect()]
    from seqframe.llm import queries

    assert sorted(map(tuple, queries.op5_substring_dedup(spark, sf).collect())) == brute_words(docs, 20)
