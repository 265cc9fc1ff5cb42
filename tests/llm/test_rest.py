"""The other operators: brute force, SQL, round trips, held-out accuracy, odd tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import same_rows

from seqframe.llm import _packing, decontamination, line_dedup, media, mixing, queries, secrets, sharding, toxicity
from seqframe.llm._shared import table


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, sf, name):
    same_rows(spark, sf, queries.QUERIES[name], queries.ORACLE[name])


def test_lines(spark):
    rows = [(i, f"https://A.example/{i}", f"<p>menu</p><p>text {i}</p>tail") for i in range(4)]
    rows += [(9, None, "menu\nmenu"), (10, "https://b.example/", None), (11, "nonsense", ""), (0, "https://a.example/x", "menu<br>menu")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS `a.b`")
    got = sorted((r.page_id, r.host, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.line_dedup(df).fillna("", ["host"]).collect())
    assert got == [(0, "a.example", 2, 2, ""), *[(i, "a.example", 3, 2, f"text {i}") for i in range(4)], (9, "", 2, 0, "menu\nmenu"), (10, "b.example", 0, 0, ""), (11, "", 0, 0, "")]
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def distance(a, b):
    """Least edit distance of a to any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@pytest.mark.parametrize("rate", [0.05, 0.1])
def test_contamination(spark, rate):
    rng = np.random.default_rng(4)
    draw = lambda n: "".join(rng.choice(list("abcd "), n))
    items = [(i, draw(int(rng.integers(20, 90)))) for i in range(12)] + [(50, ""), (51, None), (None, draw(30)), (52, items_long := draw(300))]
    docs = []
    for i in range(60):
        x = list(items[i % 12][1])
        for _ in range(i % 6):
            x[int(rng.integers(len(x)))] = str(rng.choice(list("abcdz")))
        docs.append((i, draw(40) + "".join(x).upper() + draw(30)))
    docs += [(100, None), (101, ""), (102, draw(500)), (103, items_long)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for k, x in docs:
        for n, y in items:
            if n is not None and decontamination.normal(y):
                p = decontamination.normal(y)
                e = distance(p, decontamination.normal(x))
                if e <= int(len(p) * rate):
                    want.add((k, n, e))
    for chars in (1 << 21, 100):
        got = decontamination.contamination(d, b, rate, chars).collect()
        assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == sorted(want)
    left = {r.doc_id for r in decontamination.clean(d.selectExpr("*", "1 AS `a.b`"), b, rate, 100).collect()}
    assert left == {k for k, _ in docs} - {k for k, _, _ in want}
    assert decontamination.contamination(d.limit(0), b).count() == 0 and decontamination.contamination(d, b.limit(0)).count() == 0


def test_best_fit_decreasing():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = [int(x) for x in rng.integers(1, 60, rng.integers(0, 200))]
        where, n = _packing.best_fit_decreasing(sizes, 60)
        rooms, plain = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [(r, b) for b, r in enumerate(rooms) if r >= sizes[i]]
            b = min(fits)[1] if fits else len(rooms)
            if not fits:
                rooms.append(60)
            rooms[b] -= sizes[i]
            plain[i] = b
        assert (where, n) == (plain, len(rooms))


def test_shards(spark, sf):
    docs = table(spark, sf, "documents")
    rows = sharding.digest(docs).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == len(text)
    group, slots, load = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        group[text[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(len(s) == 1 for s in group.values()) and set(load) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(len(t.encode()) + 1 for t in text.values())
    assert max(load.values()) - min(load.values()) <= largest
    odd = spark.createDataFrame([(1, None, 7), (1, None, 8), (None, "x", 9), (2, "", 10)], "doc_id long, text string, shard int")
    out = sharding.shard(odd, shards=2).collect()
    assert len(out) == 4 and len({r.shard for r in out if not r.text}) == 1
    assert sharding.shard(odd.limit(0)).count() == 0


def test_mixing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 60)), [None, "a", "b", "é", "z"][min(4, int(rng.integers(0, 12)))]) for i in range(3000)]
    rows += [(7, None, "a"), (7, None, "a"), (None, "x y", "only")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df.selectExpr("*", "0 AS size", "1 AS `a.b`")).collect()
    taken, sizes, goal = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        sizes[r.source] += r.size
        goal[r.source] = r.target
    assert len(got) == len(rows)
    for s in sizes:
        assert goal[s] <= 2 * sizes[s] + 1e-6 and abs(taken[s] - goal[s]) <= 120
    assert abs(sum(goal.values()) - 1.5 * sum(sizes.values())) < 1e-3
    again = mixing.mix(df.repartition(3)).collect()
    assert Counter((r.doc_id, r.copies) for r in again) == Counter((r.doc_id, r.copies) for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def balanced(sizes, target, most=2.0):
    """The tilt by halving: an independent solver."""
    sizes = np.array(sizes, float)
    c = np.where(sizes > 0, sizes / (sizes + sizes.mean()), 0.0)
    low, high = -1e5, 1e5
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (sizes * np.minimum(most, np.exp(np.minimum(mid * c, 5)))).sum() < target else (low, mid)
    return low, np.minimum(most, np.exp(np.minimum(low * c, 5)))


def test_tilts_against_halving(spark):
    rng = np.random.default_rng(8)
    docs = {"up": rng.integers(1, 300, 400), "down": rng.integers(1, 300, 400), None: rng.integers(1, 9, 50), "full": np.array([4, 5]), "none": np.array([0, 0])}
    factor = {"up": 1.6, "down": 0.3, None: 1.0, "full": 2.0, "none": 0.0}
    strata = spark.createDataFrame([(s, int(n), int(k)) for s, v in docs.items() for n, k in Counter(v.tolist()).items()], "source string, size long, n long")
    plan = spark.createDataFrame([(s, int(v.sum()), len(v), float(factor[s] * v.sum())) for s, v in docs.items()], "source string, source_size long, n_docs long, target double")
    lam = {r.source: r.lam for r in mixing.entropy_balance(strata, plan, 2.0).collect()}
    assert set(lam) == {"up", "down", None}
    for s, x in lam.items():
        want, rates = balanced(docs[s], factor[s] * docs[s].sum())
        assert abs(x - want) < 1e-6 and (s is None or rates.std() > 0.01)
    df = spark.createDataFrame([(i, "w " * int(n), s) for s, v in docs.items() for i, n in enumerate(v)], "doc_id long, text string, source string")
    got = mixing.mix(df, weights=(1,), share=0.8).collect()
    own = {s: [r for r in got if r.source == s] for s in docs}
    for s, rows in own.items():
        if 0 < rows[0].target < 2 * rows[0].source_size:
            _, rates = balanced([r.size for r in rows], rows[0].target)
            assert all(abs(r.copies - w) < 1 for r, w in zip(rows, rates))


def test_columns_with_clashing_names(spark):
    more = [c for c in "rate _source _start row key cell start place source_size target n s k c units upto class lam n_docs _row _copy".split()]
    rows = [(i, f"w{i % 3} x y", "ab"[i % 2], *[i] * len(more), i) for i in range(12)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, source string", *[f"{c} long" for c in more], "`a.b` long"]))
    for out in (mixing.mix(df), sharding.shard(df, 2)):
        got = out.collect()
        assert len(got) == 12 and all(r[c] == r.doc_id for r in got for c in [*more, "a.b"] if c not in ("source_size", "target"))
    import corpus_pipeline

    mixed = corpus_pipeline.mix_sources(spark, df, "")
    assert mixed.columns == df.columns and all(r["_copy"] == r.doc_id for r in mixed.collect())


def test_secrets(spark):
    found = secrets.labelled_findings(3000, seed=5)
    model = secrets.train(found[:2000])
    x = np.array([secrets.describe(b, c, a) for b, c, a, _ in found[2000:]], float)
    y = np.array([r[3] for r in found[2000:]])
    assert ((model.predict(x) >= 0.5) == y).mean() >= 0.97
    key = "0b1cea0846965f2d3ecb5cdb87c0edc7a7a5871b"
    rows = [(1, f'é the token = "{key}" here'), (2, f"see commit {key} for"), (3, None), (4, ""), (None, f"api_key={key}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score")
    got = secrets.scan(df).collect()
    assert {r.doc_id for r in got} == {1, None}
    first = next(r for r in got if r.doc_id == 1)
    assert rows[0][1][first.start : first.end] == key and first.sha256 == hashlib.sha256(key.encode()).hexdigest()
    assert secrets.scan(df.limit(0)).count() == 0


def test_media(spark):
    texts = ["", None, "a" * 64, "é" * 333, "hello world " * 4000, "x", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS media")
    rows = {r.doc_id: r for r in media.digest(media.audio(df, batch_bytes=100)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        wav = media.encode_wav(payload)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest()) and r.feature
    assert rows[5].feature == rows[6].feature and rows[0].feature == rows[1].feature
    assert media.audio(df.limit(0)).count() == 0


def test_resampling_keeps_a_tone():
    t = np.arange(16_000) / 16_000
    y = media.resample(np.sin(2 * np.pi * 440 * t), 16_000, 8_000)
    want = np.sin(2 * np.pi * 440 * np.arange(8_000) / 8_000)
    assert len(y) == 8_000 and np.abs(y[100:-100] - want[100:-100]).max() < 0.02
    up = media.resample(np.sin(2 * np.pi * 440 * t[:8000] * 2), 8_000, 12_000)
    assert np.abs(up[200:-200] - np.sin(2 * np.pi * 440 * np.arange(12_000) / 12_000)[200:-200]).max() < 0.02


def test_segments_and_tensors():
    rng = np.random.default_rng(0)
    x = np.r_[np.zeros(8000), rng.normal(0, 40, 8000), np.zeros(8000), rng.normal(0, 40, 4000)]
    found = media.features((x + 128).clip(0, 255).astype(np.uint8).tobytes(), media.STORED_RATE)
    assert [round(s["start"], 1) for s in found] == [0.5, 1.5] and abs(found[0]["end"] - 1.0) < 0.05
    array = media.read(media.stored(found)).column("mel")
    assert array.type.shape == list(media.SHAPE) and np.array_equal(array.to_numpy_ndarray()[1].ravel(), found[1]["mel"])
    assert media.read(media.stored([])).num_rows == 0


def test_toxicity(spark):
    rng = np.random.default_rng(8)
    plain = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(900):
        toxic, poor = i % 4 == 0, i % 3 == 0
        w = list(rng.choice(plain, 40))
        if toxic:
            w[5:7] = rng.choice(["vilething", "vilest", "nastyish"], 2)
        if poor:
            w[:3] = ["junk", "junk", "spam"]
        rows.append((i, " ".join(w)))
        marks.append((i, None if i % 50 == 1 else int(not poor), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = spark.createDataFrame(marks[:600], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, train, toxicity.categories())
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1
    got = {r.doc_id: r.p_toxic >= chain.thresholds[-1] for r in toxicity.scored(docs, chain).collect()}
    held = range(600, 900)
    assert np.mean([got[i] == (i % 4 == 0) for i in held]) > 0.98
    odd = spark.createDataFrame([(None, None, 1), (5, "", 2)], "doc_id long, text string, `p.x` int")
    assert toxicity.scored(odd, chain).count() == 2
    assert toxicity.without_toxic(docs.limit(0), train).count() == 0
    assert toxicity.without_toxic(docs, train.limit(0)).count() == 900
    clean = {r.doc_id for r in toxicity.without_toxic(docs, train).collect()}
    assert clean >= {i for i in held if i % 4} and not clean & {r.doc_id for r in toxicity.toxic_documents(docs, train).collect()}


def test_labels_that_contradict_and_ids_that_repeat(spark):
    """A label of 1 wins, an id of many rows gives its texts to the sample once, and reruns agree."""
    rows = [(i, f"vilething w{i} w{i % 7}" if i % 2 else f"fine w{i} w{i % 7}") for i in range(300)] + [(1, "vilething w1 w1")] * 200 + [(2, f"other text {i % 3}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = [(i, 1, i % 2) for i in range(300)] + [(i, 1, 0) for i in range(1, 40, 2)] + [(None, 1, 1), (5, None, 0), (6, 1, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = toxicity.sampled(docs, labels, toxicity.categories(), 4000, 5).collect()
    assert len(found) == 300 + 3 and sum(r.toxic for r in found) == 150
    assert len(toxicity.sampled(docs, labels, toxicity.categories(), 50, 5).collect()) == 50
    a, b = (toxicity.train(d, x, toxicity.categories()) for d, x in ((docs, labels), (docs.repartition(7), labels.repartition(5))))
    assert (a.features == b.features).all() and a.thresholds == b.thresholds and np.allclose(a.weights[1], b.weights[1])
    got = {r.doc_id: r.p_toxic >= a.thresholds[-1] for r in toxicity.scored(docs, a).collect()}
    assert all(got[i] == bool(i % 2) for i in range(300) if i != 2)
