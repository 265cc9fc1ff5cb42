"""The pipeline's stages one after another, each against its own definition."""

from collections import Counter, defaultdict

import corpus_pipeline
from test_near import brute, shingle_set

from seqframe.llm import decontamination, toxicity
from seqframe.llm._shared import cut, table


def test_stages(spark):
    sf = "/root/testdata/sf0.01"  # enough labels to learn from
    docs = table(spark, sf, "documents")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "mixing", "sharding"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    clean = cut(stages["toxicity"](spark, docs, sf), "t")
    rejected = ids(toxicity.toxic_documents(docs, table(spark, sf, "labels")))
    assert rejected and clean.columns == columns and ids(clean) == ids(docs) - rejected

    single = cut(stages["minhash_near_dedup"](spark, clean, sf), "t")
    groups = brute([(r.doc_id, r.text) for r in clean.collect()], 80)
    assert single.columns == columns and ids(single) == {k for k, g in groups.items() if g[2]}

    left = cut(stages["benchmark_decontamination"](spark, single, sf), "t")
    items = [decontamination.normal(r.text) for r in table(spark, sf, "benchmark").collect()]
    exact = {r.doc_id for r in single.collect() if any(x in decontamination.normal(r.text) for x in items)}
    assert left.columns == columns and ids(left) <= ids(single) - exact
    assert ids(single) - ids(left) == ids(decontamination.contamination(single, table(spark, sf, "benchmark")))

    mixed = cut(stages["mixing"](spark, left, sf), "t")
    n = {r.doc_id: len((r.text or "").split()) for r in left.collect()}
    source = {r.doc_id: r.source for r in left.collect()}
    copies = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and set(copies) <= set(n) and max(copies.values()) <= 2
    total = sum(copies[k] * n[k] for k in copies)
    assert abs(total - 1.5 * sum(n.values())) <= len(set(source.values())) * max(n.values())

    shards = stages["sharding"](spark, mixed, sf).collect()
    assert Counter(r.doc_id for r in shards) == copies
    slots, homes, text = defaultdict(list), defaultdict(set), {r.doc_id: r.text for r in left.collect()}
    for r in shards:
        slots[r.shard].append(r.slot)
        homes[text[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())
    assert Counter((r.doc_id, r.shard) for r in corpus_pipeline.run(spark, sf).collect()) == Counter((r.doc_id, r.shard) for r in shards)
    assert shingle_set("") == set()
