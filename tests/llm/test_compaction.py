"""The registered query joins a batch with a compacted run, and its result is that of a single batch."""

from seqframe.llm import queries, substring_dedup
from seqframe.llm._shared import table


def test_query_compacts_before_its_last_batch(spark, sf, monkeypatch):
    seen, add, compact = [], substring_dedup.FingerprintIndex.add, substring_dedup.FingerprintIndex.compact
    monkeypatch.setattr(substring_dedup.FingerprintIndex, "add", lambda self, *a: (seen.append(list(self.runs)), add(self, *a))[1])
    monkeypatch.setattr(substring_dedup.FingerprintIndex, "compact", lambda self: (seen.append("compact"), compact(self))[1])
    got = {tuple(r) for r in queries.QUERIES["op5_substring_dedup"](spark, sf).collect()}
    assert "compact" in seen[:-2] and len(seen[-2]) == 1 and "seqframe_compact_" in seen[-2][0]
    want = substring_dedup.digest(substring_dedup.substring_dedup(table(spark, sf, "documents"), batches=1))
    assert got == {tuple(r) for r in want.collect()}
