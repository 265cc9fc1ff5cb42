"""Removal of byte strings that occur more than once in a corpus.

Method: prefix-free parsing.  Rolling-hash triggers cut the texts into phrases; the distinct
phrases are the dictionary (`_repeats`).  Equal windows share their trigger, so their order follows from
two sorted lists of each trigger's phrases: what stands before the trigger, read backwards, and what
follows it.  A window repeats when its ranks in both agree with another's to its depth.  These lists stand
in for the suffix arrays of the whole dictionary and of the parse, and the order of all corpus positions,
one record a byte, is not built.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._repeats import apply_spans, covered_spans, unpack


def _sorted_lcp(strings: list[bytes], group: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order within each group, and the common prefix with the one before (-1: another group)."""
    order = np.array(sorted(range(len(strings)), key=lambda i: (group[i], strings[i])))
    size = np.array([len(s) for s in strings])[order]
    wide = max(1, int(size.max(initial=1)))
    grid = np.frombuffer(b"".join(strings[i].ljust(wide, b"\0") for i in order), np.uint8).reshape(len(order), wide)
    same = np.ones((len(order) - 1, wide + 1), bool)
    same[:, :wide] = grid[1:] == grid[:-1]
    same[:, wide] = False
    lcp = np.full(len(order), -1)
    lcp[1:] = np.minimum(np.argmin(same, axis=1), np.minimum(size[1:], size[:-1]))
    which = np.array(group)[order]
    lcp[1:][which[1:] != which[:-1]] = -1
    return order, lcp


def repeated_windows(rows: list[dict], width: int) -> list[np.ndarray]:
    """For each phrase, which of its windows occur in another phrase of the same trigger, or twice themselves."""
    _, n, at = unpack(np.array([r["place"] for r in rows]))
    times = np.array([r["times"] for r in rows])
    keys = [r["key"] for r in rows]
    order_b, lcp_b = _sorted_lcp([r["segment"][:a][::-1] for r, a in zip(rows, at)], keys)
    order_f, lcp_f = _sorted_lcp([r["segment"][a:] for r, a in zip(rows, at)], keys)
    total = len(rows)
    hit = np.zeros((total, int(n.max())), bool)
    rank_b, rank_f = np.empty(total, np.int64), np.empty(total, np.int64)
    for before in range(int((at - n + 1).min()), int(at.max()) + 1):
        here = np.flatnonzero((before <= at) & (before > at - n))
        if not len(here):
            continue
        rank_b[order_b] = np.cumsum(lcp_b < before)
        rank_f[order_f] = np.cumsum(lcp_f < width - before)
        _, which = np.unique(rank_b[here] * (total + 1) + rank_f[here], return_inverse=True)
        hit[here, at[here] - before] = np.bincount(which, times[here])[which] > 1
    return [hit[i, : n[i]] for i in range(total)]


def suffix_dedup(docs: DataFrame, width: int = 400, gram: int = 100) -> DataFrame:
    """Remove every byte covered by a ``width``-byte string that also starts anywhere else in ``docs``.

    Needs ``doc_id`` (integer) and ``text``; other columns are ignored.  Returns one row per input
    row: ``doc_id, n_tokens`` (bytes), ``n_removed, spans`` (maximal removed byte ranges), ``kept``
    (remaining bytes; a cut may fall inside a character, hence binary).

    Null texts count as empty; shorter texts than ``width`` lose nothing; strings never cross texts.
    Every row is a text of its own, whether it shares its ``doc_id`` with others, or has none: its strings
    are counted and it loses its own ranges.  An empty table gives an empty result.
    """
    spans = covered_spans(docs, kind="bytes", width=width, gram=gram, mode="elsewhere", resolve=repeated_windows)
    return apply_spans(docs, spans, "bytes")


def digest(result: DataFrame) -> DataFrame:
    return result.select(
        "doc_id",
        F.col("n_tokens").alias("n_bytes"),
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


# windows are taken from blocks of 1,600 starts, so that no text is walked once for each of its bytes
SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT rid, unnest(range(0, len(h) // 2, 1600)) AS o, h FROM d),
c AS (SELECT rid, o, least(1600, len(h) // 2 - 399 - o) AS m, substring(h, 2 * o + 1, 3998) AS s FROM b),
p AS (SELECT rid, o + j AS i, md5(substring(s, 2 * j + 1, 800)) AS m FROM (SELECT rid, o, s, unnest(range(0, m)) AS j FROM c WHERE m > 0)),
r AS (SELECT m FROM p GROUP BY m HAVING count(*) > 1),
t AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM p SEMI JOIN r USING (m)),
s AS (SELECT rid, min(i) AS a, max(i) + 400 AS z FROM (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS k FROM t) GROUP BY rid, k),
x AS (SELECT rid, a, z, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS e FROM s),
k AS (
  SELECT rid, sum(z - a) AS gone, count(*) AS n, max(z) AS tail, string_agg(substring(h, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) AS front
  FROM x JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(unhex(coalesce(front || substring(h, 2 * tail + 1), h))) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
