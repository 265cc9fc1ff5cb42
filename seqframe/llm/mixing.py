"""Mixing of sources to target weights in tokens.

Method: entropy balancing.  The rates w of a source's documents minimise the sum of d (w ln w - w) under
the token constraint sum(size w) = target and 0 <= w <= most.  A document's weight d is 1 + size / mean
size: one part for the document, one for its words.  So w = least(most, exp(lambda c)) with the document's
constraint value c = size / (size + mean size), between 0 and 1; one lambda a source maximises the concave
dual.  It is found by Newton steps whose gradients and Hessians are sums over the documents, aggregated by
Spark, and kept within a bracket.  A target above the source's words tilts to its long documents, one below
to its short ones.  Rates are rounded into copies along classes of similar size, so that the taken tokens
stay near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import dense_pos
from ..plans.ranking import div
from ._shared import cut, named, packed

WORD = r"[^\x20\x09-\x0D]+"
#: Whole units of a rate of one: sums of rates are exact.
UNIT = 10**8


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill_level(sources: DataFrame, share: float, most: float) -> float:
    """The level at which ``least(most * source_size, level * w)`` shares out ``share`` times all words.

    Sources that the level fills leave their excess to the others; each round is one distributed
    aggregation, and the filled ones only become more.
    """
    level, before = 0.0, -1
    words = F.col("source_size") * F.lit(most)
    while True:
        full = words < F.lit(level) * F.col("w")
        sums = F.sum("source_size").alias("total"), F.count_if(full).alias("n"), F.sum(F.when(full, words)).alias("filled"), F.sum(F.when(~full, F.col("w"))).alias("open")
        r = sources.filter("source_size > 0").agg(*sums).head()
        if not r.open:
            return float("inf")
        if r.n == before:
            return level
        level, before = (share * r.total - (r.filled or 0.0)) / r.open, r.n


def planned(counts: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``source, source_size, n_docs, target``: words, documents and target words of each source, any number of them."""
    words = F.sum(F.col("size") * F.col("n")).alias("source_size")
    sized = cut(counts.groupBy("source").agg(words, F.sum("n").alias("n_docs")), "sources")
    known = sized.filter("source IS NOT NULL")
    last = sized.filter("source IS NULL").withColumn("at", F.lit(known.count()).cast("long"))
    ranked = dense_pos(known, "source", pos="at").unionByName(last)
    own = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("at", F.lit(len(weights))) + 1).cast("int"))
    ranked = cut(ranked.select("source", "source_size", "n_docs", own.alias("w")), "weighed")
    goal = F.least(F.col("source_size") * F.lit(float(most)), F.lit(fill_level(ranked, share, most)) * F.col("w"))
    return ranked.select("source", "source_size", "n_docs", F.when(F.col("source_size") > 0, goal).otherwise(F.lit(0.0)).alias("target"))


def tilt(size: Column, source_size: Column, n_docs: Column) -> Column:
    """A document's constraint value."""
    return F.when(size > 0, size / (size + source_size / n_docs)).otherwise(F.lit(0.0))


def entropy_balance(strata: DataFrame, plan: DataFrame, most: float, steps: int = 80, tolerance: float = 1e-13) -> DataFrame:
    """``source, lam``: the dual solution for ``sum(n * size * least(most, exp(lam * c))) = target`` in every source.

    ``strata`` (source, size, n) holds documents counted by equal size.  Each step is one distributed
    aggregation of gradient and Hessian; the solution is a stored frame, so sources may be many.  Sources
    whose target is 0 or ``most`` times their words have no finite solution and are left out.
    """
    open_ = plan.filter((F.col("target") > 0) & (F.col("target") < F.lit(most) * F.col("source_size")))
    both = strata.withColumnRenamed("source", "s").join(open_, F.col("s").eqNullSafe(F.col("source")))
    mass = cut(both.select("s", (F.col("size") * F.col("n")).cast("double").alias("words"), tilt(F.col("size"), F.col("source_size"), F.col("n_docs")).alias("c")), "masses")
    none = F.lit(None).cast("double")
    now = open_.select("source", "target", F.lit(0.0).alias("lam"), none.alias("low"), none.alias("high"))
    lam, low, high = F.col("lam"), F.col("low"), F.col("high")
    for _ in range(steps):
        rate = F.exp(lam * F.col("c"))
        slope = F.when(rate < most, F.col("words") * F.col("c") * rate).otherwise(0.0)
        met = now.join(mass, F.col("source").eqNullSafe(F.col("s"))).groupBy("source", "target", "lam", "low", "high")
        sums = met.agg(F.sum(F.col("words") * F.least(rate, F.lit(float(most)))).alias("g"), F.sum(slope).alias("h")).withColumn("gap", F.col("target") - F.col("g"))
        sums = sums.withColumns({"low": F.when(F.col("gap") >= 0, lam).otherwise(low), "high": F.when(F.col("gap") <= 0, lam).otherwise(high)})
        leap = F.when(F.col("h") > 0, F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.col("gap") / F.col("h")))).otherwise(F.signum("gap") * 4.0)
        new = lam + leap
        outside = (new <= low) | (new >= high)
        new = F.when(F.col("gap") == 0, lam).when(outside & low.isNotNull() & high.isNotNull(), (low + high) / 2.0).otherwise(new)
        now = cut(sums.select("source", "target", new.alias("lam"), "low", "high", (F.abs("gap") / F.col("target")).alias("worst")), "tilts")
        if (now.agg(F.max("worst")).head()[0] or 0.0) <= tolerance:
            break
        now = now.drop("worst")
    return now.select("source", "lam")


def rated(counts: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``source, source_size, n_docs, target, lam`` of every source; ``lam`` is null where the rate is 0 or ``most``."""
    plan = cut(planned(counts, weights, share, most), "plan")
    strata = cut(counts.groupBy("source", "size").agg(F.sum("n").alias("n")), "strata")
    lam = entropy_balance(strata, plan, most).withColumnRenamed("source", "s")
    return cut(plan.join(lam, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "rates")


def units(size: Column, most: float) -> Column:
    """The rate of a document in whole units, from the columns of `rated`."""
    w = F.least(F.exp(F.col("lam") * tilt(size, F.col("source_size"), F.col("n_docs"))), F.lit(float(most)))
    closed = F.when(F.col("target") > 0, F.lit(float(most))).otherwise(F.lit(0.0))
    return F.round(F.coalesce(w, closed) * UNIT).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, carry: list[str] | None = None) -> DataFrame:
    """How many copies of each document the mix takes.

    Needs ``doc_id, text, source``.  Sources in order of code point, null last, weigh ``weights``,
    repeating, and share ``share`` times all words; a target stops at ``most`` times its source's words
    and the excess is dealt again.  Returns the columns of ``carry`` (default: all) with ``size``
    (words), ``source_size``, ``target`` and ``copies`` (0 to ``most`` rounded up) in place of columns
    of these names; other columns may have any names.

    Within a source, documents are ordered by size class and ``doc_id``; a document whose rates up to it sum
    to x, and to y before it, gets floor(x + 1/2) - floor(y + 1/2) copies, so sums stay near the target and
    reruns agree.  Null texts have size 0, null sources are one source, repeated rows are rows of their own,
    and an empty table gives an empty result.
    """
    names = [c for c in (docs.columns if carry is None else carry) if c not in ("size", "source_size", "target", "copies")]
    held = packed(docs.select("doc_id", "text", "source", *named([c for c in names if c not in ("doc_id", "text", "source")])), "doc_id", "text", "source")
    kept = F.struct(*[F.col("_row")[c].alias(c) for c in names]) if names else F.struct(F.lit(None).alias("none"))
    bare = held.select(kept.alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"))
    # classes of 1/16 of a doubling, each in cells of doc_id: bounded in number, cells of a hot class are many
    # never null: otherwise the join tests both first, and counts the words anew for that
    level = F.coalesce(F.when(F.col("size") > 0, F.floor(F.log2("size") * 16) + 1).otherwise(0).cast("int"), F.lit(0))
    cell = F.coalesce(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(64)).cast("int"), F.lit(0))
    if set(names) <= {"doc_id", "source"}:  # narrow rows are stored, so that texts are read once
        bare = cut(bare, "sizes")
    sized = bare.withColumns({"class": level, "cell": cell})
    counts = cut(sized.groupBy("source", "class", "cell", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    rates = rated(counts, weights, share, most)
    known = rates.withColumnRenamed("source", "s")
    each = counts.join(known, F.col("source").eqNullSafe(F.col("s")))
    cells = each.groupBy("source", "class", "cell").agg(F.sum(F.col("n") * units(F.col("size"), most)).alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("source").orderBy("class", "cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = cells.select(F.col("source").alias("s"), F.col("class").alias("k"), F.col("cell").alias("c"), F.coalesce(before, F.lit(0)).alias("start"))
    starts = cut(starts, "starts").join(rates, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    starts = cut(starts, "cells")
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("k")) & (F.col("cell") == F.col("c"))
    rows = sized.join(starts, same).withColumn("units", units(F.col("size"), most))
    upto = F.sum("units").over(Window.partitionBy("source", "class", "cell").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    ranked = rows.withColumn("upto", F.col("start") + upto)
    step = lambda x: div(x + UNIT // 2, UNIT)
    copies = (step(F.col("upto")) - step(F.col("upto") - F.col("units"))).alias("copies")
    return ranked.select(*[F.col("_row")[c].alias(c) for c in names], "size", "source_size", "target", copies)


def digest(docs: DataFrame) -> DataFrame:
    mixed = mix(docs.select("doc_id", "text", "source"), carry=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS words, count(*) AS docs,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM d GROUP BY source),
-- sources fill in order of words / weight: those below the common level stop at twice their words
o AS (
  SELECT *, row_number() OVER (ORDER BY words / w, source NULLS LAST) AS place, 1.5 * sum(words) OVER () AS total,
    coalesce(sum(2.0 * words) OVER (ORDER BY words / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(w) OVER (ORDER BY words / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM s),
u AS (SELECT arg_min((total - filled) / open_w, place) FILTER (WHERE (total - filled) / open_w * w <= 2.0 * words) AS unit FROM o),
t AS (SELECT source, words, docs, CAST(least(2.0 * words, coalesce(unit, 1e300) * w) AS DOUBLE) AS target FROM s, u),
-- the tilt of each source whose target lies between 0 and twice its words, by halving
m AS (SELECT t.source, t.target, CAST(size AS DOUBLE) * count(*) AS mass, CASE WHEN size > 0 THEN size / (size + words / docs) ELSE 0.0 END AS c
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE target > 0 AND target < 2.0 * words GROUP BY t.source, t.target, size, words, docs),
h AS (
  SELECT 0 AS i, source, target, -100000.0::DOUBLE AS low, 100000.0::DOUBLE AS high FROM (SELECT DISTINCT source, target FROM m)
  UNION ALL
  SELECT i + 1, source, target, CASE WHEN g < target THEN (low + high) / 2 ELSE low END, CASE WHEN g < target THEN high ELSE (low + high) / 2 END
  FROM (SELECT i, h.source, h.target, low, high, sum(mass * CASE WHEN (low + high) / 2 * c > 1 THEN 2.0 ELSE least(2.0, exp((low + high) / 2 * c)) END) AS g
    FROM h JOIN m ON h.source IS NOT DISTINCT FROM m.source WHERE i < 100 GROUP BY ALL)),
l AS (SELECT source, (low + high) / 2 AS lam FROM h WHERE i = 100),
w AS (
  SELECT doc_id, d.source, size, words, target, CAST(round(100000000 * CASE WHEN lam IS NOT NULL THEN
      CASE WHEN size = 0 THEN 1.0 WHEN lam * size / (size + words / docs) > 1 THEN 2.0 ELSE least(2.0, exp(lam * (size / (size + words / docs)))) END
    WHEN target > 0 THEN 2.0 ELSE 0.0 END) AS HUGEINT) AS r
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN l ON l.source IS NOT DISTINCT FROM d.source),
k AS (
  SELECT *, sum(r) OVER (PARTITION BY source ORDER BY
    CASE WHEN size > 0 THEN floor(log2(size) * 16) + 1 ELSE 0 END, ((coalesce(doc_id, 0) % 64) + 64) % 64, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS x FROM w)
SELECT doc_id, size, words AS source_size, target, CAST(size * ((x + 50000000) // 100000000 - (x - r + 50000000) // 100000000) AS BIGINT) AS taken
FROM k
"""
