"""Removal of boilerplate lines by their frequency within a site.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut

#: Content that is never shown, and what separates lines: tags and line feeds.
HIDDEN = r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>|<!--.*?-->"
BREAK = r"<[^>]*>|\n"
HOST = r"^[a-z][a-z0-9+.\-]*://([^/?#]+)"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; null where there is none."""
    found = F.regexp_extract(F.lower(url), HOST, 1)
    return F.when(found != "", found)


def lines_of(html: Column) -> Column:
    """Trimmed non-empty lines of a page in order; plain text splits at line feeds."""
    parts = F.split(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, ""), BREAK)
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def line_dedup(pages: DataFrame, ratio: float = 0.3, min_pages: int = 3) -> DataFrame:
    """Drop lines that stand on more than ``ratio`` of their host's pages, and on ``min_pages`` at least.

    Needs ``page_id, url, html``; other columns are ignored.  Returns one row per input row:
    ``page_id, host, n_lines, n_dropped, kept`` (the other lines, joined by line feeds).

    Every row is a page, repeated ``page_id`` or not; a line counts once a page.  Pages without a
    host keep all lines.  A null page text has no lines.  An empty table gives an empty result.

    Lines of a host shrink to counts before the shuffle, and its boilerplate list holds at most
    (mean lines a page / ratio) lines, so a host of a third of all pages costs no large group; the
    join by host splits such a host where Spark does not broadcast the measured list.
    """
    read = cut(pages.select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines")), "lines")
    hosted = read.filter("host IS NOT NULL")
    each = hosted.select("host", F.explode(F.array_distinct(F.transform("lines", _key))).alias("line"))
    counts = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    totals = hosted.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    lists = counts.join(totals, "host").filter(F.col("n") > ratio * F.col("total")).groupBy("host").agg(F.collect_list("line").alias("common"))
    joined = read.join(cut(lists, "boilerplate"), "host", "left")
    own = F.coalesce(F.array_intersect(F.transform("lines", _key), "common"), F.array().cast("array<struct<a:bigint,b:int>>"))
    kept = F.filter("lines", lambda x: ~F.array_contains(F.col("own"), _key(x)))
    out = joined.withColumn("own", own).withColumn("left", F.when(F.size("own") == 0, F.col("lines")).otherwise(kept))
    n = F.size("lines").cast("long")
    return out.select("page_id", "host", n.alias("n_lines"), (n - F.size("left")).alias("n_dropped"), F.concat_ws("\n", "left").alias("kept"))


def digest(result: DataFrame) -> DataFrame:
    return result.select("page_id", "host", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = rf"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id, nullif(regexp_extract(lower(url), '{HOST}', 1), '') AS host,
    list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(html, ''), '{HIDDEN}', '', 'g'), '<[^>]*>|\n'),
      lambda x: trim(x, chr(32) || chr(9) || chr(13))), lambda x: x <> '') AS lines
  FROM pages),
n AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p WHERE host IS NOT NULL) GROUP BY ALL),
t AS (SELECT host, count(*) AS total FROM p WHERE host IS NOT NULL GROUP BY host),
b AS (SELECT host, line FROM n JOIN t USING (host) WHERE n >= 3 AND n > 0.3 * total),
e AS (SELECT rid, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM p),
k AS (SELECT rid, string_agg(line, chr(10) ORDER BY i) AS kept, count(*) AS c FROM e ANTI JOIN b USING (host, line) GROUP BY rid)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(c, 0) AS BIGINT) AS n_dropped,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM p LEFT JOIN k USING (rid)
"""
