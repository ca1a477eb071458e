"""Registered walk / incremental queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.sources.fixtures import page_chain, with_fixtures
from vitrine.streaming.page_walk import walk_all


def q_page_walk(spark, sf_dir):
    """Every page reached from each chain head, or from the smallest url of
    a cycle without one, with its depth."""
    return walk_all(page_chain(spark, sf_dir).select("url", "next_url")).select("start", "url", "depth")


def q_page_walk_counts(spark, sf_dir):
    """T2 + A3: pages per walk (distinct URLs reached from each start)."""
    w = walk_all(page_chain(spark, sf_dir).select("url", "next_url"))
    return w.groupBy("start").agg(F.count(F.lit(1)).alias("pages"), F.max("depth").alias("max_depth"))


QUERIES = {
    "page_walk": q_page_walk,
    "page_walk_counts": q_page_walk_counts,
}

_WALK = with_fixtures("page_chain") + """,
edges AS (SELECT DISTINCT url, next_url FROM page_chain WHERE next_url IS NOT NULL AND next_url <> url),
reach AS (WITH RECURSIVE r(a, b) AS (
    SELECT url, next_url FROM edges UNION SELECT r.a, e.next_url FROM r JOIN edges e ON e.url = r.b) SELECT * FROM r),
circle AS (SELECT a AS url, min(b) AS cycle FROM reach WHERE a IN (SELECT a FROM reach WHERE a = b) GROUP BY a),
heads AS (SELECT DISTINCT url FROM page_chain
          WHERE url NOT IN (SELECT next_url FROM page_chain WHERE next_url IS NOT NULL AND next_url <> url)
          UNION SELECT cycle FROM circle WHERE cycle NOT IN (
            SELECT c.cycle FROM edges e JOIN circle c ON e.next_url = c.url WHERE e.url NOT IN (SELECT url FROM circle))),
walk AS (SELECT start, url, min(depth) AS depth FROM (
  WITH RECURSIVE w(start, url, depth) AS (
    SELECT url, url, 0 FROM heads
    UNION
    SELECT w.start, e.next_url, w.depth + 1 FROM w JOIN edges e ON e.url = w.url WHERE w.depth < 1000)
  SELECT * FROM w) GROUP BY start, url)
"""

ORACLES = {
    "page_walk": _WALK + "SELECT start, url, CAST(depth AS INTEGER) AS depth FROM walk",
    "page_walk_counts": _WALK + "SELECT start, count(*) AS pages, CAST(max(depth) AS INTEGER) AS max_depth FROM walk GROUP BY start",
}
