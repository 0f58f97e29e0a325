"""Follow (J3) to the last new node over a link graph from ``lineitem``: supplier -> part and back; URLs of earlier runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import crawl, links
from ..sources.tables import table
from . import pages as P
from . import sql as S


def _edges(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey")
    s = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    p = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    return li.select(s.alias("src"), p.alias("dst")).unionByName(li.select(p.alias("src"), s.alias("dst")))


def crawl_reach(spark, sf):
    seeds = table(spark, sf, "lineitem").agg(F.concat(F.lit("s"), F.min("l_suppkey").cast("string")).alias("node"))
    return crawl.follow(_edges(spark, sf), seeds, max_depth=None)


def visited_runs(spark, sf):
    """Three runs over one visited table: the URLs of the pages themselves, the links found on them, and the same links again, which add none."""
    pages = P.read_pages(spark, sf)
    found = links.followable(links.resolve_links(links.extract_links(pages))).select(F.col("abs_url").alias("url")).checkpoint()
    visited = crawl.VisitedTable(spark, f"visited_{uuid.uuid4().hex}")
    runs = [pages.select(U.without_fragment(F.col("url")).alias("url")), found, found]
    new = [visited.add(urls).select(F.lit(k).alias("run"), "url") for k, urls in enumerate(runs, 1)]
    counted = visited.read().groupBy("url").agg(F.count("*").alias("n_stored")).checkpoint()
    spark.sql(f"DROP TABLE {visited.name}")  # of this query alone
    return new[0].unionByName(new[1]).unionByName(new[2]).join(counted, "url", "full")


QUERIES = {"crawl_reach": crawl_reach, "visited_runs": visited_runs}

ORACLES = {
    "crawl_reach": """WITH RECURSIVE edges AS (
  SELECT 's' || CAST(l_suppkey AS VARCHAR) AS src, 'p' || CAST(l_partkey AS VARCHAR) AS dst FROM lineitem
  UNION SELECT 'p' || CAST(l_partkey AS VARCHAR), 's' || CAST(l_suppkey AS VARCHAR) FROM lineitem
),
walk(node, depth) USING KEY (node) AS (
  SELECT 's' || CAST(min(l_suppkey) AS VARCHAR), 1 FROM lineitem
  UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON w.node = e.src
    LEFT JOIN recurring.walk r ON r.node = e.dst WHERE r.node IS NULL
)
SELECT node, depth FROM walk""",
    "visited_runs": P._with(
        f"SELECT url, CAST(min(run) AS INTEGER) AS run, CAST(1 AS BIGINT) AS n_stored FROM (SELECT {S.without_fragment('url')} AS url, 1 AS run FROM pages "
        "UNION ALL SELECT abs_url, 2 FROM ok) WHERE url IS NOT NULL GROUP BY url"
    ),
}
