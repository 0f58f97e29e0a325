"""Scrape-stage queries over the ``pages`` snapshots: venue = host of the page.

Chain: pages -> links (P1) -> absolute (P3) -> host (P4) -> scope (P5) ->
first seen per (venue, url) (W3) -> not yet visited (J4) -> sequence (W1) ->
schedule (W2) -> ``{venue,url}`` messages (K2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import jobs
from ..functions import jsontext
from ..functions import urls as U
from ..operators import crawl, links, sequencing
from ..session import state_path
from ..sources.tables import pages as read_pages
from ..specs import LinkSpec
from . import params
from . import sql as S

ORDER = ["depth", "src_url", "pos", "page_id"]


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    return links.resolve_links(links.extract_links(read_pages(spark, sf)))


def _ok(spark, sf) -> DataFrame:
    return links.followable(_resolved(spark, sf))


def _first_seen_of(pages: DataFrame) -> DataFrame:
    ok = links.followable(links.resolve_links(links.extract_links(pages))).select("venue", "abs_url", *ORDER)
    return crawl.first_seen(ok, key=["venue", "abs_url"], order=ORDER).withColumnRenamed("abs_url", "url")


def _visited_of(pages: DataFrame) -> DataFrame:
    """Pages already fetched, keyed like discovered links: (host, url without fragment)."""
    return links.with_venue_host(pages).select("venue", U.without_fragment(F.col("url")).alias("url"))


def _new_of(pages: DataFrame) -> DataFrame:
    return crawl.drop_visited(_first_seen_of(pages), _visited_of(pages), ["venue", "url"])


def _new(spark, sf) -> DataFrame:
    return _new_of(read_pages(spark, sf))


def _sequenced(spark, sf) -> DataFrame:
    return sequencing.number_within(_new(spark, sf), ["venue"], ORDER, out="seq")


def venue_registry(spark, sf):
    p = links.with_venue_host(read_pages(spark, sf))
    return p.groupBy("venue").agg(
        F.regexp_extract(F.min("url"), U.ORIGIN_RE, 1).alias("base_url"), F.count(F.lit(1)).alias("n_pages")
    )


def page_links(spark, sf):
    return links.extract_links(read_pages(spark, sf)).select(*links.LINK_COLUMNS)


def resolved_links(spark, sf):
    return _resolved(spark, sf).select("page_id", "pos", "href", "status", "abs_url")


def link_hosts(spark, sf):
    return links.with_link_host(_ok(spark, sf)).select("page_id", "pos", "abs_url", "host")


def domain_scoped_links(spark, sf):
    return links.scope_to_host(_ok(spark, sf)).select("page_id", "pos", "venue", "abs_url")


def distinct_urls(spark, sf):
    return crawl.distinct_count(_ok(spark, sf), ["venue"], "abs_url", "n_urls")


def first_seen_urls(spark, sf):
    return _first_seen_of(read_pages(spark, sf)).select("venue", "url", "src_url", "pos")


def new_urls(spark, sf):
    return _new(spark, sf).select("venue", "url")


def message_sequence(spark, sf):
    scalable = sequencing.number_within(_new(spark, sf), ["venue"], ORDER, out="seq")
    return scalable.select("venue", "url", "seq")


def extract_messages(spark, sf):
    s = _sequenced(spark, sf)
    return s.select(
        F.lit(params.EXTRACT_TOPIC).alias("topic"),
        "venue",
        "url",
        "seq",
        jsontext.encode(F.struct("venue", "url")).alias("body"),
    )


def delivery_schedule(spark, sf):
    s = sequencing.with_schedule(_sequenced(spark, sf), params.RUN_TS)
    return s.select("venue", "url", "seq", "delay_s", "deliver_at")


def published_counts(spark, sf):
    """The last of n messages is due n steps after the run, so the count is enough: nothing is numbered."""
    n = F.count(F.lit(1))
    return _new(spark, sf).groupBy("venue").agg(n.alias("n_messages"), (n * F.lit(sequencing.DELAY_STEP_SECONDS)).cast("long").alias("last_delay_s"))


def scrape_messages(spark, sf):
    reg = venue_registry(spark, sf)
    return reg.select(
        F.lit(params.SCRAPE_TOPIC).alias("topic"), "venue", jsontext.encode(F.struct("venue")).alias("body")
    )


def _top_venue(spark, sf) -> DataFrame:
    """The venue with the most pages (ties: smallest name): one row, no driver round trip."""
    reg = venue_registry(spark, sf)
    return reg.orderBy(F.desc("n_pages"), "venue").limit(1).select("venue")


def single_venue_run(spark, sf):
    """One venue's run: its pages are picked first, so no other page's text is parsed."""
    own = links.with_venue_host(read_pages(spark, sf)).join(F.broadcast(_top_venue(spark, sf)), "venue", "left_semi")
    return sequencing.number_within(_new_of(own.drop("venue")), ["venue"], ORDER, out="seq").select("venue", "url", "seq")


def scrape_all_venues(spark, sf):
    """Every venue's run in one job, to the last new page: each host is a venue, its smallest URL the seed.

    The messages go through the message log, partitioned by topic.
    """
    p = links.with_venue_host(read_pages(spark, sf))
    registry = p.groupBy("venue").agg(F.min("url").alias("seed_url")).select("venue", F.col("venue").alias("host"), "seed_url", F.lit(0).alias("spec"))
    messages, _ = jobs.scrape_all(read_pages(spark, sf), registry, [LinkSpec()], params.RUN_TS)
    log = state_path(spark, "message-log")
    jobs.publish(messages, params.EXTRACT_TOPIC, log)
    return spark.read.parquet(log).select("topic", "venue", "url", "body")


def broken_page_links(spark, sf):
    """Links of pages that end in one unclosed tag as long as the page: each page's own markup, without an end, after three links.

    The links hold character references, a tag inside an attribute, and a tag inside raw text.
    """
    n = F.col("page_id").cast("string")
    broken = F.concat(
        F.lit('<a href="/p'), n, F.lit('?a=1&amp;b=2&aring;&#38;amp;">x</a><title><a href="/no"></title><a title="<a href=\'/no\'>" href=\'/e&#x3D;'), n,
        F.lit("'>y</a><!-- <a href=/no> --><a>z</a><a href=/q "), F.translate("html", ">", " "),
    )
    pages = read_pages(spark, sf).select("page_id", "url", broken.alias("html"))
    return links.extract_links(pages).select("page_id", "pos", "href")


QUERIES = {
    "broken_page_links": broken_page_links,
    "venue_registry": venue_registry,
    "page_links": page_links,
    "resolved_links": resolved_links,
    "link_hosts": link_hosts,
    "domain_scoped_links": domain_scoped_links,
    "distinct_urls": distinct_urls,
    "first_seen_urls": first_seen_urls,
    "new_urls": new_urls,
    "message_sequence": message_sequence,
    "extract_messages": extract_messages,
    "delivery_schedule": delivery_schedule,
    "published_counts": published_counts,
    "scrape_messages": scrape_messages,
    "single_venue_run": single_venue_run,
    "scrape_all_venues": scrape_all_venues,
}

# ---------------------------------------------------------------- oracle SQL (DuckDB)

_ANCHORS = S.select_attr("html", "a", "href")
_LINKS = f"""
links AS (
  SELECT page_id, url AS src_url, {S.host('url')} AS venue, 1 AS depth,
         CAST(unnest(range(1, len(h) + 1)) AS BIGINT) AS pos, unnest(h) AS href
  FROM (SELECT page_id, url, {_ANCHORS} AS h FROM pages)
),
resolved AS (
  SELECT *, {S.link_status('href')} AS status, {S.resolve('src_url', 'href')} AS abs_url FROM links
),
ok AS (SELECT * FROM resolved WHERE status = 'ok'),
first_seen AS (
  SELECT venue, abs_url AS url, depth, src_url, pos, page_id FROM (
    SELECT *, row_number() OVER (PARTITION BY venue, abs_url ORDER BY depth, src_url, pos, page_id) AS rn FROM ok
  ) WHERE rn = 1
),
visited AS (SELECT DISTINCT {S.host('url')} AS venue, {S.without_fragment('url')} AS url FROM pages),
new_urls AS (SELECT f.* FROM first_seen f ANTI JOIN visited v ON f.venue = v.venue AND f.url = v.url),
seq AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY venue ORDER BY depth, src_url, pos, page_id) AS BIGINT) AS seq
  FROM new_urls
),
registry AS (
  SELECT {S.host('url')} AS venue, regexp_extract(min(url), {S.lit(U.ORIGIN_RE)}, 1) AS base_url,
         count(*) AS n_pages
  FROM pages GROUP BY 1
)"""


def _with(body: str) -> str:
    return f"WITH {_LINKS}\n{body}"


ORACLES = {
    "broken_page_links": "SELECT page_id, CAST(1 AS BIGINT) AS pos, concat('/p', page_id, '?a=1&b=2å&amp;') AS href FROM pages "
    "UNION ALL SELECT page_id, 2, concat('/e=', page_id) FROM pages UNION ALL SELECT page_id, 3, NULL FROM pages",
    "venue_registry": _with("SELECT venue, base_url, n_pages FROM registry"),
    "page_links": _with("SELECT page_id, src_url, venue, depth, pos, href FROM links"),
    "resolved_links": _with("SELECT page_id, pos, href, status, abs_url FROM resolved"),
    "link_hosts": _with(f"SELECT page_id, pos, abs_url, {S.host('abs_url')} AS host FROM ok"),
    "domain_scoped_links": _with(f"SELECT page_id, pos, venue, abs_url FROM ok WHERE {S.host('abs_url')} = venue"),
    "distinct_urls": _with("SELECT venue, count(DISTINCT abs_url) AS n_urls FROM ok GROUP BY venue"),
    "first_seen_urls": _with("SELECT venue, url, src_url, pos FROM first_seen"),
    "new_urls": _with("SELECT venue, url FROM new_urls"),
    "message_sequence": _with("SELECT venue, url, seq FROM seq"),
    "extract_messages": _with(
        f"SELECT '{params.EXTRACT_TOPIC}' AS topic, venue, url, seq, "
        f"concat('{{\"venue\":', {S.json_str('venue')}, ',\"url\":', {S.json_str('url')}, '}}') AS body FROM seq"
    ),
    "delivery_schedule": _with(
        f"SELECT venue, url, seq, seq * {sequencing.DELAY_STEP_SECONDS} AS delay_s, "
        f"TIMESTAMP '{params.RUN_TS}' + to_seconds(seq * {sequencing.DELAY_STEP_SECONDS}) AS deliver_at FROM seq"
    ),
    "published_counts": _with(
        f"SELECT venue, count(*) AS n_messages, max(seq) * {sequencing.DELAY_STEP_SECONDS} AS last_delay_s "
        "FROM seq GROUP BY venue"
    ),
    "scrape_messages": _with(
        f"SELECT '{params.SCRAPE_TOPIC}' AS topic, venue, concat('{{\"venue\":', {S.json_str('venue')}, '}}') AS body "
        "FROM registry"
    ),
    "scrape_all_venues": _with("").replace("WITH", "WITH RECURSIVE", 1).rstrip() + f""",
seeds AS (SELECT {S.host('url')} AS venue, min(url) AS url FROM pages GROUP BY 1),
walk AS (
  SELECT venue, url FROM seeds
  UNION SELECT o.venue, o.abs_url FROM walk w JOIN ok o ON o.venue = w.venue AND o.src_url = w.url
  WHERE {S.host('o.abs_url')} = o.venue
),
found AS (SELECT DISTINCT o.venue, o.abs_url AS url FROM ok o JOIN walk w ON o.venue = w.venue AND o.src_url = w.url)
SELECT '{params.EXTRACT_TOPIC}' AS topic, f.venue, f.url, concat('{{"venue":', {S.json_str('f.venue')}, ',"url":', {S.json_str('f.url')}, '}}') AS body
FROM found f LEFT JOIN seeds s ON s.venue = f.venue AND s.url = f.url WHERE s.url IS NULL""",
    "single_venue_run": _with(
        "SELECT s.venue, s.url, s.seq FROM seq s JOIN "
        "(SELECT venue FROM registry ORDER BY n_pages DESC, venue LIMIT 1) t ON s.venue = t.venue"
    ),
}
