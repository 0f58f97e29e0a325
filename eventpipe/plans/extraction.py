"""Extract-stage queries: event pages written from ``part`` -> embedded JSON -> strict
decode -> MusicEvent -> start date -> document. Oracles read ``part`` directly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import extract as X
from ..sources import derived
from ..sources.tables import table, text_partitions
from . import sql as S


def _pages(spark, sf):
    return derived.part_event_pages(table(spark, sf, "part"))


def _decoded(spark, sf):
    return X.decode_event_data(X.embedded_json(_pages(spark, sf)))


def _events(spark, sf):
    return X.with_music_event(_decoded(spark, sf))


def embedded_json(spark, sf):
    return X.embedded_json(_pages(spark, sf))


def page_event_data(spark, sf):
    return _decoded(spark, sf).select("url", "json_ok", "title", "slug", "price", "first_date", "last_date")


def music_events(spark, sf):
    return X.flat_event(_events(spark, sf))


def event_start_dates(spark, sf):
    return _events(spark, sf).select(
        "slug", F.col("event.startDate").alias("start_date"), D.epoch_seconds(F.col("first_date")).alias("start_epoch")
    )


def event_documents(spark, sf):
    return X.with_document(_events(spark, sf)).select("pathname", "body")


def extract_outcomes(spark, sf):
    """The extract stage as a whole: messages to the newest page snapshots, each with its outcome and, if extracted, its document."""
    part = table(spark, sf, "part")
    snapshots = derived.part_snapshots(part)
    partitions = text_partitions(snapshots, "html")
    out = X.extract_events(derived.part_extract_messages(part), snapshots, snapshot_order="fetched_at", partitions=partitions)
    done = F.col("outcome") == "extracted"
    return out.select("venue", "url", "outcome", F.when(done, F.col("pathname")).alias("pathname"), F.when(done, F.col("body")).alias("body"))


QUERIES = {
    "embedded_json": embedded_json,
    "page_event_data": page_event_data,
    "music_events": music_events,
    "event_start_dates": event_start_dates,
    "event_documents": event_documents,
    "extract_outcomes": extract_outcomes,
}

# ---------------------------------------------------------------- oracle SQL (DuckDB)


def _date_sql(shift: int) -> str:
    return (
        "concat(strftime(DATE '2026-01-01' + CAST(p_partkey % 365 AS INTEGER), '%Y-%m-%d'), 'T', "
        f"lpad(CAST(p_size % 4 + 17 + {shift} AS VARCHAR), 2, '0'), ':', lpad(CAST(p_partkey % 4 * 15 AS VARCHAR), 2, '0'), ':00', "
        "CASE WHEN p_size % 5 = 0 THEN '.123' ELSE '' END, ['+01:00', '+02:00', 'Z', '+00:00'][p_size % 4 + 1])"
    )


PART_EVENTS_CTE = f"""part_events AS (
  SELECT p_partkey, p_size, p_name AS title,
         regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS name_key,
         concat(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-', CAST(p_partkey AS VARCHAR)) AS slug,
         CAST(trunc(p_retailprice) AS BIGINT) AS price,
         concat('https://', regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g'), '.example.com/event/', CAST(p_partkey AS VARCHAR)) AS url,
         {_date_sql(0)} AS first_date,
         {_date_sql(3)} AS last_date
  FROM part
)"""

START_DATE_SQL = (
    "regexp_replace(regexp_replace(first_date, '^(\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2})\\.\\d+', '\\1'), "
    "'[+-]00:00$', 'Z')"
)


def document_sql(title: str, start: str, url: str, price: str) -> str:
    """The serialised MusicEvent, built as text."""
    return (
        "concat('{\"@context\":\"https://schema.org\",\"@type\":\"MusicEvent\",\"name\":', "
        f"{S.json_str(title)}, ',\"startDate\":', {S.json_str(start)}, "
        "',\"location\":{\"@type\":\"\",\"name\":\"\",\"address\":{\"@type\":\"\",\"streetAddress\":\"\",\"addressLocality\":\"\",\"postalCode\":\"\",\"addressCountry\":\"\"}},\"performer\":{\"@type\":\"MusicGroup\",\"name\":', "
        f"{S.json_str(title)}, '}},\"offers\":{{\"@type\":\"Offer\",\"url\":', {S.json_str(url)}, ',\"price\":', CAST({price} AS VARCHAR), ',\"priceCurrency\":\"DKK\"}}}}')"
    )


def _with(body: str) -> str:
    return f"WITH {PART_EVENTS_CTE}\n{body}"


_PAYLOAD = (
    "concat('{\"props\":{\"pageProps\":{\"data\":{\"title\":', to_json(title), ',\"slug\":', to_json(slug), "
    "',\"price\":', CAST(price AS VARCHAR), ',\"firstDate\":', to_json(first_date), ',\"lastDate\":', to_json(last_date), "
    "'}},\"page\":\"/event/[slug]\"}}')"
)

ORACLES = {
    "embedded_json": _with(f"SELECT url, CAST(1 AS BIGINT) AS pos, {_PAYLOAD} AS json_text FROM part_events"),
    "page_event_data": _with("SELECT url, true AS json_ok, title, slug, price, first_date, last_date FROM part_events"),
    "music_events": _with(
        f"SELECT 'https://schema.org' AS context, 'MusicEvent' AS type, title AS name, {START_DATE_SQL} AS start_date, "
        "'MusicGroup' AS performer_type, title AS performer_name, 'Offer' AS offer_type, url AS offer_url, price, "
        "'DKK' AS price_currency FROM part_events"
    ),
    "event_start_dates": _with(
        f"SELECT slug, {START_DATE_SQL} AS start_date, "
        "CAST(floor(epoch(CAST(first_date AS TIMESTAMPTZ))) AS BIGINT) AS start_epoch FROM part_events"
    ),
    "extract_outcomes": _with(
        "SELECT venue, CASE WHEN outcome = 'bad_url' THEN replace(url, 'https://', 'https://[') ELSE url END AS url, outcome, "
        "CASE WHEN outcome = 'extracted' THEN concat(slug, '.json') END AS pathname, "
        f"CASE WHEN outcome = 'extracted' THEN {document_sql('title', START_DATE_SQL, 'url', 'price')} END AS body "
        "FROM (SELECT *, regexp_extract(url, '^https://([^/]*)', 1) AS venue, "
        "CASE WHEN p_partkey % 97 = 0 THEN 'bad_url' WHEN p_partkey % 73 = 0 THEN 'not_fetched' WHEN p_partkey % 89 = 0 THEN 'no_script' "
        "WHEN p_partkey % 83 = 0 THEN 'bad_json' WHEN p_partkey % 79 = 0 THEN 'empty_slug' ELSE 'extracted' END AS outcome FROM part_events)"
    ),
    "event_documents": _with(
        f"SELECT concat(slug, '.json') AS pathname, {document_sql('title', START_DATE_SQL, 'url', 'price')} AS body FROM part_events"
    ),
}
