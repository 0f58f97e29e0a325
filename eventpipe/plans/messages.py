"""Queue-side queries: messages and envelopes written from ``events`` (venue =
``event_type``; registry = three of the five types)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.zones import day_text
from ..operators import routing as R
from ..sources import derived
from ..sources.tables import table
from ..specs import VenueSpec, registry_frame
from . import params
from . import pages as P
from . import sql as S


def message_registry(spark):
    specs = [VenueSpec(name=v, seed_url=f"https://{v}.example.com") for v in params.MESSAGE_VENUES]
    return registry_frame(spark, specs)


def _messages(spark, sf):
    return derived.event_messages(table(spark, sf, "events"))


def _decoded(spark, sf, fields=R.EXTRACT_FIELDS):
    return R.decode_messages(_messages(spark, sf), "body", fields)


def _routed(spark, sf):
    return R.route(_decoded(spark, sf), message_registry(spark))


def decode_scrape_messages(spark, sf):
    return _decoded(spark, sf, R.SCRAPE_FIELDS).select("message_id", "decode_ok", "venue")


def decode_extract_messages(spark, sf):
    return _decoded(spark, sf).select("message_id", "decode_ok", "venue", "url")


def envelope_decode(spark, sf):
    env = R.decode_envelopes(derived.event_envelopes(table(spark, sf, "events")))
    dec = R.decode_messages(env, "payload")
    outcome = F.when(~F.col("b64_ok"), F.lit("bad_base64")).when(~F.col("decode_ok"), F.lit("malformed")).otherwise(F.lit("ok"))
    return dec.select("message_id", "receipt_handle", "payload", "venue", "url", outcome.alias("outcome"))


def message_routing(spark, sf):
    return _routed(spark, sf).select("message_id", "venue", "outcome")


def messages_with_venue(spark, sf):
    return R.accepted_with_venue(_decoded(spark, sf), message_registry(spark)).select("message_id", "venue", "url", "base_url")


def unknown_venues(spark, sf):
    return R.unknown_venues(_decoded(spark, sf), message_registry(spark)).select("message_id", "venue")


def required_fields(spark, sf):
    return R.required_field_violations(_decoded(spark, sf))


def message_contract(spark, sf):
    return R.key_contract(_messages(spark, sf))


def dead_letters(spark, sf):
    return R.dead_letters(_routed(spark, sf))


def run_metrics(spark, sf):
    return R.run_metrics(_routed(spark, sf))


def publish_outcome(spark, sf):
    m = _decoded(spark, sf)
    attempts = m.select(
        day_text(F.col("ts")).alias("run_id"), F.col("sent_venue").alias("venue"), (~F.col("decode_ok")).alias("failed")
    )
    return R.publish_outcome(attempts, "run_id", "venue", "failed", message_registry(spark))


def pages_for_messages(spark, sf):
    """Extract messages (discovered URLs plus the pages' own URLs) joined to the page snapshots."""
    from ..sources.tables import pages as read_pages
    from ..operators.links import with_venue_host

    pages = read_pages(spark, sf)
    own = with_venue_host(pages).select("venue", "url")
    msgs = P._new(spark, sf).select("venue", "url").unionByName(own)
    joined = msgs.join(pages.select("url", "page_id"), "url", "left")
    outcome = F.when(F.col("page_id").isNull(), F.lit("not_fetched")).otherwise(F.lit("fetched"))
    return joined.select("venue", "url", "page_id", outcome.alias("outcome"))


QUERIES = {
    "decode_scrape_messages": decode_scrape_messages,
    "decode_extract_messages": decode_extract_messages,
    "envelope_decode": envelope_decode,
    "message_routing": message_routing,
    "messages_with_venue": messages_with_venue,
    "unknown_venues": unknown_venues,
    "required_fields": required_fields,
    "message_contract": message_contract,
    "dead_letters": dead_letters,
    "run_metrics": run_metrics,
    "publish_outcome": publish_outcome,
    "pages_for_messages": pages_for_messages,
}

# ---------------------------------------------------------------- oracle SQL (DuckDB)

_REG_VALUES = ", ".join(f"('{v}', 'https://{v}.example.com')" for v in params.MESSAGE_VENUES)

MESSAGES_CTE = f"""registry(venue, base_url) AS (VALUES {_REG_VALUES}),
msg AS (
  SELECT 'm-' || CAST(event_id AS VARCHAR) AS message_id, event_id, ts, event_type AS sent_venue,
    CASE
      WHEN event_id % 97 = 0 THEN substring(good, 1, 17)
      WHEN event_id % 89 = 0 THEN concat('{{"name":"', event_type, '","url":"', url, '"}}')
      WHEN event_id % 83 = 0 THEN concat('{{"venue":"', event_type, '","url":""}}')
      WHEN event_id % 79 = 0 THEN concat('{{"venue":"', event_type, '","url":"https://[', event_type, '.example.com/e/"}}')
      ELSE good END AS body
  FROM (
    SELECT *, concat('{{"venue":"', event_type, '","url":"', url, '"}}') AS good FROM (
      SELECT *, concat('https://', event_type, '.example.com/e/', CAST(user_id AS VARCHAR), '?k=',
                       coalesce(json_extract_string(props, '$.k'), '')) AS url FROM events))
),
dec AS (
  SELECT message_id, event_id, ts, sent_venue, body, json_valid(body) AS decode_ok,
         CASE WHEN json_valid(body) THEN coalesce(json_extract_string(body, '$.venue'), '') END AS venue,
         CASE WHEN json_valid(body) THEN coalesce(json_extract_string(body, '$.url'), '') END AS url
  FROM msg
),
routed AS (
  SELECT d.*, CASE WHEN NOT decode_ok THEN 'malformed'
                   WHEN d.venue NOT IN (SELECT venue FROM registry) THEN 'unknown_venue'
                   ELSE 'accepted' END AS outcome
  FROM dec d
)"""


def _with(body: str) -> str:
    return f"WITH {MESSAGES_CTE}\n{body}"


_ENVELOPE = """env AS (
  SELECT message_id, 'lease-' || CAST(event_id AS VARCHAR) AS receipt_handle,
         CASE WHEN event_id % 101 = 0 THEN NULL ELSE body END AS payload
  FROM msg
)"""

ORACLES = {
    "decode_scrape_messages": _with("SELECT message_id, decode_ok, venue FROM dec"),
    "decode_extract_messages": _with("SELECT message_id, decode_ok, venue, url FROM dec"),
    "envelope_decode": _with(
        f", {_ENVELOPE}\nSELECT message_id, receipt_handle, payload, "
        "CASE WHEN json_valid(payload) THEN coalesce(json_extract_string(payload, '$.venue'), '') END AS venue, "
        "CASE WHEN json_valid(payload) THEN coalesce(json_extract_string(payload, '$.url'), '') END AS url, "
        "CASE WHEN payload IS NULL THEN 'bad_base64' WHEN NOT json_valid(payload) THEN 'malformed' ELSE 'ok' END AS outcome FROM env"
    ),
    "message_routing": _with("SELECT message_id, venue, outcome FROM routed"),
    "messages_with_venue": _with(
        "SELECT d.message_id, d.venue, d.url, r.base_url FROM dec d JOIN registry r ON d.venue = r.venue WHERE d.decode_ok"
    ),
    "unknown_venues": _with(
        "SELECT message_id, venue FROM dec WHERE decode_ok AND venue NOT IN (SELECT venue FROM registry)"
    ),
    "required_fields": _with(
        "SELECT message_id, 'venue' AS field FROM dec WHERE decode_ok AND venue = '' "
        "UNION ALL SELECT message_id, 'url' AS field FROM dec WHERE decode_ok AND url = ''"
    ),
    "message_contract": _with(
        "SELECT message_id, missing_keys, extra_keys FROM ("
        "SELECT message_id, "
        "array_to_string(list_sort(list_filter(['venue', 'url'], lambda k: NOT list_contains(keys, k))), ',') AS missing_keys, "
        "array_to_string(list_sort(list_filter(keys, lambda k: k NOT IN ('venue', 'url'))), ',') AS extra_keys "
        "FROM (SELECT message_id, CASE WHEN json_valid(body) THEN json_keys(body) END AS keys FROM msg) WHERE keys IS NOT NULL) "
        "WHERE missing_keys <> '' OR extra_keys <> ''"
    ),
    "dead_letters": _with("SELECT message_id, outcome AS reason, body FROM routed WHERE outcome <> 'accepted'"),
    "run_metrics": _with("SELECT venue, outcome, count(*) AS n FROM routed GROUP BY venue, outcome"),
    "publish_outcome": _with(
        "SELECT run_id, n_published, CASE WHEN len(f) > 0 THEN 'partial failure' ELSE 'ok' END AS status, "
        "array_to_string(f, ',') AS failed FROM ("
        "SELECT strftime(ts, '%Y-%m-%d') AS run_id, count(*) AS n_published, "
        "coalesce(list_sort(list_distinct(list(sent_venue) FILTER (WHERE NOT decode_ok))), []) AS f FROM dec WHERE sent_venue IN (SELECT venue FROM registry) GROUP BY 1)"
    ),
}

ORACLES["pages_for_messages"] = P._with(
    "SELECT m.venue, m.url, p.page_id, CASE WHEN p.page_id IS NULL THEN 'not_fetched' ELSE 'fetched' END AS outcome "
    f"FROM (SELECT venue, url FROM new_urls UNION ALL SELECT {S.host('url')} AS venue, url FROM pages) m "
    "LEFT JOIN pages p ON m.url = p.url"
)
