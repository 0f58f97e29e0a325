"""Listing queries over nested events written from ``orders`` x ``customer``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import listing as L
from ..session import state_path
from ..sources import derived, feeds
from ..sources.tables import table
from . import params


def _catalogue(spark, sf):
    """The nested events in the listing page's shape (price kept as text).

    Built directly in that schema; files of it are read by ``feeds.read_catalogue``.
    """
    return derived.order_events(table(spark, sf, "orders"), table(spark, sf, "customer"))


def event_catalogue(spark, sf):
    """The catalogue written as JSON arrays, the page's own form, and read back with its event schema."""
    folder = state_path(spark, "catalogue")
    feeds.write_catalogue(_catalogue(spark, sf), folder)
    c = feeds.read_catalogue(spark, folder, L.UI_EVENT_SCHEMA, multiline=False)
    return c.select(
        "name", F.col("startDate").alias("start_date"), F.col("venueType").alias("venue_type"),
        F.col("location.name").alias("location_name"), F.col("location.address.addressLocality").alias("locality"),
        F.col("performer.name").alias("performer_name"), F.col("offers.price").alias("price"),
        F.col("offers.price").try_cast("double").alias("price_value"), F.col("offers.availability").alias("availability"),
        F.col("organizer.name").alias("organizer_name"),
    )


def filter_category(spark, sf):
    return L.filter_category(_catalogue(spark, sf), params.CATEGORY).select("name", F.col("venueType").alias("venue_type"))


def availability_status(spark, sf):
    return L.with_availability(_catalogue(spark, sf)).select("name", F.col("offers.availability").alias("availability"), "status", "status_text")


def event_listing(spark, sf):
    return L.listing_rows(_catalogue(spark, sf))


def date_display(spark, sf):
    return L.with_display_date(_catalogue(spark, sf)).select("name", F.col("startDate").alias("start_date"), "date_text")


def price_display(spark, sf):
    return L.with_display_price(_catalogue(spark, sf)).select("name", F.col("offers.price").alias("price"), "price_text")


FEED_SCHEMA = "name string, venue_type string, price string, start_date string"


def read_feed(spark, sf):
    """The catalogue written as JSON, XML and CSV feed files, each read back with the feed schema."""
    c = _catalogue(spark, sf).select(
        "name", F.col("venueType").alias("venue_type"), F.col("offers.price").alias("price"), F.col("startDate").alias("start_date")
    )
    base = state_path(spark, "feeds")
    parts = []
    for fmt in feeds.FORMATS:
        folder = f"{base}/{fmt}"
        feeds.write_feed(c, folder, fmt, row_tag="event")
        parts.append(feeds.read_feed(spark, folder, fmt, FEED_SCHEMA, row_tag="event").withColumn("format", F.lit(fmt)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("format", "name", "venue_type", "price", "start_date")


QUERIES = {
    "event_catalogue": event_catalogue,
    "filter_category": filter_category,
    "availability_status": availability_status,
    "event_listing": event_listing,
    "date_display": date_display,
    "price_display": price_display,
    "read_feed": read_feed,
}

# ---------------------------------------------------------------- oracle SQL (DuckDB)


def _rfc(local: str) -> str:
    utc = f"timezone('UTC', timezone('Europe/Copenhagen', {local}))"
    mins = f"CAST(date_diff('minute', {utc}, {local}) AS INTEGER)"
    off = (
        f"CASE WHEN {mins} = 0 THEN 'Z' ELSE concat(CASE WHEN {mins} < 0 THEN '-' ELSE '+' END, "
        f"lpad(CAST(abs({mins}) // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(abs({mins}) % 60 AS VARCHAR), 2, '0')) END"
    )
    return f"concat(strftime({local}, '%Y-%m-%dT%H:%M:%S'), {off})"


_MONTHS = "['jan.', 'feb.', 'mar.', 'apr.', 'maj', 'jun.', 'jul.', 'aug.', 'sep.', 'okt.', 'nov.', 'dec.']"

CATALOGUE_CTE = f"""ev AS (
  SELECT 'EVENT ' || CAST(o_orderkey AS VARCHAR) AS name, o_orderdate + INTERVAL 20 HOUR AS local_start,
         lower(c_mktsegment) AS venue_type, o_orderpriority AS description, 'Hall ' || CAST(c_nationkey AS VARCHAR) AS location_name,
         'City ' || CAST(c_nationkey AS VARCHAR) AS locality, c_name AS performer_name,
         printf('%.2f', o_totalprice) AS price,
         CASE o_orderstatus WHEN 'O' THEN 'https://schema.org/InStock' WHEN 'F' THEN 'https://schema.org/SoldOut'
              WHEN 'P' THEN 'https://schema.org/PreOrder' ELSE '' END AS availability,
         'https://tickets.example.com/' || CAST(o_orderkey AS VARCHAR) AS ticket_url,
         'Promoter ' || CAST(c_nationkey AS VARCHAR) AS organizer_name
  FROM orders JOIN customer ON o_custkey = c_custkey
),
cat AS (
  SELECT *, {_rfc('local_start')} AS start_date,
         CASE WHEN availability = 'https://schema.org/SoldOut' THEN 'sold-out' ELSE 'available' END AS status
  FROM ev
),
shown AS (
  SELECT *, concat(CAST(day(local_start) AS VARCHAR), '. ', {_MONTHS}[month(local_start)], ' ', CAST(year(local_start) AS VARCHAR),
                   ' kl. ', lpad(CAST(hour(local_start) AS VARCHAR), 2, '0'), '.', lpad(CAST(minute(local_start) AS VARCHAR), 2, '0')) AS date_text,
         concat(translate(format('{{:,.2f}}', CAST(price AS DOUBLE)), ',.', '.,'), chr(160), 'kr.') AS price_text
  FROM cat
)"""


def _with(body: str) -> str:
    return f"WITH {CATALOGUE_CTE}\n{body}"


ORACLES = {
    "event_catalogue": _with(
        "SELECT name, start_date, venue_type, location_name, locality, performer_name, price, CAST(price AS DOUBLE) AS price_value, "
        "availability, organizer_name FROM cat"
    ),
    "filter_category": _with(f"SELECT name, venue_type FROM cat WHERE venue_type = '{params.CATEGORY}'"),
    "availability_status": _with(
        "SELECT name, availability, status, CASE WHEN status = 'available' THEN 'TICKETS AVAILABLE' ELSE 'SOLD OUT' END AS status_text FROM cat"
    ),
    "event_listing": _with(
        "SELECT name AS title, description, date_text, location_name || ' - ' || locality AS venue_line, performer_name AS performer, price_text, status, "
        "CASE WHEN status = 'available' THEN 'TICKETS AVAILABLE' ELSE 'SOLD OUT' END AS status_text, ticket_url, organizer_name AS organizer FROM shown"
    ),
    "date_display": _with("SELECT name, start_date, date_text FROM shown"),
    "price_display": _with("SELECT name, price, price_text FROM shown"),
    "read_feed": _with(
        "SELECT f.format, name, venue_type, price, start_date FROM cat CROSS JOIN (VALUES ('json'), ('xml'), ('csv')) f(format)"
    ),
}
