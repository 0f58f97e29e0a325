"""Listing: category, availability, prices and dates (FIXTURES.md §3, listing)."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from eventpipe.functions import dates as D
from eventpipe.functions.money import danish_price
from eventpipe.operators import listing as L
from eventpipe.sources import feeds

EVENTS = [
    {"name": "ROCK", "startDate": "2026-10-15T20:00:00+02:00", "venueType": "vega",
     "location": {"name": "VEGA", "address": {"addressLocality": "Kbh V"}}, "performer": {"name": "Band"},
     "offers": {"price": "350", "priceCurrency": "DKK", "availability": "https://schema.org/InStock", "url": "t1"},
     "organizer": {"name": "Org"}},
    {"name": "JAZZ", "startDate": "2026-10-25T02:30:00+01:00", "venueType": "jazz",
     "location": {"name": "Montmartre", "address": {"addressLocality": "Kbh K"}}, "performer": {"name": "Trio"},
     "offers": {"price": "1234.5", "priceCurrency": "DKK", "availability": "https://schema.org/SoldOut", "url": "t2"},
     "organizer": {"name": "Jazz"}},
    {"name": "FREE", "startDate": "2026-03-29T00:30:00Z", "venueType": "other",
     "location": {"name": "Park", "address": {"addressLocality": "Kbh"}}, "performer": {"name": "DJ"},
     "offers": {"price": "0", "priceCurrency": "DKK", "availability": "https://schema.org/PreOrder", "url": "t3"},
     "organizer": {"name": "City"}},
    {"name": "NULLS", "startDate": "2026-03-29T01:30:00Z", "venueType": "drkon",
     "location": {"name": "DR", "address": {"addressLocality": "Kbh S"}}, "performer": {"name": "Orchestra"},
     "offers": {"price": "n/a", "priceCurrency": "DKK", "availability": None, "url": "t4"},
     "organizer": {"name": "DR"}},
]


@pytest.fixture(scope="module")
def catalogue(spark):
    folder = tempfile.mkdtemp(prefix="catalogue-")
    with open(os.path.join(folder, "events.json"), "w") as f:
        json.dump(EVENTS, f)
    return feeds.read_catalogue(spark, folder, L.UI_EVENT_SCHEMA)


def test_catalogue_reads_nested_array(catalogue):
    assert catalogue.count() == 4
    assert catalogue.where(F.col("location.address.addressLocality") == "Kbh V").count() == 1


def test_filter_category(catalogue):
    assert L.filter_category(catalogue, "all").count() == 4
    assert [r.name for r in L.filter_category(catalogue, "jazz").collect()] == ["JAZZ"]
    assert L.filter_category(catalogue, "unknown").count() == 0


def test_listing_rows(catalogue):
    rows = {r.title: r for r in L.listing_rows(catalogue).collect()}
    assert rows["ROCK"].status == "available" and rows["ROCK"].status_text == "TICKETS AVAILABLE"
    assert rows["JAZZ"].status == "sold-out" and rows["JAZZ"].status_text == "SOLD OUT"
    assert rows["FREE"].status == "available" and rows["NULLS"].status == "available"
    assert rows["ROCK"].price_text == "350,00 kr."
    assert rows["JAZZ"].price_text == "1.234,50 kr."
    assert rows["FREE"].price_text == "0,00 kr."
    assert rows["NULLS"].price_text is None
    assert rows["ROCK"].venue_line == "VEGA - Kbh V"
    assert rows["ROCK"].date_text == "15. okt. 2026 kl. 20.00"
    # both sides of the summer-time switch (2026-03-29 01:00 UTC)
    assert rows["FREE"].date_text == "29. mar. 2026 kl. 01.30"
    assert rows["NULLS"].date_text == "29. mar. 2026 kl. 03.30"
    # winter time again after 2026-10-25 01:00 UTC
    assert rows["JAZZ"].date_text == "25. okt. 2026 kl. 02.30"


def test_price_other_currency(spark):
    df = spark.createDataFrame([(12.5, "EUR")], "p double, c string")
    assert df.select(danish_price(F.col("p"), F.col("c")).alias("t")).first().t == "12,50 EUR"


@pytest.mark.parametrize("fmt", ["json", "xml", "csv"])
def test_read_feed_files(spark, fmt):
    folder = tempfile.mkdtemp(prefix=f"feed-{fmt}-")
    src = spark.createDataFrame([("A", "vega", "350"), ("B, the band", "jazz", "200")], "name string, venue_type string, price string")
    w = src.coalesce(1).write.mode("overwrite")
    if fmt == "json":
        w.json(folder)
    elif fmt == "xml":
        w.option("rowTag", "event").xml(folder)
    else:
        w.option("header", True).csv(folder)
    got = feeds.read_feed(spark, folder, fmt, "name string, venue_type string, price string", row_tag="event")
    assert sorted(tuple(r) for r in got.collect()) == [("A", "vega", "350", None), ("B, the band", "jazz", "200", None)]


def test_feed_keeps_the_text_of_bad_records_and_quotes(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"name":"A"}\n{"name": broken\n')
    got = feeds.read_feed(spark, str(tmp_path), "json", "name string")
    assert sorted((r.name or "", r["_corrupt_record"] or "") for r in got.collect()) == [("", '{"name": broken'), ("A", "")]
    folder = str(tmp_path / "csv")
    feeds.write_feed(spark.createDataFrame([('say "hi", all', "x")], "name string, kind string"), folder, "csv")
    assert feeds.read_feed(spark, folder, "csv", "name string, kind string").first()[:2] == ('say "hi", all', "x")


def test_catalogue_of_array_lines(spark, tmp_path):
    folder = str(tmp_path / "catalogue")
    feeds.write_catalogue(spark.range(25).selectExpr("cast(id as string) as name").coalesce(2), folder, per_line=4)
    lines = [r.value for r in spark.read.text(folder).collect()]
    assert all(x.startswith("[{") for x in lines) and len(lines) >= 7
    got = feeds.read_catalogue(spark, folder, "name string", multiline=False)
    assert sorted(int(r.name) for r in got.collect()) == list(range(25))
