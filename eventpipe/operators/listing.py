"""Listing of stored or catalogued events (P15-P17): category filter, availability,
display date and price. Narrow column expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.money import danish_price

# Availability URIs and the labels the listing page shows.
IN_STOCK = "https://schema.org/InStock"
SOLD_OUT = "https://schema.org/SoldOut"
STATUS_TEXT = {"available": "TICKETS AVAILABLE", "sold-out": "SOLD OUT"}

UI_EVENT_SCHEMA = (
    "name string, description string, image string, startDate string, endDate string, doorTime string, "
    "location struct<name: string, address: struct<streetAddress: string, addressLocality: string, postalCode: string, addressCountry: string>, sameAs: string>, "
    "venueType string, performer struct<name: string, sameAs: string>, "
    "offers struct<price: string, priceCurrency: string, availability: string, url: string>, "
    "organizer struct<name: string, url: string>"
)


def filter_category(events: DataFrame, category: str) -> DataFrame:
    """``all`` passes everything; any other value keeps that ``venueType``."""
    if category == "all":
        return events
    return events.where(F.col("venueType") == F.lit(category))


def with_availability(events: DataFrame) -> DataFrame:
    """``InStock`` -> available, ``SoldOut`` -> sold-out, anything else (null too) -> available."""
    a = F.col("offers.availability")
    status = F.when(a == IN_STOCK, F.lit("available")).when(a == SOLD_OUT, F.lit("sold-out")).otherwise(F.lit("available"))
    text = F.when(status == "available", F.lit(STATUS_TEXT["available"])).otherwise(F.lit(STATUS_TEXT["sold-out"]))
    return events.withColumn("status", status).withColumn("status_text", text)


def with_display_date(events: DataFrame, col: str = "startDate", zone: str = D.DISPLAY_ZONE) -> DataFrame:
    """Danish date text of the instant, on the wall clock of ``zone``."""
    epoch = D.epoch_seconds(F.col(col))
    return events.withColumn("date_text", D.danish_display(D.local_wall_clock(epoch, zone)))


def with_display_price(events: DataFrame) -> DataFrame:
    """Price text; the catalogue's price is text, so it is cast on read (bad text gives null)."""
    amount = F.col("offers.price").try_cast("double")
    return events.withColumn("price_value", amount).withColumn(
        "price_text", danish_price(amount, F.col("offers.priceCurrency"))
    )


def listing_rows(events: DataFrame) -> DataFrame:
    """One flat row per event card: date, title, venue and locality, performer, price, status, organizer."""
    e = with_display_price(with_display_date(with_availability(events)))
    return e.select(
        F.col("name").alias("title"),
        "description",
        "date_text",
        F.concat_ws(" - ", F.col("location.name"), F.col("location.address.addressLocality")).alias("venue_line"),
        F.col("performer.name").alias("performer"),
        "price_text",
        "status",
        "status_text",
        F.col("offers.url").alias("ticket_url"),
        F.col("organizer.name").alias("organizer"),
    )
