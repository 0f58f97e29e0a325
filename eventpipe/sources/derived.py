"""

The driver's pages carry no embedded event JSON and no queue exists, so event
pages are written from ``part``, messages from ``events`` and listing events from
``orders`` x ``customer``. Every rule here is a column expression, so the
derived input grows with the table it comes from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext
from .tables import spread

# The derivation rules (mirrored in the oracle SQL).
FIRST_DAY = "2026-01-01"
OFFSETS = ("+01:00", "+02:00", "Z", "+00:00")
SUPPLIER_START = "2026-01-01T20:00:00+01:00"


def part_slug(p: DataFrame) -> Column:
    return F.concat(F.regexp_replace(F.lower(F.col("p_name")), "[^a-z0-9]+", "-"), F.lit("-"), F.col("p_partkey").cast("string"))


def part_object_key() -> Column:
    """Object key shared by part pairs ``2k, 2k+1``, so every key is put twice (conflicts)."""
    return F.concat(F.lit("event-"), F.floor(F.col("p_partkey") / 2).cast("string"))


def part_event_host() -> Column:
    return F.concat(F.regexp_replace(F.lower(F.col("p_brand")), "[^a-z0-9]+", ""), F.lit(".example.com"))


def part_event_url() -> Column:
    return F.concat(F.lit("https://"), part_event_host(), F.lit("/event/"), F.col("p_partkey").cast("string"))


def _date_text(hour_shift: int) -> Column:
    day = F.date_add(F.to_date(F.lit(FIRST_DAY)), (F.col("p_partkey") % 365).cast("int"))
    hour = (F.col("p_size") % 4) + 17 + hour_shift
    minute = (F.col("p_partkey") % 4) * 15
    frac = F.when(F.col("p_size") % 5 == 0, F.lit(".123")).otherwise(F.lit(""))
    offsets = F.array(*[F.lit(o) for o in OFFSETS])
    off = F.element_at(offsets, (F.col("p_size") % 4 + 1).cast("int"))
    return F.concat(
        day.cast("string"),
        F.lit("T"),
        F.lpad(hour.cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad(minute.cast("string"), 2, "0"),
        F.lit(":00"),
        frac,
        off,
    )


#: The columns that event pages are written from; together they tell parts of a repeated or null key apart.
PAGE_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"]


def part_event_data(part: DataFrame, keep: tuple = ()) -> DataFrame:
    """``p_partkey, url, title, slug, price, first_date, last_date`` for each part."""
    return part.select(
        "p_partkey",
        *keep,
        part_event_url().alias("url"),
        F.col("p_name").alias("title"),
        part_slug(part).alias("slug"),
        F.col("p_retailprice").cast("long").alias("price"),
        _date_text(0).alias("first_date"),
        _date_text(3).alias("last_date"),
    )


def part_event_pages(part: DataFrame) -> DataFrame:
    """Event pages ``page_id, url, html`` with the event JSON in a ``__NEXT_DATA__`` script.

    Each page also has an unrelated script before it, a commented-out copy and a
    link marked ``data-theme='secondary'``, so selection is exercised. A page is many times
    as long as its part, so the parts are dealt over tasks first.
    """
    d = part_event_data(spread(part, PAGE_COLUMNS))
    data = F.struct(
        F.col("title"), F.col("slug"), F.col("price"), F.col("first_date").alias("firstDate"), F.col("last_date").alias("lastDate")
    )
    payload = F.to_json(
        F.struct(F.struct(F.struct(data.alias("data")).alias("pageProps"), F.lit("/event/[slug]").alias("page")).alias("props"))
    )
    html = F.concat(
        F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'),
        F.col("title"),
        F.lit('</title><script>window.dataLayer=[];</script><!-- <script id="__NEXT_DATA__">{}</script> -->'),
        F.lit('<script id="__NEXT_DATA__" type="application/json">'),
        payload,
        F.lit('</script></head><body><a data-theme="secondary" href="/event/'),
        F.col("p_partkey").cast("string"),
        F.lit('">'),
        F.col("title"),
        F.lit("</a></body></html>"),
    )
    return d.select(F.col("p_partkey").alias("page_id"), "url", html.alias("html"))


def part_extract_messages(part: DataFrame) -> DataFrame:
    """Extract messages ``venue, url``, one per part; every 97th URL is one that the parser rejects."""
    tail = F.concat(part_event_host(), F.lit("/event/"), F.col("p_partkey").cast("string"))
    url = F.when(F.col("p_partkey") % 97 == 0, F.concat(F.lit("https://["), tail)).otherwise(F.concat(F.lit("https://"), tail))
    return part.select(part_event_host().alias("venue"), url.alias("url"))


def part_snapshots(part: DataFrame) -> DataFrame:
    """Two snapshots ``page_id, url, html, fetched_at`` per event page, the older of which says otherwise.

    In the newer, every 89th page has no script, every 83rd its JSON cut short, every
    79th an empty slug, and every 73rd lies at another URL.
    """
    new = part_event_pages(part)
    key, html = F.col("page_id"), F.col("html")
    spoiled = (
        F.when(key % 89 == 0, F.lit("<html><body>moved</body></html>"))
        .when(key % 83 == 0, F.replace(html, F.lit('"page":"/event/[slug]"}}'), F.lit("")))
        .when(key % 79 == 0, F.regexp_replace(html, '"slug":"[^"]*"', '"slug":""'))
        .otherwise(html)
    )
    new = new.withColumn("html", spoiled)
    old = new.withColumn("html", F.lit('<script id="__NEXT_DATA__">{"props":{"pageProps":{"data":{"title":"old","slug":"old"}}}}</script>'))
    both = old.withColumn("fetched_at", F.lit(1)).unionByName(new.withColumn("fetched_at", F.lit(2)))
    return both.withColumn("url", F.when(key % 73 == 0, F.concat(F.col("url"), F.lit("/moved"))).otherwise(F.col("url")))


def part_documents(part: DataFrame, keep: tuple = ()) -> DataFrame:
    """Store input: ``p_partkey, pathname (shared by a key pair), body, uploaded_at`` for each part."""
    from ..operators.extract import music_event

    d = part_event_data(part, keep=(part_object_key().alias("_key"), "p_size", *keep))
    ev = music_event(F.col("title"), F.col("first_date"), F.col("price"), F.col("url"), F.lit("DKK"))
    from ..functions.zones import ntz_text

    uploaded = F.concat(
        ntz_text(F.timestamp_add("MINUTE", F.col("p_partkey"), F.to_timestamp_ntz(F.lit("2024-04-05 19:12:36")))),
        F.lit(".679Z"),
    )
    return d.select(
        "p_partkey",
        F.concat(F.col("_key"), F.lit(".json")).alias("pathname"),
        jsontext.encode(ev).alias("body"),
        F.when(F.col("p_size") % 17 == 0, F.lit("not-a-time")).otherwise(uploaded).alias("uploaded_at"),
        *keep,
    )


def supplier_documents(supplier: DataFrame) -> DataFrame:
    """What the store holds before the parts are put: one document per supplier.

    Its key is that of part pair ``20 * s_suppkey``, so about half of the keys are
    also put by parts.
    """
    from ..operators.extract import music_event

    url = F.concat(F.lit("https://supplier.example.com/"), F.col("s_suppkey").cast("string"))
    ev = music_event(F.col("s_name"), F.lit(SUPPLIER_START), F.col("s_acctbal").cast("long"), url, F.lit("DKK"))
    return supplier.select(
        F.concat(F.lit("event-"), (F.col("s_suppkey") * 20).cast("string"), F.lit(".json")).alias("pathname"),
        jsontext.encode(ev).alias("body"),
        F.lit("2024-04-05T19:12:36.679Z").alias("uploaded_at"),
    )


def event_messages(events: DataFrame) -> DataFrame:
    """Queue messages from ``events``: ``message_id, event_id, ts, sent_venue, body``.

    venue = ``event_type``; the URL carries the user and ``props.k``. Every 97th
    body is cut short (malformed), every 89th uses the key ``name`` in place of
    ``venue`` (the key-drift bug the reference's contract test guards), every
    83rd has an empty URL, every 79th a URL the parser rejects (unclosed ``[``).
    """
    venue = F.col("event_type")
    url = F.concat(
        F.lit("https://"), venue, F.lit(".example.com/e/"), F.col("user_id").cast("string"), F.lit("?k="),
        F.coalesce(F.get_json_object(F.col("props"), "$.k"), F.lit("")),
    )
    good = F.concat(F.lit('{"venue":"'), venue, F.lit('","url":"'), url, F.lit('"}'))
    body = (
        F.when(F.col("event_id") % 97 == 0, F.substring(good, 1, 17))
        .when(F.col("event_id") % 89 == 0, F.concat(F.lit('{"name":"'), venue, F.lit('","url":"'), url, F.lit('"}')))
        .when(F.col("event_id") % 83 == 0, F.concat(F.lit('{"venue":"'), venue, F.lit('","url":""}')))
        .when(F.col("event_id") % 79 == 0, F.concat(F.lit('{"venue":"'), venue, F.lit('","url":"https://['), venue, F.lit('.example.com/e/"}')))
        .otherwise(good)
    )
    return events.select(
        F.concat(F.lit("m-"), F.col("event_id").cast("string")).alias("message_id"),
        "event_id",
        "ts",
        venue.alias("sent_venue"),
        body.alias("body"),
    )


def event_envelopes(events: DataFrame) -> DataFrame:
    """Delivered envelopes, one JSON line per message, body in base64 (every 101st corrupted)."""
    from ..functions.codec import b64encode

    m = event_messages(events)
    b64 = F.when(F.col("event_id") % 101 == 0, F.concat(F.lit("!!"), b64encode(F.col("body")))).otherwise(b64encode(F.col("body")))
    line = F.to_json(
        F.struct(
            F.col("message_id").alias("messageId"),
            F.concat(F.lit("lease-"), F.col("event_id").cast("string")).alias("receiptHandle"),
            b64.alias("body"),
        )
    )
    return m.select("event_id", "ts", "sent_venue", line.alias("line"))


AVAILABILITY = {"O": "https://schema.org/InStock", "F": "https://schema.org/SoldOut", "P": "https://schema.org/PreOrder"}
CATALOGUE_ZONE = "Europe/Copenhagen"


def order_events(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Nested listing events (the page's event shape) from ``orders`` x ``customer``.

    category = ``lower(c_mktsegment)``; availability from ``o_orderstatus``; the
    price is text, as on the page; start 20:00 Copenhagen time on the order date.
    The join is left to the planner: ``customer`` grows with the data, so it is
    not forced to broadcast (AQE broadcasts it at run time when it is small).
    """
    from ..functions.zones import with_rfc3339_local

    j = orders.join(customer, orders.o_custkey == customer.c_custkey)
    j = j.withColumn("_start", F.timestamp_add("HOUR", F.lit(20), F.col("o_orderdate")))
    j = j.withColumn("_end", F.timestamp_add("HOUR", F.lit(3), F.col("_start")))
    j = j.withColumn("_door", F.timestamp_add("HOUR", F.lit(-1), F.col("_start")))
    for local, out in (("_start", "startDate"), ("_end", "endDate"), ("_door", "doorTime")):
        j = with_rfc3339_local(j, local, out, CATALOGUE_ZONE)
    avail = F.coalesce(
        *[F.when(F.col("o_orderstatus") == k, F.lit(v)) for k, v in AVAILABILITY.items()], F.lit("")
    )
    nation = F.col("c_nationkey").cast("string")
    key = F.col("o_orderkey").cast("string")
    return j.select(
        F.concat(F.lit("EVENT "), key).alias("name"),
        F.col("o_orderpriority").alias("description"),
        F.concat(F.lit("https://images.example.com/"), key, F.lit(".jpg")).alias("image"),
        "startDate",
        "endDate",
        "doorTime",
        F.struct(
            F.concat(F.lit("Hall "), nation).alias("name"),
            F.struct(
                F.concat(F.lit("Street "), F.col("c_custkey").cast("string")).alias("streetAddress"),
                F.concat(F.lit("City "), nation).alias("addressLocality"),
                F.lpad(nation, 4, "0").alias("postalCode"),
                F.lit("DK").alias("addressCountry"),
            ).alias("address"),
            F.concat(F.lit("https://hall"), nation, F.lit(".example.com")).alias("sameAs"),
        ).alias("location"),
        F.lower(F.col("c_mktsegment")).alias("venueType"),
        F.struct(F.col("c_name").alias("name"), F.concat(F.lit("https://artists.example.com/"), F.col("c_custkey").cast("string")).alias("sameAs")).alias("performer"),
        F.struct(
            F.format_string("%.2f", F.col("o_totalprice")).alias("price"),
            F.lit("DKK").alias("priceCurrency"),
            avail.alias("availability"),
            F.concat(F.lit("https://tickets.example.com/"), key).alias("url"),
        ).alias("offers"),
        F.struct(F.concat(F.lit("Promoter "), nation).alias("name"), F.concat(F.lit("https://promoter"), nation, F.lit(".example.com")).alias("url")).alias("organizer"),
    )


def event_message_url(events: DataFrame) -> Column:
    """The URL an event's message points at (as in ``event_messages``)."""
    return F.concat(
        F.lit("https://"), F.col("event_type"), F.lit(".example.com/e/"), F.col("user_id").cast("string"), F.lit("?k="),
        F.coalesce(F.get_json_object(F.col("props"), "$.k"), F.lit("")),
    )
