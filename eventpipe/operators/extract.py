"""Extract stage: embedded JSON (P2), strict decode (P6), MusicEvent (P7), start date (P8),
document (P9) and object key (P10).

One narrow pass per page: the script text is found by native regex, validated by
the strict decoder (Arrow batches), projected by native ``from_json`` and
``struct``. Per-message outcomes name every way a message can end
(``bad_url, not_fetched, no_script, bad_json, empty_slug``; the store adds
``exists, stored``). Only ``bad_url`` is an error the reference retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import html as H
from ..functions import jsontext
from ..functions import urls as U
from ..functions.strict_json import strict_decode, strict_decode_by
from ..specs import ScriptSpec, VenueSpec

# The shape of the page JSON the reference reads, and the constants
# of the MusicEvent it writes.
NEXT_DATA_SPEC = {
    "props": {"pageProps": {"data": {"title": "string", "slug": "string", "price": "int", "firstDate": "time", "lastDate": "time"}}}
}
SCHEMA_CONTEXT = "https://schema.org"
EVENT_TYPE = "MusicEvent"
PERFORMER_TYPE = "MusicGroup"
OFFER_TYPE = "Offer"
DOCUMENT_SUFFIX = ".json"


def embedded_json(pages: DataFrame, spec: ScriptSpec = ScriptSpec(), url_col: str = "url") -> DataFrame:
    """One row per matching script (``pos`` from 1), and one row with null text for a page with none."""
    texts = H.select_text(F.col("html"), spec.tag, spec.attr, spec.value)
    return pages.select(
        F.col(url_col).alias("url"), F.posexplode_outer(texts).alias("pos0", "json_text")
    ).select("url", (F.col("pos0") + 1).cast("long").alias("pos"), "json_text")


def decode_event_data(df: DataFrame, text_col: str = "json_text") -> DataFrame:
    """Adds ``json_ok, json_error, title, slug, price, first_date, last_date`` (zero-filled like the reference)."""
    d = F.col("_d")
    ok = d["ok"]
    return (
        df.withColumn("_d", strict_decode(F.col(text_col), NEXT_DATA_SPEC))
        .withColumn("json_ok", ok)
        .withColumn("json_error", d["reason"])
        .withColumn("title", F.when(ok, F.coalesce(d["title"], F.lit(""))))
        .withColumn("slug", F.when(ok, F.coalesce(d["slug"], F.lit(""))))
        .withColumn("price", F.when(ok, F.coalesce(d["price"], F.lit(0).cast("long"))))
        .withColumn("first_date", d["firstDate"])
        .withColumn("last_date", d["lastDate"])
        .drop("_d")
    )


EVENT_KINDS = {"title": "string", "slug": "string", "price": "int", "firstDate": "time", "lastDate": "time"}


def extract_by_spec(
    messages: DataFrame, pages: DataFrame, specs: list[VenueSpec], snapshot_order: str | None = None, one_each: bool = False, partitions: int | None = None,
) -> DataFrame:
    """The extract stage for all venues in one scan: each message by its venue's script selector, JSON path, field map and currency.

    Rows are as by ``extract_events``; a message whose venue has no spec, or one without a
    script, ends as ``unknown_venue``. The specs are compiled to column expressions: a text
    is selected once by its venue's selector and decoded once by its venue's shape.
    """
    known = [s for s in specs if s.script is not None]
    which, texts, currency = F.lit(None).cast("int"), F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    for i, s in enumerate(known):
        which = F.when(F.col("venue") == s.name, F.lit(i)).otherwise(which)
    for script in dict.fromkeys(s.script for s in known):
        own = [i for i, s in enumerate(known) if s.script == script]
        texts = F.when(F.col("_which").isin(own), H.select_text(F.col("html"), script.tag, script.attr, script.value)).otherwise(texts)
    for i, s in enumerate(known):
        currency = F.when(F.col("_which") == i, F.lit(s.currency)).otherwise(currency)
    page = _page_side(pages if one_each else newest_snapshot(pages, snapshot_order, partitions))
    found = messages.withColumn("_which", which).join(page, F.col("url") == F.col("_purl"), "left").withColumn("_fetched", F.col("_purl").isNotNull())
    rows = found.select(*messages.columns, "_which", "_fetched", F.posexplode_outer(F.when(F.col("_fetched"), texts)).alias("pos0", "json_text"))
    shapes = [(s.data.path, dict(s.data.fields)) for s in known] or [((), {})]
    d = F.col("_d")
    rows = rows.withColumn("_d", strict_decode_by(F.col("json_text"), F.coalesce("_which", F.lit(0)), shapes, EVENT_KINDS)).select(
        *messages.columns, "_which", "_fetched", (F.col("pos0") + 1).cast("long").alias("script_pos"), "json_text", d["ok"].alias("json_ok"), d["reason"].alias("json_error"),
        F.when(d["ok"], F.coalesce(d["title"], F.lit(""))).alias("title"), F.when(d["ok"], F.coalesce(d["slug"], F.lit(""))).alias("slug"),
        F.when(d["ok"], F.coalesce(d["price"], F.lit(0).cast("long"))).alias("price"), d["firstDate"].alias("first_date"), d["lastDate"].alias("last_date"),
    )
    outcome = (
        F.when(F.col("_which").isNull(), F.lit("unknown_venue"))
        .when(~U.parsable(F.col("url")), F.lit("bad_url"))
        .when(~F.col("_fetched"), F.lit("not_fetched"))
        .when(F.col("json_text").isNull(), F.lit("no_script"))
        .when(~F.col("json_ok"), F.lit("bad_json"))
        .when(F.col("slug") == "", F.lit("empty_slug"))
        .otherwise(F.lit("extracted"))
    )
    rows = rows.withColumn("outcome", outcome).withColumn("_currency", currency)
    return with_document(with_music_event(rows, currency=F.col("_currency"))).drop("_fetched", "_which", "_currency")


def music_event(title: Column, first_date: Column, price: Column, url: Column, currency: Column) -> Column:
    """The MusicEvent struct, field order and empty strings as the reference writes them."""
    empty = F.lit("")
    address = F.struct(
        empty.alias("@type"),
        empty.alias("streetAddress"),
        empty.alias("addressLocality"),
        empty.alias("postalCode"),
        empty.alias("addressCountry"),
    )
    return F.struct(
        F.lit(SCHEMA_CONTEXT).alias("@context"),
        F.lit(EVENT_TYPE).alias("@type"),
        title.alias("name"),
        D.rfc3339_seconds(first_date).alias("startDate"),
        F.struct(empty.alias("@type"), empty.alias("name"), address.alias("address")).alias("location"),
        F.struct(F.lit(PERFORMER_TYPE).alias("@type"), title.alias("name")).alias("performer"),
        F.struct(
            F.lit(OFFER_TYPE).alias("@type"),
            url.alias("url"),
            price.alias("price"),
            currency.alias("priceCurrency"),
        ).alias("offers"),
    )


def with_music_event(decoded: DataFrame, url_col: str = "url", currency: str | Column = "DKK") -> DataFrame:
    cur = currency if isinstance(currency, Column) else F.lit(currency)
    ev = music_event(F.col("title"), F.col("first_date"), F.col("price"), F.col(url_col), cur)
    return decoded.withColumn("event", ev)


def flat_event(df: DataFrame) -> DataFrame:
    """The MusicEvent as flat columns (for listing and comparison)."""
    e = "event"
    return df.select(
        F.col(f"{e}.`@context`").alias("context"),
        F.col(f"{e}.`@type`").alias("type"),
        F.col(f"{e}.name").alias("name"),
        F.col(f"{e}.startDate").alias("start_date"),
        F.col(f"{e}.performer.`@type`").alias("performer_type"),
        F.col(f"{e}.performer.name").alias("performer_name"),
        F.col(f"{e}.offers.`@type`").alias("offer_type"),
        F.col(f"{e}.offers.url").alias("offer_url"),
        F.col(f"{e}.offers.price").alias("price"),
        F.col(f"{e}.offers.priceCurrency").alias("price_currency"),
    )


def with_document(df: DataFrame) -> DataFrame:
    """``pathname = slug + '.json'`` and ``body`` = the serialised MusicEvent."""
    return df.withColumn("pathname", F.concat(F.col("slug"), F.lit(DOCUMENT_SUFFIX))).withColumn(
        "body", jsontext.encode(F.col("event"))
    )


def newest_snapshot(pages: DataFrame, order: str | None = None, partitions: int | None = None) -> DataFrame:
    """``url, html`` of each URL's newest snapshot: the greatest ``order`` column, then ``page_id``, then text.

    A partial aggregate, so a URL saved a million times is one row per map task. A task sorts and joins the
    text of its partition: with ``partitions`` (``tables.text_partitions``, from the measured text) there are that many of the URL,
    whatever the session's shuffles have. The snapshots are then dealt by URL and the task that made them first, which
    stands for the partial aggregate. Without it, pages that lie bucketed on ``url`` are not shuffled.
    """
    by = [c for c in (order, "page_id") if c and c in pages.columns]
    if not partitions:
        return pages.groupBy("url").agg(F.max_by("html", F.struct(*by, F.xxhash64("html"))).alias("html"))
    row = F.struct(*by, F.xxhash64("html").alias("_hash"), "html").alias("_row")
    newest = F.max("_row").alias("_row")
    made = pages.select("url", row, F.spark_partition_id().alias("_task"))
    local = made.repartition(partitions, "url", "_task").groupBy("url", "_task").agg(newest)
    return local.repartition(partitions, "url").groupBy("url").agg(newest).select("url", F.col("_row.html").alias("html"))


def _page_side(newest: DataFrame) -> DataFrame:
    """The pages as a join's side. The hint keeps a planner that goes by file sizes from broadcasting them: text compresses well,
    and pages written from short rows have no size of their own, so a gigabyte of HTML can pass for a few megabytes."""
    return newest.select(F.col("url").alias("_purl"), "html").hint("merge")


def extract_events(
    messages: DataFrame, pages: DataFrame, spec: ScriptSpec = ScriptSpec(), keep_empty: bool = False, currency: str = "DKK",
    snapshot_order: str | None = None, one_each: bool = False, partitions: int | None = None,
) -> DataFrame:
    """Messages ``venue, url`` -> one row per message and script of the newest snapshot, with ``outcome``.

    Pages are joined on ``url`` (left: a missing page is ``not_fetched``). The
    join is a shuffle on the URL, never on the host, so a large venue does not
    skew it, and it is never a broadcast of the pages (``_page_side``). With
    ``one_each`` the pages are known to hold one snapshot of a URL: nothing is grouped,
    and a table bucketed on ``url`` is not shuffled. ``partitions`` is as in ``newest_snapshot``.
    """
    m = messages.alias("m")
    newest = pages if one_each else newest_snapshot(pages, snapshot_order, partitions)
    joined = m.join(_page_side(newest), F.col("m.url") == F.col("_purl"), "left")
    found = joined.withColumn("_fetched", F.col("_purl").isNotNull())
    texts = H.select_text(F.col("html"), spec.tag, spec.attr, spec.value)
    exploded = found.select(
        "m.*", "_fetched", F.posexplode_outer(F.when(F.col("_fetched"), texts)).alias("pos0", "json_text")
    )
    decoded = decode_event_data(exploded.withColumn("script_pos", (F.col("pos0") + 1).cast("long")).drop("pos0"))
    outcome = (
        F.when(~U.parsable(F.col("url")), F.lit("bad_url"))
        .when(~F.col("_fetched"), F.lit("not_fetched"))
        .when(F.col("json_text").isNull(), F.lit("no_script"))
        .when(~F.col("json_ok"), F.lit("bad_json"))
        .when((F.col("slug") == "") & F.lit(not keep_empty), F.lit("empty_slug"))
        .otherwise(F.lit("extracted"))
    )
    return with_document(with_music_event(decoded.withColumn("outcome", outcome), currency=currency)).drop("_fetched")


def extract_errors(extracted: DataFrame) -> DataFrame:
    """Error rows (``stage, url, reason``) of messages that gave no document."""
    return extracted.where(F.col("outcome") != "extracted").select(F.lit("extract").alias("stage"), "url", F.col("outcome").alias("reason"))
