"""One error channel (U3), the message contract with its registry (P13) and venues of several JSON shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import jobs
from ..functions.zones import day_text
from ..operators import extract as X
from ..operators import links
from ..operators import routing as R
from ..operators import store as ST
from ..sources import derived
from ..sources.tables import pages as read_pages
from ..sources.tables import spread, table, text_partitions
from ..specs import JsonSpec, ScriptSpec, VenueSpec
from . import extraction, messages
from . import pages as P
from . import store as store_plans


def run_errors(spark, sf):
    """Error rows of every stage in one table: links, messages, publishes, extracts, list responses (every second is cut) and puts."""
    part = table(spark, sf, "part")
    resolved = links.resolve_links(links.extract_links(read_pages(spark, sf)))
    decoded = messages._decoded(spark, sf)
    attempts = decoded.select(day_text(F.col("ts")).alias("run_id"), F.col("sent_venue").alias("venue"), (~F.col("decode_ok")).alias("failed"))
    snapshots = derived.part_snapshots(part)
    partitions = text_partitions(snapshots, "html")
    extracted = X.extract_events(derived.part_extract_messages(part), snapshots, snapshot_order="fetched_at", partitions=partitions)
    responses = store_plans._responses(spark, sf).withColumn("first", F.regexp_extract("response", '"pathname":"([^"]*)"', 1))
    cut = F.col("first").rlike("50\\.json$")
    responses = responses.withColumn("response", F.when(cut, F.substring("response", 1, 40)).otherwise(F.col("response")))
    parts = [
        links.link_errors(resolved).select("stage", "url", "reason"),
        R.message_errors(R.route(decoded, messages.message_registry(spark))),
        R.publish_errors(attempts, "run_id", "venue", "failed"),
        X.extract_errors(extracted),
        ST.listing_errors(responses, "first"),
        ST.put_errors(store_plans.put_rejected(spark, sf)),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def contract_violations(spark, sf):
    """Key drift and venues that the registry lacks, in one table."""
    return R.contract_violations(messages._messages(spark, sf), messages.message_registry(spark))


#: Three venues whose pages carry the event under other keys, in other scripts.
SHAPES = (
    VenueSpec("shape-0", "https://shape-0.example.com", script=ScriptSpec()),
    VenueSpec(
        "shape-1", "https://shape-1.example.com", script=ScriptSpec(value="event-data"), currency="SEK",
        data=JsonSpec(("event",), (("title", "name"), ("slug", "id"), ("price", "cost"), ("firstDate", "starts"), ("lastDate", "ends"))),
    ),
    VenueSpec(
        "shape-2", "https://shape-2.example.com", script=ScriptSpec(attr="type", value="application/ld+json"), currency="EUR",
        data=JsonSpec(("state", "show"), (("title", "headline"), ("slug", "key"), ("price", "amount"), ("firstDate", "from"))),
    ),
)


def extract_shapes(spark, sf):
    """Every part as an event page of one of three shapes, extracted in one scan by three specs."""
    d = derived.part_event_data(spread(table(spark, sf, "part"), derived.PAGE_COLUMNS))
    shape = (F.col("p_partkey") % 3).cast("string")
    page = []
    for spec in SHAPES:
        named = dict(spec.data.fields)
        column = {"title": "title", "slug": "slug", "price": "price", "firstDate": "first_date", "lastDate": "last_date"}
        body = F.struct(*[F.col(column[f]).alias(source) for f, source in named.items()], F.lit("x").alias("unused"))
        for key in reversed(spec.data.path):
            body = F.struct(body.alias(key))
        page.append(F.concat(F.lit(f'<script {spec.script.attr}="{spec.script.value}">'), F.to_json(body), F.lit("</script>")))
    html = F.when(shape == "0", page[0]).when(shape == "1", page[1]).otherwise(page[2])
    rows = d.select(F.concat(F.lit("shape-"), shape).alias("venue"), "url", F.col("p_partkey").alias("page_id"), html.alias("html"))
    out = jobs.extract_all(rows.select("venue", "url"), rows.select("page_id", "url", "html"), list(SHAPES), partitions=text_partitions(rows, "html"))
    return out.select("venue", "url", "outcome", "pathname", "body")


QUERIES = {"run_errors": run_errors, "contract_violations": contract_violations, "extract_shapes": extract_shapes}


def _sub(sql: str) -> str:
    return f"({sql})"


ORACLES = {
    "run_errors": "SELECT 'links' AS stage, url, reason FROM "
    + _sub(P._with("SELECT src_url AS url, status AS reason FROM resolved WHERE status <> 'ok'"))
    + " UNION ALL SELECT 'decode', message_id, reason FROM " + _sub(messages.ORACLES["dead_letters"])
    + " UNION ALL SELECT 'publish', concat(strftime(ts, '%Y-%m-%d'), '/', sent_venue), 'publish_failed' FROM "
    + _sub(messages._with("SELECT * FROM dec WHERE NOT decode_ok"))
    + " UNION ALL SELECT 'extract', url, outcome FROM " + _sub(extraction.ORACLES["extract_outcomes"]) + " WHERE outcome <> 'extracted'"
    + " UNION ALL SELECT 'listing', first, 'malformed' FROM (SELECT arg_min(concat('event-', CAST(p_partkey // 2 AS VARCHAR), '.json'), p_partkey) AS first "
    "FROM part GROUP BY p_partkey // 100) WHERE regexp_matches(first, '50\\.json$')"
    + " UNION ALL SELECT 'store', pathname, reason FROM " + _sub(store_plans.ORACLES["put_rejected"]),
    "contract_violations": "SELECT message_id, 'missing_keys' AS violation, missing_keys AS detail FROM "
    + _sub(messages.ORACLES["message_contract"]) + " WHERE missing_keys <> '' UNION ALL SELECT message_id, 'extra_keys', extra_keys FROM "
    + _sub(messages.ORACLES["message_contract"]) + " WHERE extra_keys <> '' UNION ALL SELECT message_id, 'unknown_venue', venue FROM "
    + _sub(messages.ORACLES["unknown_venues"]),
    "extract_shapes": extraction._with(
        "SELECT concat('shape-', CAST(p_partkey % 3 AS VARCHAR)) AS venue, url, 'extracted' AS outcome, concat(slug, '.json') AS pathname, "
        f"replace({extraction.document_sql('title', extraction.START_DATE_SQL, 'url', 'price')}, '\"priceCurrency\":\"DKK\"', "
        "concat('\"priceCurrency\":\"', ['DKK', 'SEK', 'EUR'][p_partkey % 3 + 1], '\"')) AS body FROM part_events"
    ),
}
