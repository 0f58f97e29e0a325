"""Library entry points: a venue is a ``VenueSpec``; a run is a DataFrame job.

``scrape`` turns a venue's page snapshots into scheduled extract messages, and
``scrape_all`` those of all venues in one job; ``publish`` appends them to the log;
``extract`` turns extract messages into MusicEvent documents with one outcome
per message; ``EventStore`` keeps the documents with put-if-absent, overwrite,
get, list and delete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .functions import jsontext
from .functions import urls as U
from .operators import crawl, extract as X, links, routing as R, sequencing
from .operators.joins import bounded_broadcast
from .session import ensure_checkpoint_dir
from .specs import LinkSpec, ScriptSpec, VenueSpec, registry_frame

MESSAGE_SCHEMA = "venue string, url string, seq long, delay_s long, deliver_at timestamp_ntz, body string"
REGISTRY_SCHEMA = "venue string, host string, seed_url string, spec int"
ORDER = ["depth", "src_url", "pos", "page_id"]


def scrape_all(
    pages: DataFrame,
    registry: DataFrame,
    link_specs: list[LinkSpec],
    run_ts: str,
    visited: DataFrame | None = None,
    publish_scope: str = "all",
    max_depth: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """All venues' runs in one job: ``(messages, errors)``.

    ``registry`` has ``venue, host, seed_url, spec``; ``spec`` is the place of the
    venue's selector in ``link_specs`` (null: the venue has no selector and yields
    nothing). Pages of registered hosts are read and parsed once, in one scan;
    what is kept of them is the narrow table of links, checkpointed. Each round then
    joins the frontier's URLs to it: new on-host links are followed, all venues side
    by side, until no new page is found or ``max_depth`` (default: none) is reached.

    A URL is published once per venue (first seen wins in ``depth, src_url, pos``
    order) unless it is the venue's seed or in ``visited`` (column ``url``), whose
    pages are not followed either.
    ``publish_scope='all'`` publishes off-host links too, as the reference does;
    ``'host'`` keeps the venue's host only. ``errors`` has ``venue, stage, url, pos,
    reason`` for links of the pages read that cannot be followed.
    """
    ensure_checkpoint_dir(pages.sparkSession)
    reg = registry.where(F.col("spec").isNotNull()).select(
        F.col("host").alias("_host"), F.col("venue").alias("_venue"), F.col("seed_url").alias("_seed"), F.col("spec").alias("_spec")
    )
    own = links.with_venue_host(pages).join(bounded_broadcast(reg.select("_host", "_spec").distinct()), F.col("venue") == F.col("_host"))
    hrefs = F.lit(None).cast("array<string>")
    for i, spec in enumerate(link_specs):
        hrefs = F.when(F.col("_spec") == i, links.hrefs_of(spec)).otherwise(hrefs)
    if max_depth == 1:  # nothing is followed, so the seeds' pages are all that is read
        own = own.join(bounded_broadcast(reg.select(F.col("_seed").alias("url")).distinct()), "url", "left_semi")
    found = links.resolve_links(links.extract_links(own.select("page_id", "url", "html", "_spec"), hrefs=hrefs, keep=("_spec",)))
    host = U.host(F.col("abs_url"))
    edges = found.select(F.col("venue").alias("_host"), "_spec", "page_id", "src_url", "pos", "status", "abs_url", host.alias("_to")).checkpoint()

    seeds = reg.select("_host", "_spec", "_venue", F.col("_seed").alias("src_url"))
    frontier, reached, rounds, depth = seeds, seeds, [], 1
    on = ["_host", "_spec", "src_url"]
    while True:
        step = edges.join(frontier, on).withColumn("depth", F.lit(depth).cast("int")).checkpoint()
        rounds.append(step)
        if max_depth is not None and depth >= max_depth:
            break
        to = step.where((F.col("status") == "ok") & (F.col("_to") == F.col("_host"))).select("_host", "_spec", "_venue", F.col("abs_url").alias("src_url"))
        if visited is not None:
            to = to.join(visited.select(F.col("url").alias("src_url")), "src_url", "left_anti")
        frontier = to.distinct().join(reached, ["_host", "_spec", "_venue", "src_url"], "left_anti").checkpoint()
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
        depth += 1
    every = rounds[0]
    for step in rounds[1:]:
        every = every.unionByName(step)
    errors = every.where("status != 'ok'").select(
        F.col("_venue").alias("venue"), F.lit("links").alias("stage"), F.col("src_url").alias("url"), "pos", F.col("status").alias("reason")
    )
    ok = every.where("status = 'ok'")
    if publish_scope == "host":
        ok = ok.where(F.col("_to") == F.col("_host"))
    ok = ok.select(F.col("_venue").alias("venue"), F.col("abs_url").alias("url"), "depth", "src_url", "pos", "page_id")
    new = crawl.first_seen(ok, key=["venue", "url"], order=ORDER)
    new = new.join(reg.select(F.col("_venue").alias("venue"), F.col("_seed").alias("url")), ["venue", "url"], "left_anti")
    if visited is not None:
        new = new.join(visited.select("url"), "url", "left_anti")
    seq = sequencing.number_within(new, ["venue"], ORDER)
    out = sequencing.with_schedule(seq, run_ts)
    return out.select("venue", "url", "seq", "delay_s", "deliver_at", jsontext.encode(F.struct("venue", "url")).alias("body")), errors


def scrape_to_log(
    pages: DataFrame,
    registry: DataFrame,
    link_specs: list[LinkSpec],
    run_ts: str,
    visited: crawl.VisitedTable,
    topic: str,
    log_path: str,
    publish_scope: str = "all",
    max_depth: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``scrape_all`` past the visited table, published to the log; then the run's URLs are added to the table.

    A run lost in between publishes its messages again, and none is lost: whoever takes them stores each event once.
    """
    seen = visited.read().select("url") if visited.buckets() is not None else None
    messages, errors = scrape_all(pages, registry, link_specs, run_ts, seen, publish_scope, max_depth)
    messages = messages.checkpoint()
    publish(messages, topic, log_path)
    visited.add(messages)
    return messages, errors


def scrape(
    pages: DataFrame,
    spec: VenueSpec,
    run_ts: str,
    visited: DataFrame | None = None,
    publish_scope: str = "all",
    max_depth: int | None = None,
) -> DataFrame:
    """Extract messages of one venue run, as ``scrape_all`` gives them: ``venue, url, seq, delay_s, deliver_at, body``.

    A spec without a link selector yields no rows and succeeds.
    """
    spark = pages.sparkSession
    if spec.links is None:
        return spark.createDataFrame([], MESSAGE_SCHEMA)
    registry = spark.createDataFrame([(spec.name, spec.host, spec.seed_url, 0)], REGISTRY_SCHEMA)
    return scrape_all(pages, registry, [spec.links], run_ts, visited, publish_scope, max_depth)[0]


def publish(messages: DataFrame, topic: str, log_path: str) -> None:
    """Append messages to the log: Parquet files partitioned by topic, which streams read in turn."""
    messages.withColumn("topic", F.lit(topic)).write.mode("append").partitionBy("topic").parquet(log_path)


def extract(messages: DataFrame, pages: DataFrame, spec: VenueSpec, keep_empty: bool = False) -> DataFrame:
    """One row per message and script: outcome, MusicEvent struct, pathname and body."""
    script = spec.script or ScriptSpec()
    if spec.script is None:
        return X.extract_events(messages.limit(0), pages, script, keep_empty)
    out = X.extract_events(messages, pages, script, keep_empty=keep_empty, currency=spec.currency)
    return spec.post(out) if spec.post is not None else out


def extract_all(messages: DataFrame, pages: DataFrame, specs: list[VenueSpec], snapshot_order: str | None = None, partitions: int | None = None) -> DataFrame:
    """``extract`` for the messages of all venues in one scan of the pages, each venue by its own spec (``post`` steps are for ``extract``)."""
    return X.extract_by_spec(messages, pages, specs, snapshot_order, partitions=partitions)


def route(messages: DataFrame, specs: list[VenueSpec], path: str, body_col: str = "body") -> dict[tuple[str, str], int]:
    """Decode and route messages into Parquet, partitioned by outcome, and return the run's counts from the same pass.

    Dead letters are the partitions other than ``accepted``.
    """
    registry = registry_frame(messages.sparkSession, specs)
    counts = Observation("routed")
    routed = R.observed(R.route(R.decode_messages(messages, body_col), registry), [s.name for s in specs], counts)
    routed.write.mode("append").partitionBy("outcome").parquet(path)
    return R.observed_counts(counts)
