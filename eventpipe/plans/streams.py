"""Streaming queries: each runs its stream(s) once with ``availableNow`` into the shared
checkpoint folder and returns the result read back from Parquet. The oracles are the
batch equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.zones import day_text
from ..operators import extract as X, links, routing as R, sequencing
from ..session import ensure_checkpoint_dir, state_path
from ..sources import derived
from ..sources.tables import pages as read_pages, table, write_bucketed_pages
from ..specs import LinkSpec
from ..streaming import queue as Q
from ..streaming import streams as ST
from . import params
from . import pages as P
from . import sql as S
from .extraction import PART_EVENTS_CTE, START_DATE_SQL, document_sql
from .messages import MESSAGES_CTE, message_registry

EVENT_LINKS = LinkSpec(attr="data-theme", value="secondary")


def _new_links(stream, spec=LinkSpec()):
    """Links of a page stream as rows of a run, for the sequenced log."""
    found = links.followable(links.resolve_links(links.extract_links(stream, spec)))
    run = F.lit(params.RUN_ID).alias("run_id"), F.to_timestamp_ntz(F.lit(params.RUN_TS)).alias("run_ts")
    return found.select(*run, "venue", F.col("abs_url").alias("url"), *P.ORDER)


def _scrape(stream, visited, log, checkpoint, writer):
    """A page stream's new URLs into the message log, numbered per venue across micro-batches."""
    new = _new_links(stream).join(visited, ["venue", "url"], "left_anti")
    ST.run_foreach_batch(new, ST.sequenced_sink(log, writer, P.ORDER), checkpoint)


def _visited(pages):
    return links.with_venue_host(pages).select("venue", U.without_fragment(F.col("url")).alias("url"))


def stream_extract(spark, sf):
    """Page stream -> links -> new URLs, numbered -> message log -> extract stream -> outcome
    per message (page snapshot found or not)."""
    base = state_path(spark, "stream_extract")
    log, out = f"{base}/log", f"{base}/out"
    pages = read_pages(spark, sf)
    _scrape(ST.table_stream(spark, sf, "pages"), _visited(pages), log, f"{base}/ck_scrape", "scrape")

    extract_in = ST.file_stream(spark, log, ST.LOG_SCHEMA)
    joined = extract_in.join(pages.select("url", "page_id"), "url", "left")
    outcome = F.when(F.col("page_id").isNull(), F.lit("not_fetched")).otherwise(F.lit("fetched"))
    ST.run_to_files(joined.select("venue", "url", outcome.alias("outcome")), out, f"{base}/ck_extract")
    return spark.read.parquet(out)


SLICES = 4


def stream_schedule(spark, sf):
    """W1, W2 inside T1: pages arrive in four files, a micro-batch each, with a restart after two; the log's
    numbers and due times are those of the batch schedule. Then a lost checkpoint: the replay adds nothing."""
    base = state_path(spark, "stream_schedule")
    staged, log = f"{base}/pages", f"{base}/log"
    pages = read_pages(spark, sf)
    visited = _visited(pages)
    fine = _store_buckets_of(pages, "html")  # ranges of a slice, so that a slice is not one task
    ranged = pages.repartitionByRange(SLICES * fine, "url")  # whole URLs: a page's links keep their order
    ranged = ranged.withColumn("slice", F.floor(F.spark_partition_id() / fine).cast("int"))
    ranged.write.partitionBy("slice").parquet(f"{base}/ranged")
    for k in range(SLICES):
        ST.arrive(spark.read.schema(ranged.schema).parquet(f"{base}/ranged").where(F.col("slice") == k).drop("slice"), f"{staged}/{k}")
        if k in (1, SLICES - 1):
            stream = ST.file_stream(spark, f"{staged}/*", pages.schema, max_files=1)
            _scrape(stream, visited, log, f"{base}/ck", "scrape")
    _scrape(ST.file_stream(spark, f"{staged}/*", pages.schema), visited, log, f"{base}/ck_lost", "replay")
    return spark.read.schema(ST.LOG_SCHEMA).parquet(log).select("venue", "url", "seq", "delay_s", "deliver_at")


SNAPSHOT_BUCKET_BYTES = 8 << 20


def stream_to_store(spark, sf):
    """T1 to the end: page stream -> scrape -> message log -> extract stream (fetch, decode, document) -> store.

    It is run, run again on the same checkpoints, and replayed from lost ones: the
    log's dedup state is bounded by a watermark, and put-if-absent keeps what a late
    duplicate or a replay would write twice. The newest snapshots are saved once, bucketed
    on the URL, one small file a bucket; a micro-batch shuffles its messages only and works on a bucket a task.
    """
    base = state_path(spark, "stream_to_store")
    staged, log, store = f"{base}/pages", f"{base}/log", f"{base}/store"
    derived.part_event_pages(table(spark, sf, "part")).write.parquet(staged)
    pages = spark.read.parquet(staged)
    size = pages.agg(F.sum(F.octet_length("html").cast("long"))).first()[0] or 0
    name = f"snapshots_{uuid.uuid4().hex}"
    buckets = ST.store_buckets(size, SNAPSHOT_BUCKET_BYTES)
    newest = write_bucketed_pages(X.newest_snapshot(pages, partitions=buckets).withColumn("page_id", F.lit(0)), name, buckets)
    for checkpoint in ("ck", "ck", "ck_lost"):
        stream = ST.file_stream(spark, staged, pages.schema)
        found = links.followable(links.resolve_links(links.extract_links(stream, EVENT_LINKS)))
        msgs = found.select("venue", F.col("abs_url").alias("url"), F.current_timestamp().alias("seen_at"))
        ST.run_to_files(ST.dedup_keys(msgs, ["venue", "url"], event_time="seen_at"), log, f"{base}/{checkpoint}_scrape")
        messages = ST.file_stream(spark, log, spark.read.parquet(log).schema).select("venue", "url")
        done = X.extract_events(messages, newest, one_each=True).where("outcome = 'extracted'").select("pathname", "body", "url")
        sink = ST.put_if_absent_sink(store, writer="extract", order="order_url", base_url=params.OBJECT_BASE_URL, buckets=ST.store_buckets(size))
        ST.run_foreach_batch(done.withColumnRenamed("url", "order_url"), sink, f"{base}/{checkpoint}_extract")
    spark.sql(f"DROP TABLE {name}")
    return spark.read.parquet(store).select("pathname", "etag")


def stream_dedup(spark, sf):
    """Keyed dedup over the event stream, one row per (run, URL), with state bounded by a watermark of a day.

    Every tenth event comes again in a later file, after a restart: a late duplicate is dropped
    by its time once its state is gone.
    """
    base = state_path(spark, "stream_dedup")
    events = table(spark, sf, "events")
    for late in (False, True):
        (events.where("event_id % 10 = 0") if late else events).write.mode("append").parquet(f"{base}/events")
        ev = ST.file_stream(spark, f"{base}/events", events.schema)
        at = F.timestamp_micros(Q.micros(F.col("ts").cast("timestamp_ntz"))).alias("at")
        keyed = ev.select(day_text(F.col("ts")).alias("run_id"), derived.event_message_url(ev).alias("url"), at)
        ST.run_to_files(ST.dedup_keys(keyed, ["run_id", "url"], event_time="at"), f"{base}/out", f"{base}/ck")
    return spark.read.parquet(f"{base}/out").select("run_id", "url")


def _store_buckets_of(df, body):
    return ST.store_buckets(df.agg(F.sum(F.octet_length(body).cast("long"))).first()[0] or 0)


def stream_put_if_absent(spark, sf):
    """Event documents put-if-absent from a stream of day files, run twice (the second
    time from a lost checkpoint, i.e. a full replay); the store must not change."""
    base = state_path(spark, "stream_put")
    staged = f"{base}/events_by_day"
    ev = table(spark, sf, "events").withColumn("day", day_text(F.col("ts")))
    ev.repartition("day").write.partitionBy("day").parquet(staged)
    schema = spark.read.parquet(staged).schema
    store, buckets = f"{base}/store", _store_buckets_of(ev, "props")
    for attempt in ("run", "replay"):
        s = ST.file_stream(spark, staged, schema, max_files=15)
        docs = s.select(
            F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.col("day"), F.lit(".json")).alias("pathname"),
            "event_id",
            F.col("props").alias("body"),
        )
        sink = ST.put_if_absent_sink(store, writer="events", order="event_id", base_url=params.OBJECT_BASE_URL, buckets=buckets)
        ST.run_foreach_batch(docs, sink, f"{base}/ck_{attempt}")
    return spark.read.parquet(store).select("pathname", "event_id")


def stream_put_replay(spark, sf):
    """Keys that span many day files, put by batches of 15 files and then replayed from a
    lost checkpoint in batches of 7: every key is stored once, with the body of the first run."""
    base = state_path(spark, "stream_replay")
    staged, store = f"{base}/events_by_day", f"{base}/store"
    ev = table(spark, sf, "events").withColumn("day", day_text(F.col("ts")))
    ev.repartition("day").write.partitionBy("day").parquet(staged)
    schema = spark.read.parquet(staged).schema
    seen, buckets = [], _store_buckets_of(ev, "props")
    for max_files in (15, 7):
        docs = ST.file_stream(spark, staged, schema, max_files=max_files).select(
            F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".json")).alias("pathname"), "event_id", F.col("props").alias("body")
        )
        sink = ST.put_if_absent_sink(store, writer="events", order="event_id", base_url=params.OBJECT_BASE_URL, buckets=buckets)
        ST.run_foreach_batch(docs, sink, f"{base}/ck_{max_files}")
        rows = spark.read.parquet(store).groupBy("pathname").agg(F.count("*").alias("n_stored"), F.min("event_id").alias("event_id"))
        ensure_checkpoint_dir(spark)
        seen.append(rows.checkpoint())  # before the replay adds to the store
    first, last = seen[0].select("pathname", F.col("event_id").alias("first_id")), seen[1]
    same = F.col("first_id").eqNullSafe(F.col("event_id")).alias("unchanged")
    return last.join(first, "pathname", "left").select("pathname", "n_stored", same)


def _scheduled(spark, sf):
    m = R.decode_messages(derived.event_messages(table(spark, sf, "events")))
    acc = R.route(m, message_registry(spark)).where(F.col("outcome") == "accepted")
    acc = acc.withColumn("run_id", day_text(F.col("ts")))
    seq = sequencing.number_within(acc, ["run_id", "venue"], ["event_id"], out="seq")
    run_start = F.to_timestamp_ntz(F.col("run_id"))
    delay = (F.col("seq") * F.lit(sequencing.DELAY_STEP_SECONDS)).cast("long")
    return seq.withColumn("delay_s", delay).withColumn("deliver_at", F.timestamp_add("SECOND", delay, run_start))


DUE_AS_OF = "2024-01-15 12:00:00"
DUE_SINCE = "2024-01-15 00:00:00"


def due(scheduled, done, as_of):
    """Scheduled messages with ``deliver_at`` up to ``as_of`` whose ``message_id`` is not among the done ones, however old."""
    return scheduled.where(F.col("deliver_at") <= F.to_timestamp_ntz(F.lit(as_of))).join(done.select("message_id"), "message_id", "left_anti")


def due_messages(spark, sf):
    """T3 as a batch: messages visible by now and not done. The tables hold no log of done messages, so done
    is here what was visible at the previous poll; ``stream_delivery`` has the queue's own log."""
    s = _scheduled(spark, sf)
    done = s.where(F.col("deliver_at") <= F.to_timestamp_ntz(F.lit(DUE_SINCE))).select("message_id")
    return due(s, done, DUE_AS_OF).select("message_id", "venue", "seq", "deliver_at")


def stream_delivery(spark, sf):
    """The scheduled messages go through the delay queue, which is polled twice, with a restart between; what the
    second poll releases is visible by then and was not released before."""
    ensure_checkpoint_dir(spark)
    scheduled = _scheduled(spark, sf).checkpoint()
    queue = Q.DelayQueue(spark, state_path(spark, "due"), partitions=Q.state_partitions(scheduled.count()))
    queue.publish(scheduled)
    for as_of in (DUE_SINCE, DUE_AS_OF):
        queue.poll(as_of)
    out = queue.deliveries().where(F.col("released_at") == F.to_timestamp_ntz(F.lit(DUE_AS_OF)))
    return out.select("message_id", "venue", "seq", "deliver_at")


RETRY_POLLS = ("2024-03-01 00:00:00", "2024-03-01 00:01:00", "2024-03-01 00:02:00", "2024-03-01 00:03:00")


def retry_loop(spark, sf):
    """T4: messages whose URL does not parse fail, come again 60 s later, and are stored once when they succeed.

    Every second one has its URL put right upstream after two failures; the others fail at
    each poll. Each poll restarts both streams; at the end both checkpoints are lost and all is
    replayed. One row for each attempt, with the number of objects stored for its message.
    """
    base = state_path(spark, "retry-loop")
    ensure_checkpoint_dir(spark)
    m = R.decode_messages(derived.event_messages(table(spark, sf, "events")))
    failing = R.route(m, message_registry(spark)).where((F.col("outcome") == "accepted") & ~U.parsable(F.col("url")))
    failing = failing.select("message_id", "venue", "url", F.lit(1).alias("seq"), F.col("ts").alias("deliver_at")).checkpoint()
    queue = Q.DelayQueue(spark, f"{base}/queue", partitions=Q.state_partitions(failing.count()))
    queue.publish(failing)
    sink = ST.put_if_absent_sink(f"{base}/store", writer="retry", order="message_id", base_url=params.OBJECT_BASE_URL)

    def handle(releases):
        number = F.substring("message_id", 3, 20).cast("long")
        ok = U.parsable(F.col("url")) | ((number % 2 == 0) & (F.col("attempt") >= 3))
        return releases.withColumns({"ok": ok, "reason": F.when(~ok, F.lit("bad_url"))})

    def store(done, batch_id):
        sink(done.select(F.concat("message_id", F.lit(".json")).alias("pathname"), "message_id", F.col("url").alias("body")), batch_id)

    for as_of in RETRY_POLLS:
        queue.poll(as_of)
        queue.work(handle, params.RETRY_AFTER_S, sink=store)
    queue.release("queue_lost")
    queue.work(handle, params.RETRY_AFTER_S, sink=store, checkpoint="worker_lost")
    stored = spark.read.parquet(f"{base}/store").groupBy("message_id").agg(F.count("*").alias("n_stored"))
    rows = queue.attempts().join(stored, "message_id", "left")
    return rows.select("message_id", F.col("attempt").cast("long").alias("attempt"), "started_at", "ok", "next_at", F.coalesce("n_stored", F.lit(0)).alias("n_stored"))


def retry_schedule(spark, sf):
    """T4: a stream of messages through the retry sink. Accepted messages whose URL does not parse
    (``bad_url``, the one extract error the reference retries) come again 60 s after they failed,
    with no last attempt. An empty URL is not retried: it fails to fetch and is acknowledged."""
    base = state_path(spark, "retries")
    m = R.decode_messages(derived.event_messages(ST.table_stream(spark, sf, "events")))
    failing = R.route(m, message_registry(spark)).where((F.col("outcome") == "accepted") & ~U.parsable(F.col("url")))
    failures = failing.select("message_id", F.lit(1).alias("attempt"), F.col("ts").alias("failed_at"))
    ST.run_foreach_batch(failures, ST.retry_sink(f"{base}/retries", params.RETRY_AFTER_S), f"{base}/ck")
    retries = spark.read.schema(ST.RETRY_SCHEMA).parquet(f"{base}/retries")
    return retries.select("message_id", F.col("attempt").cast("long").alias("attempt"), "next_at", "action")


QUERIES = {
    "stream_extract": stream_extract,
    "stream_schedule": stream_schedule,
    "retry_loop": retry_loop,
    "stream_delivery": stream_delivery,
    "stream_to_store": stream_to_store,
    "stream_dedup": stream_dedup,
    "stream_put_if_absent": stream_put_if_absent,
    "stream_put_replay": stream_put_replay,
    "due_messages": due_messages,
    "retry_schedule": retry_schedule,
}

_SEQ = f"""{MESSAGES_CTE},
sched AS (
  SELECT message_id, venue, ts, url, seq, CAST(strftime(ts, '%Y-%m-%d') AS TIMESTAMP) + to_seconds(seq * {sequencing.DELAY_STEP_SECONDS}) AS deliver_at
  FROM (SELECT *, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d'), venue ORDER BY event_id) AS seq
        FROM routed WHERE outcome = 'accepted')
)"""

_URL = (
    "concat('https://', event_type, '.example.com/e/', CAST(user_id AS VARCHAR), '?k=', "
    "coalesce(json_extract_string(props, '$.k'), ''))"
)

_POLLS = ", ".join(f"({i}, TIMESTAMP '{t}')" for i, t in enumerate(RETRY_POLLS, start=1))

ORACLES = {
    "stream_schedule": P.ORACLES["delivery_schedule"],
    "retry_loop": f"WITH {MESSAGES_CTE}, polls(attempt, polled) AS (VALUES {_POLLS})\n"
    "SELECT message_id, CAST(attempt AS BIGINT) AS attempt, polled AS started_at, event_id % 2 = 0 AND attempt >= 3 AS ok, "
    f"CASE WHEN event_id % 2 = 0 AND attempt >= 3 THEN NULL ELSE polled + to_seconds({params.RETRY_AFTER_S}) END AS next_at, "
    "CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_stored "
    f"FROM routed, polls WHERE outcome = 'accepted' AND NOT {S.parsable('url')} AND (event_id % 2 = 1 OR attempt <= 3)",
    "stream_extract": P._with(
        "SELECT n.venue, n.url, CASE WHEN p.page_id IS NULL THEN 'not_fetched' ELSE 'fetched' END AS outcome "
        "FROM (SELECT DISTINCT venue, abs_url AS url FROM ok) n "
        "ANTI JOIN visited v ON n.venue = v.venue AND n.url = v.url LEFT JOIN pages p ON n.url = p.url"
    ),
    "stream_dedup": f"SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS run_id, {_URL} AS url FROM events",
    "stream_put_replay": "SELECT concat('u', CAST(user_id AS VARCHAR), '.json') AS pathname, CAST(1 AS BIGINT) AS n_stored, true AS unchanged "
    "FROM events GROUP BY 1",
    "stream_put_if_absent": "SELECT concat('u', CAST(user_id AS VARCHAR), '-', strftime(ts, '%Y-%m-%d'), '.json') AS pathname, "
    "min(event_id) AS event_id FROM events GROUP BY 1",
    "due_messages": f"WITH {_SEQ}\nSELECT message_id, venue, CAST(seq AS BIGINT) AS seq, deliver_at FROM sched "
    f"WHERE deliver_at > TIMESTAMP '{DUE_SINCE}' AND deliver_at <= TIMESTAMP '{DUE_AS_OF}'",
    "stream_to_store": f"WITH {PART_EVENTS_CTE}\nSELECT concat(slug, '.json') AS pathname, "
    f"md5({document_sql('title', START_DATE_SQL, 'url', 'price')}) AS etag FROM part_events",
    "retry_schedule": f"WITH {MESSAGES_CTE}\nSELECT message_id, CAST(2 AS BIGINT) AS attempt, "
    f"ts + to_seconds({params.RETRY_AFTER_S}) AS next_at, 'retry' AS action "
    f"FROM routed WHERE outcome = 'accepted' AND NOT {S.parsable('url')}",
}
ORACLES["stream_delivery"] = ORACLES["due_messages"]
