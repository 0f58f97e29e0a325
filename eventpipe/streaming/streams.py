"""Streams (T1-T7): chained topics through an append-only message log, keyed dedup
state, replay-safe put-if-absent, delayed visibility and retries.

Every stream runs with its own checkpoint under the shared checkpoint folder and
``trigger(availableNow=True)`` (one run = the daily run). Sinks are idempotent:
files are committed by the file sink's log, and the store sink only adds keys that
no batch has stored, so a replay in any cut of batches adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crawl, sequencing
from ..operators import store as ST
from ..operators.store import is_folder, key_bucket, path_exists, store_buckets  # noqa: F401 - the streams' users choose buckets too
from ..session import ensure_checkpoint_dir


def file_stream(spark: SparkSession, folder: str, schema, glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """A streaming scan of Parquet files in ``folder`` (optionally only names matching ``glob``)."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(folder)


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A streaming scan of a table, which is one Parquet file or a folder of them. A stream cannot start at a file's own path, so a file is picked by name from the folder it lies in."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    if is_folder(spark, path):
        return file_stream(spark, path, schema, max_files=max_files)
    return file_stream(spark, sf_dir, schema, glob=f"{name}.parquet", max_files=max_files)


ARRIVAL_GROUP_BYTES = 8 << 20


def arrive(rows: DataFrame, folder: str) -> None:
    """Rows that arrive at a stream together, as one file. Its row groups are small, as a row group is read by one task: at the
    writer's default of 128 MB a file is one task up to that size, and its micro-batch with it."""
    rows.coalesce(1).write.option("parquet.block.size", ARRIVAL_GROUP_BYTES).parquet(folder)


def run_to_files(stream: DataFrame, out: str, checkpoint: str, partition_by=None, mode: str = "append") -> None:
    """Run once over everything available, into Parquet files; returns when done."""
    w = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.trigger(availableNow=True).start(out)
    q.awaitTermination()


def run_foreach_batch(stream: DataFrame, fn, checkpoint: str) -> None:
    q = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def dedup_keys(stream: DataFrame, keys: list[str], event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Keyed dedup. Exact with state per key; with ``event_time`` the state is bounded
    by a watermark (``dropDuplicatesWithinWatermark``)."""
    if event_time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def put_if_absent_sink(
    store_path: str, writer: str, order: str, base_url: str, key: str = "pathname", buckets: int | None = None, **put_options
):
    """A ``foreachBatch`` function writing each batch with put-if-absent.

    A batch is checked against all stored keys and only what is new is appended;
    nothing stored is ever rewritten. So a batch that failed after its write, a
    restarted stream, and a replay from a lost checkpoint with another cut of
    batches all leave the table as it was: their keys are there already. The store
    is partitioned by ``bucket`` when ``buckets`` is set (choose it from the size of
    the store); the check then reads only the buckets the batch's keys hash to, a
    list of at most ``buckets`` ids. The batch's first row of each key is checkpointed, so
    that the work behind the batch is done once, and not again to list its buckets.
    ``writer`` and ``batch_id`` are kept with each
    row. Writers must not commit at the same moment (Parquet has no compare-and-set).
    """
    parts = ["bucket"] if buckets else []

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ensure_checkpoint_dir(spark)
        first = ST.first_wins(batch, order, key)
        if buckets:
            first = first.withColumn("bucket", key_bucket(key, buckets))
        first = first.checkpoint()
        if path_exists(spark, store_path):
            stored = spark.read.parquet(store_path)
            if buckets:
                touched = [r[0] for r in first.select("bucket").distinct().collect()]  # at most `buckets` ids
                stored = stored.where(F.col("bucket").isin(touched))
            others = stored.select(key)
        else:
            others = spark.createDataFrame([], f"{key} string")
        rows = ST.object_rows(ST.not_stored(first, others, key), base_url, **put_options)
        rows = rows.withColumn("writer", F.lit(writer)).withColumn("batch_id", F.lit(batch_id).cast("long"))
        rows.write.mode("append").partitionBy(*parts).parquet(store_path)  # reads the files that were listed above, and adds others

    return write


LOG_SCHEMA = "run_id string, venue string, url string, seq long, delay_s long, deliver_at timestamp_ntz, writer string, batch_id long"


def sequenced_sink(log_path: str, writer: str, order: list[str], step: int = sequencing.DELAY_STEP_SECONDS):
    """W1-W3 inside a stream: a ``foreachBatch`` function that appends new URLs to the message log with their number and due time.

    A batch has ``run_id, venue, url, run_ts`` and the ``order`` columns. A URL that the run's log
    has, or that stands earlier in the batch, is dropped. The others go on where the venue's count
    in the log ends: ``seq`` is that count plus the place in the batch, numbered by range sort
    (``number_within``), so a hot venue is no single task, and the counter is the log
    itself. Only the batch's runs are read, one partition folder each, and of them three columns. A batch
    that runs again replaces what it wrote (its own ``writer`` and ``batch_id`` partition), a replay from
    a lost checkpoint under another writer finds its URLs in the log.
    """
    columns = [c.split()[0] for c in LOG_SCHEMA.split(", ")]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ensure_checkpoint_dir(spark)
        first = crawl.first_seen(batch, ["run_id", "venue", "url"], order).checkpoint()  # the batch's pages are read once
        if path_exists(spark, log_path):
            runs = first.select("run_id").distinct()
            log = spark.read.schema(LOG_SCHEMA).parquet(log_path).select("run_id", "venue", "url", "writer", "batch_id")
            others = log.join(runs, "run_id", "left_semi").where(~((F.col("writer") == writer) & (F.col("batch_id") == batch_id)))
        else:
            others = spark.createDataFrame([], "run_id string, venue string, url string")
        new = first.join(others.select("run_id", "venue", "url"), ["run_id", "venue", "url"], "left_anti")
        numbered = sequencing.number_within(new, ["run_id", "venue"], order, out="place")
        counts = others.groupBy("run_id", "venue").agg(F.count(F.lit(1)).alias("before"))
        seq = F.col("place") + F.coalesce("before", F.lit(0))
        out = numbered.join(counts, ["run_id", "venue"], "left").withColumn("seq", seq).withColumn("delay_s", F.col("seq") * step)
        out = out.withColumn("deliver_at", F.timestamp_add("SECOND", F.col("delay_s"), F.col("run_ts")))
        out = out.withColumns({"writer": F.lit(writer), "batch_id": F.lit(batch_id).cast("long")}).select(*columns)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "writer", "batch_id").parquet(log_path)

    return write


RETRY_SCHEMA = "message_id string, attempt int, next_at timestamp_ntz, action string, batch_id long"


def retry_sink(failures_path: str, retry_after_s: int, max_attempts: int | None = None, ts_col: str = "failed_at"):
    """T4: a ``foreachBatch`` function that schedules failed messages again.

    Each failure row (``message_id, attempt, failed_at``) becomes a retry at
    ``failed_at + retry_after_s`` with ``attempt + 1``, without end, or a dead letter
    once ``max_attempts`` (default: none) is used up. A (message, attempt) that is
    stored already is not added again, so a replay in any cut of batches changes
    nothing; nothing stored is rewritten.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ensure_checkpoint_dir(spark)
        nxt = F.col("attempt") + 1
        action = F.lit("retry") if max_attempts is None else F.when(nxt > max_attempts, F.lit("dead_letter")).otherwise(F.lit("retry"))
        out = batch.select(
            "message_id",
            nxt.cast("int").alias("attempt"),
            F.timestamp_add("SECOND", F.lit(retry_after_s), F.col(ts_col)).alias("next_at"),
            action.alias("action"),
            F.lit(batch_id).cast("long").alias("batch_id"),
        ).dropDuplicates(["message_id", "attempt"])
        if path_exists(spark, failures_path):
            stored = spark.read.schema(RETRY_SCHEMA).parquet(failures_path)
            out = out.join(stored.select("message_id", "attempt"), ["message_id", "attempt"], "left_anti").select(*out.columns)
        out.checkpoint().write.mode("append").parquet(failures_path)

    return write
