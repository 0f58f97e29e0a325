"""A message queue as streams: delayed delivery by timers (T3) and a closed retry loop (T4).

``DelayQueue`` keeps everything as append-only Parquet in one folder: published
``messages``, ``ticks`` of the clock, ``deliveries`` and ``attempts``. A stateful
stream reads messages, ticks and failed attempts and releases each message when the
stream's time, the watermark of the ticks, reaches its ``deliver_at``. A second
stream hands the releases to a handler and appends one row for each attempt; a failed
one has ``next_at``, and as the first stream reads the attempts, the message comes
again then. An attempt without ``next_at`` (done, or given up) never comes back: the
attempts are the acknowledged set.

The state (RocksDB) is keyed by (venue, hour of ``deliver_at``), so a venue with a third
of all messages spreads over many keys, and an hour holds what its schedule puts
there. A key has its waiting messages and one timer at the earliest of them;
once all are released, the ids stay for ``retain_s`` (a message published twice is
released once) and a last timer drops them. Messages have no event time of their own: only
ticks move the watermark, so no message is late; one that is due already is released at once.

A restart goes on from the checkpoints. After a lost checkpoint all is released
again, and the handler's stream drops every (message, attempt) that has its row,
so nothing is handled or stored twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ensure_checkpoint_dir, ship_package
from . import streams as ST

MESSAGES = "message_id string, venue string, url string, seq long, attempt int, deliver_at timestamp_ntz"
TICKS = "as_of timestamp_ntz"
ATTEMPTS = "message_id string, venue string, url string, seq long, attempt int, started_at timestamp_ntz, ok boolean, reason string, next_at timestamp_ntz"
DELIVERIES = "message_id string, venue string, url string, seq long, attempt int, due_us long, released_us long"
SLOT_S = 3600
RETAIN_S = 86_400
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_EPOCH = "1970-01-01 00:00:00"


def micros(instant):
    """Microseconds since 1970 of a zoneless timestamp."""
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit(_EPOCH)), instant)


def instant(us):
    return F.timestamp_add("MICROSECOND", us, F.to_timestamp_ntz(F.lit(_EPOCH)))


class Release(StatefulProcessor):
    """Holds the messages of one (venue, hour) until they are due."""

    def __init__(self, retain_s: int):
        self.retain_ms = retain_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "messages string")

    def _held(self) -> list:
        """Messages (id, venue, url, seq, attempt, due_us, released), as one value: a list state is written row by row."""
        return json.loads(self.waiting.get()[0]) if self.waiting.exists() else []

    def _hold(self, messages: list) -> None:
        self.waiting.update((json.dumps(messages),))

    def handleInputRows(self, key, rows, timerValues):
        before = self._held()
        held, new = {(m[0], m[4]) for m in before}, {}
        for frame in rows:
            for m in frame[["message_id", "venue", "url", "seq", "attempt", "due_us"]].itertuples(index=False, name=None):
                if m[0] is not None and (m[0], int(m[4])) not in held:
                    new.setdefault((m[0], int(m[4])), (m[0], m[1], m[2], int(m[3]), int(m[4]), int(m[5]), False))
        if new:
            self._hold([*before, *new.values()])
            self.handle.registerTimer(min(_ms(m[5]) for m in new.values()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        held = self._held()
        due = sorted((m for m in held if not m[6] and _ms(m[5]) <= now), key=lambda m: (m[5], m[0], m[4]))
        later = [m for m in held if not m[6] and _ms(m[5]) > now]
        last = max((_ms(m[5]) for m in held), default=0)
        if due:
            gone = {(m[0], m[4]) for m in due}
            self._hold([[m[0], None, None, 0, m[4], m[5], True] if m[6] or (m[0], m[4]) in gone else m for m in held])
        if later:
            self.handle.registerTimer(min(_ms(m[5]) for m in later))
        elif now < last + self.retain_ms:
            self.handle.registerTimer(last + self.retain_ms)
        elif held:
            self.waiting.clear()
        if due:
            columns = ["message_id", "venue", "url", "seq", "attempt", "due_us"]
            yield pd.DataFrame([m[:6] for m in due], columns=columns).assign(released_us=now * 1000)

    def close(self) -> None:
        pass


def _ms(us: int) -> int:
    return -(-us // 1000)


def state_partitions(n_messages: int, each: int = 200_000) -> int:
    """State partitions for a queue that is to hold so many messages at a time; a stream keeps its number for life."""
    return max(1, -(-n_messages // each))


class DelayQueue:
    """``partitions``: of the state, fixed by the first release (default: the session's shuffle partitions)."""

    def __init__(self, spark: SparkSession, path: str, slot_s: int = SLOT_S, retain_s: int = RETAIN_S, partitions: int | None = None):
        self.spark, self.path, self.slot_s, self.retain_s = spark, path.rstrip("/"), slot_s, retain_s
        self.conf = {ROCKSDB[0]: ROCKSDB[1]} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
        ensure_checkpoint_dir(spark)
        for name, schema in (("messages", MESSAGES), ("ticks", TICKS), ("attempts", ATTEMPTS), ("deliveries", DELIVERIES)):
            if not ST.path_exists(spark, f"{self.path}/{name}"):
                spark.createDataFrame([], schema).write.parquet(f"{self.path}/{name}")

    def _append(self, rows: DataFrame, name: str, schema: str) -> None:
        columns = [c.split() for c in schema.split(", ")]
        rows.select(*[F.col(c).cast(kind) for c, kind in columns]).write.mode("append").parquet(f"{self.path}/{name}")

    def publish(self, messages: DataFrame) -> None:
        """Append messages ``message_id, venue, url, seq, deliver_at``."""
        self._append(messages.withColumn("attempt", F.lit(1)), "messages", MESSAGES)

    def poll(self, as_of: str, checkpoint: str = "queue", max_files: int | None = None) -> None:
        """Move the clock to ``as_of`` and release what is due by then; a released message stays released."""
        self._append(self.spark.createDataFrame([(as_of,)], "t string").select(F.to_timestamp_ntz("t").alias("as_of")), "ticks", TICKS)
        self.release(checkpoint, max_files)

    def release(self, checkpoint: str = "queue", max_files: int | None = None) -> None:
        spark = self.spark
        ship_package(spark)
        read = lambda name, schema: ST.file_stream(spark, f"{self.path}/{name}", schema, max_files=max_files)
        none = lambda kind: F.lit(None).cast(kind)
        message = lambda at: [F.col("message_id"), F.col("venue"), F.col("url"), F.col("seq"), F.col("attempt"), micros(F.col(at)).alias("due_us"), none("timestamp").alias("tick")]
        published = read("messages", MESSAGES).select(*message("deliver_at"))
        failed = read("attempts", ATTEMPTS).where("next_at is not null").withColumn("attempt", F.col("attempt") + 1).select(*message("next_at"))
        ticks = read("ticks", TICKS).select(
            *[none(k).alias(c) for c, k in (("message_id", "string"), ("venue", "string"), ("url", "string"), ("seq", "long"), ("attempt", "int"), ("due_us", "long"))],
            F.timestamp_micros(micros(F.col("as_of"))).alias("tick"),
        )
        slot = F.floor(F.col("due_us") / (self.slot_s * 1_000_000))
        rows = published.unionByName(failed).unionByName(ticks).withColumn("slot", slot).withWatermark("tick", "0 seconds")
        out = rows.groupBy("venue", "slot").transformWithStateInPandas(Release(self.retain_s), DELIVERIES, "append", "eventTime")
        before = {key: spark.conf.get(key, None) for key in self.conf}
        for key, value in self.conf.items():
            spark.conf.set(key, value)
        try:
            ST.run_to_files(out, f"{self.path}/deliveries", f"{self.path}/release_{checkpoint}")
        finally:
            for key, value in before.items():
                spark.conf.unset(key) if value is None else spark.conf.set(key, value)

    def deliveries(self) -> DataFrame:
        """What has been released: message columns, ``deliver_at`` and ``released_at``, the clock at its release."""
        rows = self.spark.read.schema(DELIVERIES).parquet(f"{self.path}/deliveries")
        return rows.select("message_id", "venue", "url", "seq", "attempt", instant(F.col("due_us")).alias("deliver_at"), instant(F.col("released_us")).alias("released_at"))

    def attempts(self) -> DataFrame:
        return self.spark.read.schema(ATTEMPTS).parquet(f"{self.path}/attempts")

    def work(
        self,
        handle: Callable[[DataFrame], DataFrame],
        retry_after_s: int,
        max_attempts: int | None = None,
        sink: Callable[[DataFrame, int], None] | None = None,
        checkpoint: str = "worker",
        max_files: int | None = None,
    ) -> None:
        """Hand every new release to ``handle`` and append its attempts.

        ``handle`` gives each release back with ``ok``, ``reason`` and columns for the
        ``sink``, which gets the ones that are ok before their attempts are written and
        must bear to see them again (a put-if-absent). A failed attempt comes again
        ``retry_after_s`` after it started, up to ``max_attempts`` (default: without end).
        The check for attempts that are there already reads two columns of all of them.
        """
        spark = self.spark

        def write(batch: DataFrame, batch_id: int) -> None:
            new = batch.dropDuplicates(["message_id", "attempt"])
            new = new.join(self.attempts().select("message_id", "attempt"), ["message_id", "attempt"], "left_anti")
            new = new.withColumn("started_at", instant(F.col("released_us")))
            done = handle(new).checkpoint()
            if sink is not None:
                sink(done.where("ok"), batch_id)
            again = ~F.col("ok") if max_attempts is None else ~F.col("ok") & (F.col("attempt") < max_attempts)
            next_at = F.when(again, F.timestamp_add("SECOND", F.lit(retry_after_s), F.col("started_at")))
            self._append(done.withColumn("next_at", next_at), "attempts", ATTEMPTS)

        ST.run_foreach_batch(ST.file_stream(spark, f"{self.path}/deliveries", DELIVERIES, max_files=max_files), write, f"{self.path}/work_{checkpoint}")
