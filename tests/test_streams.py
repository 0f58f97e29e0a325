"""Streams: replay and restart change nothing (FIXTURES.md §3, streams)."""

import os
import tempfile

from pyspark.sql import functions as F

from eventpipe.streaming import streams as ST

BASE = "https://objects.example.com/"
SCHEMA = "pathname string, seq long, body string"


def _write_batches(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(os.path.join(folder, f"b{i:03d}"))


def test_put_if_absent_stream_replay(spark):
    root = tempfile.mkdtemp(prefix="stream-put-")
    src = os.path.join(root, "in")
    batches = [
        [("a.json", 1, "a1"), ("b.json", 2, "b1")],
        [("a.json", 3, "a2"), ("c.json", 4, "c1"), ("c.json", 5, "c2")],
        [("b.json", 6, "b2"), ("d.json", 7, "d1")],
    ]
    _write_batches(spark, src, batches)
    schema = spark.read.parquet(os.path.join(src, "b000")).schema

    want = [("a.json", "a1"), ("b.json", "b1"), ("c.json", "c1"), ("d.json", "d1")]
    for buckets in (None, 4):
        store = os.path.join(root, f"store-{buckets}")

        def run(ck, writer="w"):
            s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "*"))
            sink = ST.put_if_absent_sink(store, writer=writer, order="seq", base_url=BASE, buckets=buckets)
            ST.run_foreach_batch(s, sink, os.path.join(root, f"{ck}-{buckets}"))
            return sorted((r.pathname, r.body) for r in spark.read.parquet(store).collect())

        assert run("ck1") == want
        assert run("ck1") == want  # restart from the checkpoint: nothing new
        assert run("ck2") == want  # checkpoint lost: full replay under the same writer
        assert run("ck3", writer="other") == want  # a second writer with the same input adds nothing


def test_dedup_state(spark):
    root = tempfile.mkdtemp(prefix="stream-dedup-")
    src = os.path.join(root, "in")
    _write_batches(spark, src, [[("u1", 1, "x"), ("u2", 2, "x")], [("u1", 3, "y"), ("u3", 4, "y")], [("u2", 5, "z")]])
    schema = spark.read.parquet(os.path.join(src, "b000")).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "*"))
    out = os.path.join(root, "out")
    ST.run_to_files(ST.dedup_keys(s.select("pathname"), ["pathname"]), out, os.path.join(root, "ck"))
    assert sorted(r.pathname for r in spark.read.parquet(out).collect()) == ["u1", "u2", "u3"]


def test_retry_sink(spark):
    root = tempfile.mkdtemp(prefix="stream-retry-")
    src = os.path.join(root, "in")
    spark.createDataFrame([("m1", 1, "2024-01-01 00:00:00"), ("m2", 3, "2024-01-01 00:01:00")], "message_id string, attempt int, failed_at string") \
        .select("message_id", "attempt", F.to_timestamp_ntz("failed_at").alias("failed_at")).write.parquet(src)
    schema = spark.read.parquet(src).schema
    out = os.path.join(root, "retries")
    s = spark.readStream.schema(schema).parquet(src)
    ST.run_foreach_batch(s, ST.retry_sink(out, retry_after_s=60, max_attempts=3), os.path.join(root, "ck"))
    got = {r.message_id: (r.attempt, str(r.next_at), r.action) for r in spark.read.parquet(out).collect()}
    assert got == {"m1": (2, "2024-01-01 00:01:00", "retry"), "m2": (4, "2024-01-01 00:02:00", "dead_letter")}
    more = os.path.join(src, "more")
    spark.createDataFrame([("m2", 4, "2024-01-01 00:02:00")], "message_id string, attempt int, failed_at string") \
        .select("message_id", "attempt", F.to_timestamp_ntz("failed_at").alias("failed_at")).write.parquet(more)
    again = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(src)
    ST.run_foreach_batch(again, ST.retry_sink(out, retry_after_s=60), os.path.join(root, "ck_lost"))  # replayed with another cut, no last attempt
    rows = sorted((r.message_id, r.attempt, r.action) for r in spark.read.parquet(out).collect())
    assert rows == [("m1", 2, "retry"), ("m2", 4, "dead_letter"), ("m2", 5, "retry")]


def test_put_if_absent_stream_failed_batch_and_duplicate_file(spark):
    import shutil

    import pytest

    root = tempfile.mkdtemp(prefix="stream-crash-")
    src = os.path.join(root, "in")
    _write_batches(spark, src, [[("a.json", 1, "a1")], [("b.json", 2, "b1"), ("a.json", 3, "a2")], [("c.json", 4, "c1")]])
    schema = spark.read.parquet(os.path.join(src, "b000")).schema
    store = os.path.join(root, "store")
    ck = os.path.join(root, "ck")
    inner = ST.put_if_absent_sink(store, writer="w", order="seq", base_url=BASE, buckets=4)
    crashed = []

    def crash_once(batch, batch_id):
        inner(batch, batch_id)  # the write lands ...
        if batch_id == 1 and not crashed:
            crashed.append(batch_id)
            raise RuntimeError("executor lost before the batch committed")  # ... but the batch never commits

    def run(fn):
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "*"))
        ST.run_foreach_batch(s, fn, ck)
        return sorted((r.pathname, r.body) for r in spark.read.parquet(store).collect())

    with pytest.raises(Exception):
        run(crash_once)
    want = [("a.json", "a1"), ("b.json", "b1"), ("c.json", "c1")]
    assert run(crash_once) == want  # restart: batch 1 runs again from the checkpoint
    # the same file again under another name: every key exists, nothing changes
    shutil.copytree(os.path.join(src, "b001"), os.path.join(src, "b099"))
    assert run(inner) == want


def test_due_is_visible_minus_done(spark):
    from eventpipe.plans.streams import due

    rows = [("old", "2024-01-14 09:00:00"), ("old done", "2024-01-14 09:00:00"), ("now", "2024-01-15 12:00:00"), ("new done", "2024-01-15 11:00:00"), ("later", "2024-01-15 12:00:01")]
    scheduled = spark.createDataFrame(rows, "message_id string, at string").select("message_id", F.to_timestamp_ntz("at").alias("deliver_at"))
    done = spark.createDataFrame([("old done",), ("new done",), ("new done",)], "message_id string")
    got = due(scheduled, done, "2024-01-15 12:00:00")
    assert sorted(r.message_id for r in got.collect()) == ["now", "old"] and got.columns == scheduled.columns


def _messages(spark, rows):
    frame = spark.createDataFrame([(m, v, f"https://v/{m}", 1, at) for m, v, at in rows], "message_id string, venue string, url string, seq long, at string")
    return frame.withColumn("deliver_at", F.to_timestamp_ntz("at"))


def _released(queue):
    return sorted((r.message_id, r.attempt, str(r.released_at)) for r in queue.deliveries().collect())


def test_delay_queue_releases_each_message_once(spark):
    """Each poll is a restart. A message is released at the first poll from its time on, to the microsecond; one published
    twice, also after its release, once; one published when it is due already at once, by the clock as it stands."""
    from eventpipe.streaming.queue import DelayQueue

    queue = DelayQueue(spark, os.path.join(tempfile.mkdtemp(prefix="queue-"), "q"), partitions=2)
    queue.publish(_messages(spark, [("a", "v", "2024-01-01 00:00:15"), ("b", "v", "2024-01-01 00:00:30.000001"), ("c", "w", "2024-01-01 02:00:00"), ("a", "v", "2024-01-01 00:00:15")]))
    first, second = ("a", 1, "2024-01-01 00:00:30"), ("b", 1, "2024-01-01 00:00:31")
    queue.poll("2024-01-01 00:00:30")
    assert _released(queue) == [first]
    queue.publish(_messages(spark, [("late", "v", "2023-01-01 00:00:00"), ("a", "v", "2024-01-01 00:00:15")]))
    queue.poll("2024-01-01 00:00:31")
    late = [r for r in _released(queue) if r[0] == "late"]
    assert _released(queue) == [first, second, *late] and len(late) == 1
    queue.poll("2024-01-01 03:00:00")
    assert _released(queue) == [first, second, ("c", 1, "2024-01-01 03:00:00"), *late]


def test_retry_loop_stores_once_and_keeps_every_attempt(spark):
    from eventpipe.streaming.queue import DelayQueue

    root = tempfile.mkdtemp(prefix="loop-")
    queue = DelayQueue(spark, os.path.join(root, "q"), partitions=2)
    queue.publish(_messages(spark, [("good", "v", "2024-01-01 00:00:00"), ("slow", "v", "2024-01-01 00:00:00"), ("never", "w", "2024-01-01 00:00:00")]))
    store, seen = os.path.join(root, "store"), []
    put = ST.put_if_absent_sink(store, writer="w", order="message_id", base_url=BASE)

    def handle(new):
        seen.extend((r.message_id, r.attempt) for r in new.select("message_id", "attempt").collect())
        ok = (F.col("message_id") == "good") | ((F.col("message_id") == "slow") & (F.col("attempt") == 3))
        return new.withColumns({"ok": ok, "reason": F.when(~ok, F.lit("bad_url"))})

    def sink(done, batch_id):
        put(done.select(F.col("message_id").alias("pathname"), "message_id", F.col("url").alias("body")), batch_id)

    def work(checkpoint="worker"):
        queue.work(handle, 60, max_attempts=3, sink=sink, checkpoint=checkpoint)

    def attempts():
        return sorted((r.message_id, r.attempt, r.ok, str(r.next_at)) for r in queue.attempts().collect())

    for minute in range(4):
        queue.poll(f"2024-01-01 00:0{minute}:00")
        work()
    want = [
        ("good", 1, True, "None"),
        ("never", 1, False, "2024-01-01 00:01:00"), ("never", 2, False, "2024-01-01 00:02:00"), ("never", 3, False, "None"),
        ("slow", 1, False, "2024-01-01 00:01:00"), ("slow", 2, False, "2024-01-01 00:02:00"), ("slow", 3, True, "None"),
    ]
    assert attempts() == want and sorted(seen) == [w[:2] for w in want]
    queue.release("lost")  # all released again
    work("lost")
    assert attempts() == want and sorted(seen) == [w[:2] for w in want]
    assert sorted(r.pathname for r in spark.read.parquet(store).collect()) == ["good", "slow"]


def test_sequenced_log_across_batches(spark):
    """Numbers go on across batches and restarts; a batch that runs again and a replay under another writer change nothing."""
    root = tempfile.mkdtemp(prefix="seq-")
    log = os.path.join(root, "log")
    schema = "run_id string, venue string, url string, pos long, at string"
    batches = [
        [("r1", "v", "u1", 1, "2024-01-01 00:00:00"), ("r1", "v", "u2", 2, "2024-01-01 00:00:00"), ("r1", "w", "u1", 1, "2024-01-01 00:00:00")],
        [("r1", "v", "u2", 3, "2024-01-01 00:00:00"), ("r1", "v", "u3", 4, "2024-01-01 00:00:00"), ("r2", "v", "u1", 1, "2024-01-02 00:00:00")],
        [("r1", "w", "u9", 2, "2024-01-01 00:00:00"), ("r1", "v", "u4", 6, "2024-01-01 00:00:00"), ("r1", "v", "u4", 5, "2024-01-01 00:00:00")],
    ]
    frames = [spark.createDataFrame(b, schema).withColumn("run_ts", F.to_timestamp_ntz("at")).drop("at") for b in batches]

    def rows():
        got = spark.read.schema(ST.LOG_SCHEMA).parquet(log).collect()
        return sorted((r.run_id, r.venue, r.url, r.seq, r.delay_s, str(r.deliver_at)) for r in got)

    sink = ST.sequenced_sink(log, "a", ["pos"])
    for i in (0, 1, 1, 2, 2):
        sink(frames[i], i)
    want = [
        ("r1", "v", "u1", 1, 15, "2024-01-01 00:00:15"), ("r1", "v", "u2", 2, 30, "2024-01-01 00:00:30"), ("r1", "v", "u3", 3, 45, "2024-01-01 00:00:45"),
        ("r1", "v", "u4", 4, 60, "2024-01-01 00:01:00"), ("r1", "w", "u1", 1, 15, "2024-01-01 00:00:15"), ("r1", "w", "u9", 2, 30, "2024-01-01 00:00:30"),
        ("r2", "v", "u1", 1, 15, "2024-01-02 00:00:15"),
    ]
    assert rows() == want
    again = ST.sequenced_sink(log, "b", ["pos"])
    again(frames[0].unionByName(frames[1]).unionByName(frames[2]), 0)
    assert rows() == want


def test_bounded_dedup_drops_a_late_duplicate(spark):
    root = tempfile.mkdtemp(prefix="late-")
    src, out = os.path.join(root, "in"), os.path.join(root, "out")

    def run(name, rows):
        spark.createDataFrame(rows, "url string, at string").select("url", F.to_timestamp("at").alias("at")).coalesce(1).write.parquet(os.path.join(src, name))
        s = spark.readStream.schema("url string, at timestamp").parquet(os.path.join(src, "*"))
        ST.run_to_files(ST.dedup_keys(s, ["url"], event_time="at", delay="1 hour"), out, os.path.join(root, "ck"))
        return sorted(r.url for r in spark.read.parquet(out).collect())

    assert run("b0", [("u1", "2024-01-01 00:00:00"), ("u1", "2024-01-01 00:10:00"), ("u2", "2024-01-05 00:00:00")]) == ["u1", "u2"]
    assert run("b1", [("u1", "2024-01-01 00:20:00"), ("u2", "2024-01-05 00:30:00"), ("u3", "2024-01-05 00:30:00")]) == ["u1", "u2", "u3"]


def test_store_buckets_follow_the_bytes():
    assert [ST.store_buckets(n, 100) for n in (0, 1, 100, 101, 200, 201, 10_000)] == [1, 1, 1, 2, 2, 4, 128]


def test_table_stream_reads_a_file_and_a_folder_of_files(spark):
    """A table of several files lies in a folder of the table's name, beside tables that are one file."""
    import glob
    import shutil

    root = tempfile.mkdtemp(prefix="table-stream-")
    rows = spark.createDataFrame([(i, f"u{i}") for i in range(6)], "page_id long, url string")
    rows.repartition(3).write.parquet(os.path.join(root, "many.parquet"))
    rows.coalesce(1).write.parquet(os.path.join(root, "one"))
    shutil.copy(glob.glob(os.path.join(root, "one", "part-*.parquet"))[0], os.path.join(root, "one.parquet"))
    for name in ("one", "many"):
        out = os.path.join(root, f"out-{name}")
        ST.run_to_files(ST.table_stream(spark, root, name), out, os.path.join(root, f"ck-{name}"))
        assert sorted(r.page_id for r in spark.read.parquet(out).collect()) == list(range(6))


def test_stream_extract_of_a_folder_of_pages(spark):
    from eventpipe.plans.streams import stream_extract

    root = tempfile.mkdtemp(prefix="page-folder-")
    pages = [(1, "https://v/1", '<a href="/2">x</a><a href="/3">y</a>'), (2, "https://v/2", '<a href="/3">z</a>'), (3, "https://w/1", '<a href="https://v/1">x</a>')]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(os.path.join(root, "pages.parquet"))
    got = sorted((r.venue, r.url, r.outcome) for r in stream_extract(spark, root).collect())
    assert got == [("v", "https://v/3", "not_fetched"), ("w", "https://v/1", "fetched")]


def test_a_file_that_arrives_is_read_by_several_tasks(spark):
    """One file, so one micro-batch, but not one row group, which one task would have to read."""
    import glob

    import pyarrow.parquet as pq

    folder = os.path.join(tempfile.mkdtemp(prefix="arrive-"), "in")
    text = F.concat_ws("", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{i}")), 512) for i in range(16)])  # does not compress to nothing
    rows = spark.range(20_000).select(F.col("id").alias("page_id"), text.alias("html"))
    ST.arrive(rows, folder)
    (file,) = glob.glob(os.path.join(folder, "*.parquet"))
    assert pq.ParquetFile(file).num_row_groups >= 4
    read = spark.read.parquet(folder).groupBy(F.spark_partition_id()).count().collect()
    assert len(read) >= 3 and sum(r["count"] for r in read) == 20_000


def test_sink_works_a_batch_out_once(spark, tmp_path):
    """Also where the store exists: the buckets to read are listed from the rows that are added, not by a second run of what made them."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def body(k):
        made.add(1)
        return f"b{k}"

    store = str(tmp_path / "store")
    sink = ST.put_if_absent_sink(store, writer="w", order="seq", base_url=BASE, buckets=4)
    for batch_id, keys in enumerate((range(10), range(5, 20))):
        rows = spark.createDataFrame([(f"{k}.json", k) for k in keys], "pathname string, seq long")
        before = made.value
        sink(rows.withColumn("body", body.asNondeterministic()("seq")), batch_id)
        assert made.value - before == len(keys)
    got = sorted((r.seq, r.body, r.batch_id) for r in spark.read.parquet(store).collect())
    assert got == [(k, f"b{k}", int(k >= 10)) for k in range(20)]
