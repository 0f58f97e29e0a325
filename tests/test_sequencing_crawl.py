"""Sequence numbers without a one-task window, the schedule, dedup and the follow loop."""

import uuid

from pyspark.sql import functions as F

from eventpipe.operators import crawl, sequencing


def test_number_within_equals_row_number_on_skewed_keys(spark):
    # one key holds most rows, so it spans many range partitions
    df = spark.range(0, 5000).select(
        F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 13).cast("string"))).alias("venue"),
        ((F.col("id") * 7919) % 5000).alias("o"),
    )
    fast = sequencing.number_within(df, ["venue"], ["o"], partitions=16)
    plain = sequencing.row_number_within(df, ["venue"], ["o"])
    a = sorted((r.venue, r.o, r.seq) for r in fast.collect())
    b = sorted((r.venue, r.o, r.seq) for r in plain.collect())
    assert a == b
    # the large-key path (no broadcast) gives the same numbers
    c = sorted((r.venue, r.o, r.seq) for r in sequencing.number_within(df, ["venue"], ["o"], partitions=16, broadcast_bytes=0).collect())
    assert c == b


def test_schedule(spark):
    df = spark.createDataFrame([(1,), (2,), (1000,)], "seq long")
    rows = sequencing.with_schedule(df, "2024-01-01 00:00:00").orderBy("seq").collect()
    assert [r.delay_s for r in rows] == [15, 30, 15000]
    assert str(rows[2].deliver_at) == "2024-01-01 04:10:00"


def test_first_seen_and_visited(spark):
    links = spark.createDataFrame(
        [("v", "u1", 1, "p2", 1), ("v", "u1", 1, "p1", 5), ("v", "u2", 2, "p0", 1), ("w", "u1", 1, "p9", 1)],
        "venue string, abs_url string, depth int, src_url string, pos long",
    )
    first = {(r.venue, r.abs_url): (r.src_url, r.pos) for r in crawl.first_seen(links).collect()}
    assert first == {("v", "u1"): ("p1", 5), ("v", "u2"): ("p0", 1), ("w", "u1"): ("p9", 1)}
    visited = spark.createDataFrame([("v", "u1")], "venue string, abs_url string")
    left = crawl.drop_visited(crawl.first_seen(links), visited, ["venue", "abs_url"])
    assert sorted((r.venue, r.abs_url) for r in left.collect()) == [("v", "u2"), ("w", "u1")]


def _graph(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def test_follow_cycle_diamond_depth(spark):
    edges = _graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "e"), ("b", "e"), ("e", "f"), ("f", "g"), ("x", "x")])
    seeds = spark.createDataFrame([("a",)], "node string")
    got = {r.node: r.depth for r in crawl.follow(edges, seeds, max_depth=None).collect()}
    assert got == {"a": 1, "b": 2, "d": 2, "c": 3, "e": 3, "f": 4, "g": 5}
    two = {r.node: r.depth for r in crawl.follow(edges, seeds, max_depth=2).collect()}
    assert two == {"a": 1, "b": 2, "d": 2}
    self_loop = {r.node: r.depth for r in crawl.follow(edges, spark.createDataFrame([("x",)], "node string"), max_depth=None).collect()}
    assert self_loop == {"x": 1}


def test_small_inputs_have_no_window_of_one_task_either(spark):
    df = spark.range(0, 100).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    numbered = sequencing.number_within(df, ["k"], ["o"])
    assert "row_number" not in numbered._jdf.queryExecution().optimizedPlan().toString()
    a = sorted(tuple(r) for r in numbered.collect())
    b = sorted(tuple(r) for r in sequencing.row_number_within(df, ["k"], ["o"]).collect())
    assert a == b


def _urls(spark, names):
    return spark.createDataFrame([(n,) for n in names], "url string")


def test_visited_table_grows_by_what_is_new(spark):
    seen = crawl.VisitedTable(spark, f"visited_{uuid.uuid4().hex}", buckets=4)
    assert seen.buckets() is None and seen.unseen(_urls(spark, ["a"])).count() == 1
    assert sorted(r.url for r in seen.add(_urls(spark, ["a", "b", "a", None])).collect()) == ["a", "b"]
    assert seen.buckets() == 4
    again = crawl.VisitedTable(spark, seen.name)  # a later session's run
    assert sorted(r.url for r in again.add(_urls(spark, ["b", "c", "c"])).collect()) == ["c"]
    files = set(again.read().inputFiles())
    assert again.add(_urls(spark, ["a", "b", "c"])).collect() == [] and set(again.read().inputFiles()) == files
    assert sorted(r.url for r in again.read().collect()) == ["a", "b", "c"]
    other = again.rebucket(f"{seen.name}_more", 7)
    assert other.buckets() == 7 and sorted(r.url for r in other.read().collect()) == ["a", "b", "c"]


def test_visited_urls_are_not_shuffled(spark):
    seen = crawl.VisitedTable(spark, f"visited_{uuid.uuid4().hex}", buckets=8)
    seen.add(spark.range(1000).select(F.col("id").cast("string").alias("url")))
    seen.add(spark.range(500, 2000).select(F.col("id").cast("string").alias("url")))
    left = seen.unseen(spark.range(1990, 2010).select(F.col("id").cast("string").alias("url"), F.lit("x").alias("venue")))
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan and "Broadcast" not in plan
    assert left.count() == 10
