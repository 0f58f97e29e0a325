"""Store protocol: put-if-absent, overwrite, suffix, paging and delete (FIXTURES.md §3, store, paging)."""

import os
import tempfile

from hypothesis import given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from eventpipe.operators import store as ST
from eventpipe.operators.event_store import EventStore

BASE = "https://objects.example.com/"
DOC = "pathname string, seq long, body string"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


def test_put_if_absent_cases(spark):
    stored = docs(spark, [("old.json", 0, "{}")])
    incoming = docs(spark, [("old.json", 1, "a"), ("new.json", 2, "b"), ("new.json", 3, "c"), ("", 4, "d")])
    acc, rej = ST.put_if_absent(stored, incoming, order="seq")
    assert sorted((r.pathname, r.seq) for r in acc.collect()) == [("", 4), ("new.json", 2)]
    assert sorted((r.pathname, r.seq, r.reason) for r in rej.collect()) == [
        ("new.json", 3, "duplicate_in_batch"),
        ("old.json", 1, "exists"),
    ]


@settings(max_examples=8, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from(["a", "b", "c", "d", "e"]), st.integers(0, 10_000)), min_size=1, max_size=40, unique_by=lambda t: t[1]),
    st.integers(1, 6),
)
def test_put_if_absent_independent_of_partitioning(spark, rows, parts):
    """Same accepted rows under any partitioning and input order: first (lowest seq) wins."""
    inc = docs(spark, [(k + ".json", s, f"b{s}") for k, s in rows])
    stored = docs(spark, [("a.json", -1, "x")])
    acc, _ = ST.put_if_absent(stored, inc.repartition(parts), order="seq")
    got = sorted((r.pathname, r.seq) for r in acc.collect())
    want = {}
    for k, s in rows:
        if k != "a":
            want[k + ".json"] = min(s, want.get(k + ".json", s))
    assert got == sorted(want.items())


def test_overwrite_and_suffix(spark):
    stored = docs(spark, [("x.json", 0, "old"), ("y.json", 0, "keep")])
    incoming = docs(spark, [("x.json", 5, "new1"), ("x.json", 7, "new2")])
    after = {r.pathname: r.body for r in ST.put_overwrite(stored, incoming, order="seq").collect()}
    assert after == {"x.json": "new2", "y.json": "keep"}
    sfx = incoming.select(ST.with_suffix(F.col("pathname"), F.col("seq")).alias("p")).collect()
    names = [r.p for r in sfx]
    assert len(set(names)) == 2 and all(n.startswith("x-") and n.endswith(".json") for n in names)
    again = incoming.select(ST.with_suffix(F.col("pathname"), F.col("seq")).alias("p")).collect()
    assert names == [r.p for r in again]


def test_metadata(spark):
    rows = ST.object_rows(docs(spark, [("a.json", 1, "é")]), BASE, cache_max_age=0).first()
    assert rows.url == BASE + "a.json" and rows.download_url == BASE + "a.json?download=1"
    assert rows.access == "public" and rows.content_type == "application/json" and rows.cache_control_max_age is None
    assert rows.size == 2 and len(rows.etag) == 32
    priv = ST.object_rows(docs(spark, [("a.txt", 1, "x")]), BASE, access="private", cache_max_age=60).first()
    assert priv.access == "private" and priv.content_type == "text/plain" and priv.cache_control_max_age == 60


@settings(max_examples=5, deadline=None)
@given(st.integers(1, 12))
def test_paging_returns_each_key_once(spark, limit):
    keys = [f"k{i:03d}.json" for i in range(37)]
    table = docs(spark, [(k, i, "b") for i, k in enumerate(keys)])
    seen, cursor = [], ""
    while True:
        page = ST.list_objects(table, limit=limit, cursor=cursor).collect()
        seen += [r.pathname for r in page]
        if not page or not page[0].has_more:
            break
        cursor = page[0].next_cursor
    assert seen == keys


def test_paging_edges(spark):
    table = docs(spark, [(f"p{i}", i, "b") for i in range(5)])
    exact = ST.list_objects(table, limit=5).collect()
    assert len(exact) == 5 and not exact[0].has_more and exact[0].next_cursor == ""
    more = ST.list_objects(table, limit=4).collect()
    assert len(more) == 4 and more[0].has_more and more[0].next_cursor == "p3"
    assert ST.list_objects(table, limit=5, cursor="p4").count() == 0
    assert ST.list_objects(table, prefix="p1").count() == 1
    assert ST.list_objects(table, limit=0).count() == 5


def test_delete_by_pathname_or_url(spark):
    table = ST.object_rows(docs(spark, [("a.json", 1, "x"), ("b.json", 2, "y"), ("c.json", 3, "z")]), BASE)
    keys = spark.createDataFrame([("a.json",), (BASE + "b.json",), ("unknown",)], "key string")
    assert sorted(r.pathname for r in ST.delete_keys(table, keys, BASE).collect()) == ["c.json"]
    assert ST.delete_keys(table, keys.limit(0), BASE).count() == 3


def test_listing_response(spark):
    resp = spark.createDataFrame(
        [('{"blobs":[{"url":"u","downloadUrl":"d","pathname":"a","size":3,"uploadedAt":"2024-04-05T19:12:36.679Z","etag":"e"},'
          '{"pathname":"b","uploadedAt":"yesterday"}],"cursor":"b","hasMore":true}',), ('{"blobs":[],"hasMore":false}',)],
        "response string",
    )
    rows = {r.pathname: r for r in ST.explode_listing(resp).collect()}
    assert rows["a"].uploaded_ms == 1712344356679 and rows["b"].uploaded_ms is None and rows["a"].has_more
    assert set(rows) == {"a", "b"}  # an empty page holds no object
    bad = ST.explode_listing(spark.createDataFrame([("not json",), ('{"blobs":[{"pathname":"a"}]}',), ('{"blobs":[{"pa',), (None,)], "response string"))
    assert sorted((str(r.pathname), r.reason) for r in bad.collect()) == [("None", "malformed")] * 3 + [("a", None)]


def test_event_store_replay_and_versions(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="store-"), "events")
    store = EventStore(spark, path, BASE)
    batch = docs(spark, [("a.json", 1, "a1"), ("b.json", 2, "b1"), ("a.json", 3, "a2")])
    written, rejected = store.put(batch, order="seq", writer="w", batch_id=0)
    assert written.count() == 2 and rejected.count() == 1
    store.put(batch, order="seq", writer="w", batch_id=0)  # replay: same rows
    assert sorted((r.pathname, r.body) for r in store.read().collect()) == [("a.json", "a1"), ("b.json", "b1")]
    store.put(docs(spark, [("a.json", 9, "a9"), ("c.json", 10, "c")]), order="seq", writer="w", batch_id=1)
    assert sorted((r.pathname, r.body) for r in store.read().collect()) == [("a.json", "a1"), ("b.json", "b1"), ("c.json", "c")]
    store.put(docs(spark, [("a.json", 11, "a11")]), order="seq", overwrite=True, writer="w", batch_id=2)
    assert sorted((r.pathname, r.body) for r in store.read().collect()) == [("a.json", "a11"), ("b.json", "b1"), ("c.json", "c")]
    store.delete(spark.createDataFrame([(BASE + "b.json",)], "key string"))
    assert sorted(r.pathname for r in store.read().collect()) == ["a.json", "c.json"]
    assert [r.pathname for r in store.list(limit=1).collect()] == ["a.json"]
    got = {r.pathname: r.found for r in store.get(spark.createDataFrame([("c.json",), ("zz.json",)], "pathname string")).collect()}
    assert got == {"c.json": True, "zz.json": False}


def files(store):
    return {f for f in store._table().inputFiles()}


def test_event_store_rewrites_only_the_buckets_it_touches(spark):
    store = EventStore(spark, os.path.join(tempfile.mkdtemp(prefix="store-"), "events"), BASE, buckets=8)
    store.put(docs(spark, [(f"k{i}.json", i, f"b{i}") for i in range(60)]), order="seq")
    before = files(store)
    store.put(docs(spark, [("k7.json", 99, "new")]), order="seq", overwrite=True)
    changed = {f.split("/bucket=")[1].split("/")[0] for f in before ^ files(store)}
    assert store.buckets() == 8 and len(changed) == 1
    assert {r.pathname: r.body for r in store.read().collect()} == {f"k{i}.json": "new" if i == 7 else f"b{i}" for i in range(60)}
    before = files(store)
    store.delete(spark.createDataFrame([("k3.json",)], "key string"))
    assert len({f.split("/bucket=")[1].split("/")[0] for f in before ^ files(store)}) == 1
    store.delete(spark.createDataFrame([(f"k{i}.json",) for i in range(59)], "key string"))  # most buckets are empty now
    assert [r.pathname for r in store.read().collect()] == ["k59.json"]
    store.put(docs(spark, [(f"k{i}.json", i, f"c{i}") for i in range(60)]), order="seq")
    assert store.read().count() == 60 and store.read().where("pathname = 'k59.json'").first().body == "b59"
    other = store.rebucket(store.path + "-3", 3)
    assert other.buckets() == 3 and other.read().exceptAll(store.read()).isEmpty() and other.read().count() == 60


def test_event_store_after_a_put_that_died(spark):
    """Before its commit it has left nothing, after it whole rows; the next put stores no key twice."""

    class Dying(EventStore):
        def _append(self, rows, n):
            if self.after:
                super()._append(rows, n)
            raise RuntimeError("driver lost")

    for after in (False, True):
        path = os.path.join(tempfile.mkdtemp(prefix="store-"), "events")
        dying = Dying(spark, path, BASE)
        dying.after = after
        with pytest.raises(RuntimeError, match="driver lost"):
            dying.put(docs(spark, [("a.json", 1, "first")]), order="seq")
        store = EventStore(spark, path, BASE)
        store.put(docs(spark, [("a.json", 1, "second"), ("b.json", 2, "b")]), order="seq")
        assert sorted((r.pathname, r.body) for r in store.read().collect()) == [("a.json", "first" if after else "second"), ("b.json", "b")]


def test_event_store_keeps_what_is_stored(spark):
    store = EventStore(spark, os.path.join(tempfile.mkdtemp(prefix="store-"), "events"), BASE)
    store.put(docs(spark, [("a.json", 1, "a1"), ("b.json", 2, "b1")]), order="seq")
    _, rejected = store.put(docs(spark, [("a.json", 1, "other"), ("c.json", 2, "c1")]), order="seq")
    assert [(r.pathname, r.reason) for r in rejected.collect()] == [("a.json", "exists")]
    assert sorted((r.pathname, r.body) for r in store.read().collect()) == [("a.json", "a1"), ("b.json", "b1"), ("c.json", "c1")]
    store.put(docs(spark, [("d.json", 1, "d1")]), order="seq", writer="w", batch_id=7)
    store.put(docs(spark, [("d.json", 1, "d1")]), order="seq", writer="w", batch_id=7)  # a retry
    with pytest.raises(ValueError, match="other content"):
        store.put(docs(spark, [("e.json", 1, "e1")]), order="seq", writer="w", batch_id=7)
    assert store.read().count() == 4
    for _ in range(2):  # the same name and row key in two puts
        store.put(docs(spark, [("s.json", 1, "s")]), order="seq", add_random_suffix=True)
    assert store.read().where("pathname like 's-%'").count() == 2
    before = files(store)
    store.delete(spark.createDataFrame([], "key string"))
    store.delete(spark.createDataFrame([("unknown",)], "key string"))
    assert files(store) == before
    moved = EventStore(spark, store.path, "https://new.example.com/")
    moved.delete(spark.createDataFrame([(BASE + "a.json",)], "key string"))
    assert store.read().where("pathname = 'a.json'").count() == 0


def test_checkpoint_folder_is_asked_for_on_a_cluster(monkeypatch):
    from eventpipe import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.ensure_checkpoint_dir(Session())


def _ranges(spark, path, n=1000, files=20):
    rows = spark.range(n).select(F.format_string("k%04d", "id").alias("pathname"), F.col("id").alias("size"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(files))
    try:
        return ST.KeyRanges.write(rows, path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_page_opens_the_files_it_needs(spark, tmp_path):
    store = _ranges(spark, str(tmp_path / "objects"))
    assert len(store.read().inputFiles()) > 10 and store.read().count() == 1000
    page = store.page(limit=5, cursor="k0500")
    assert [r.pathname for r in page.orderBy("pathname").collect()] == [f"k{i:04d}" for i in range(501, 506)]
    assert len(store.files(limit=5, cursor="k0500")) <= 2
    assert len(store.files(limit=5)) == 1
    assert store.files(cursor="k0999") == [] and store.page(cursor="k0999").collect() == []
    assert store.files("x") == [] and store.files("a") == []


@pytest.mark.parametrize("limit", [1, 7, 60, 400, 2000])
@pytest.mark.parametrize(("prefix", "cursor"), [("", ""), ("k03", ""), ("k03", "k0377"), ("k", "k0098"), ("", "k0998"), ("k03", "k1"), ("k0999", ""), ("k03", "a")])
def test_pages_of_key_ranges_equal_pages_of_the_whole(spark, tmp_path_factory, limit, prefix, cursor):
    if not hasattr(spark, "_key_ranges"):
        spark._key_ranges = _ranges(spark, str(tmp_path_factory.mktemp("ranges") / "objects"))
    store = spark._key_ranges
    whole = ST.list_objects(store.read(), prefix, limit, cursor)
    assert sorted(store.page(prefix, limit, cursor).collect()) == sorted(whole.collect())


def test_key_ranges_of_nothing(spark, tmp_path):
    store = ST.KeyRanges.write(spark.createDataFrame([], "pathname string, size long"), str(tmp_path / "none"))
    assert store.files() == [] and store.page().collect() == [] and store.read().collect() == []
