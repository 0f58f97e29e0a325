"""Embedded JSON, strict decode and the MusicEvent document (FIXTURES.md §3, embedded JSON, dates)."""

import json

import pytest
from pyspark.sql import functions as F

from eventpipe.functions import dates as D
from eventpipe.functions.strict_json import decode_one
from eventpipe.operators import extract as X
from eventpipe.specs import ScriptSpec

SPEC = X.NEXT_DATA_SPEC


def page(data_json: str) -> str:
    return f'<html><head><script id="__NEXT_DATA__" type="application/json">{data_json}</script></head></html>'


def wrap(data: dict) -> str:
    return json.dumps({"props": {"pageProps": {"data": data}}})


@pytest.mark.parametrize(
    "text,ok",
    [
        (wrap({"title": "A", "slug": "a", "price": 350, "firstDate": "2026-10-15T20:00:00+02:00"}), True),
        (wrap({"price": 350.5}), False),
        (wrap({"price": 350.0}), False),
        (wrap({"price": "350"}), False),
        (wrap({"price": 3000000000}), True),
        (wrap({"price": 1 << 63}), False),
        (wrap({"title": 5}), False),
        (wrap({"title": None, "slug": None}), True),
        (wrap({"extra": [1, 2], "title": "x"}), True),
        (wrap({"lastDate": "2026-13-01T00:00:00Z", "firstDate": "2026-01-01T00:00:00Z"}), False),
        (wrap({"firstDate": "2026-01-01"}), False),
        (wrap({"firstDate": "2026-02-30T00:00:00Z"}), False),
        ('{"props":{}} trailing', False),
        ("", False),
        ("   ", False),
        ("[]", False),
        ("null", True),
        ('{"props":[]}', False),
        ('{"props":{"pageProps":{"data":{"price":NaN}}}}', False),
    ],
)
def test_strictness(text, ok):
    assert decode_one(text, SPEC)[0] is ok


def test_key_case_and_duplicates():
    ok, _, fields = decode_one('{"props":{"pageProps":{"data":{"Title":"a","title":"b","slug":"s","slug":"t"}}}}', SPEC)
    assert ok and json.loads(fields) == {"title": "b", "slug": "t"}
    ok, _, fields = decode_one('{"PROPS":{"pageprops":{"DATA":{"TITLE":"x"}}}}', SPEC)
    assert ok and json.loads(fields) == {"title": "x"}


def test_script_selection(spark):
    two = page(wrap({"title": "one", "slug": "one"})) + page(wrap({"title": "two", "slug": "two"}))
    html_rows = [
        ("https://v/1", two),
        ("https://v/2", "<html><script>var x=1;</script></html>"),
        ("https://v/3", '<!-- <script id="__NEXT_DATA__">{}</script> -->'),
        ("https://v/4", "<script id='__NEXT_DATA__'>" + wrap({"title": "q"}) + "</script>"),
        ("https://v/5", '<script id="__NEXT_DATA__x">{}</script>'),
    ]
    pages = spark.createDataFrame(html_rows, "url string, html string")
    got = X.embedded_json(pages, ScriptSpec()).orderBy("url", "pos").collect()
    summary = [(r.url, r.pos, None if r.json_text is None else json.loads(r.json_text)["props"]["pageProps"]["data"].get("title")) for r in got]
    assert summary == [
        ("https://v/1", 1, "one"),
        ("https://v/1", 2, "two"),
        ("https://v/2", None, None),
        ("https://v/3", None, None),
        ("https://v/4", 1, "q"),
        ("https://v/5", None, None),
    ]


def test_document_bytes(spark):
    text = wrap({"title": "Rock & <Roll>", "slug": "rock", "price": 350, "firstDate": "2026-10-15T20:00:00.5+02:00", "lastDate": "2026-10-15T23:00:00+02:00"})
    df = spark.createDataFrame([("https://vega.dk/event/rock", text)], "url string, json_text string")
    row = X.with_document(X.with_music_event(X.decode_event_data(df))).collect()[0]
    assert row.pathname == "rock.json"
    expected = (
        '{"@context":"https://schema.org","@type":"MusicEvent","name":"Rock \\u0026 \\u003cRoll\\u003e",'
        '"startDate":"2026-10-15T20:00:00+02:00","location":{"@type":"","name":"","address":{"@type":"",'
        '"streetAddress":"","addressLocality":"","postalCode":"","addressCountry":""}},'
        '"performer":{"@type":"MusicGroup","name":"Rock \\u0026 \\u003cRoll\\u003e"},'
        '"offers":{"@type":"Offer","url":"https://vega.dk/event/rock","price":350,"priceCurrency":"DKK"}}'
    )
    assert row.body == expected


def test_missing_node_gives_empty_event(spark):
    df = spark.createDataFrame([("https://v/e", '{"props":{}}')], "url string, json_text string")
    row = X.with_document(X.with_music_event(X.decode_event_data(df))).collect()[0]
    assert row.json_ok and row.slug == "" and row.pathname == ".json"
    assert row.event["startDate"] == D.ZERO_TIME_TEXT and row.event["offers"]["price"] == 0


@pytest.mark.parametrize(
    "src,want",
    [
        ("2026-10-15T20:00:00+02:00", "2026-10-15T20:00:00+02:00"),
        ("2026-10-15T20:00:00.123456+02:00", "2026-10-15T20:00:00+02:00"),
        ("2026-10-15T18:00:00+00:00", "2026-10-15T18:00:00Z"),
        ("2026-10-15T18:00:00.9Z", "2026-10-15T18:00:00Z"),
        ("2026-10-15T18:00:00-00:00", "2026-10-15T18:00:00Z"),
        (None, "0001-01-01T00:00:00Z"),
    ],
)
def test_start_date_text(spark, src, want):
    df = spark.createDataFrame([(src,)], "t string")
    assert df.select(D.rfc3339_seconds(F.col("t")).alias("x")).first().x == want


def test_extract_outcomes(spark):
    pages = spark.createDataFrame(
        [
            ("https://v/ok", page(wrap({"title": "T", "slug": "t", "price": 1}))),
            ("https://v/bad", page('{"props": 5}')),
            ("https://v/none", "<html></html>"),
            ("https://v/empty", page('{"props":{}}')),
        ],
        "url string, html string",
    )
    urls = ["https://v/ok", "https://v/bad", "https://v/none", "https://v/empty", "https://v/missing", "https://[v/x", ""]
    msgs = spark.createDataFrame([("v", u) for u in urls], "venue string, url string")
    got = {r.url: r.outcome for r in X.extract_events(msgs, pages).collect()}
    assert got == {
        "https://v/ok": "extracted",
        "https://v/bad": "bad_json",
        "https://v/none": "no_script",
        "https://v/empty": "empty_slug",
        "https://v/missing": "not_fetched",
        "https://[v/x": "bad_url",
        "": "not_fetched",
    }


def test_newest_snapshot_of_a_url_decides(spark):
    script = lambda t: page(wrap({"title": t, "slug": t, "price": 1}))
    pages = spark.createDataFrame(
        [(1, "u", script("first"), 5), (2, "u", script("newest"), 7), (3, "u", script("last-written"), 6), (4, "w", script("gone"), 1), (5, "w", None, 2)],
        "page_id long, url string, html string, fetched_at int",
    )
    msgs = spark.createDataFrame([("v", "u"), ("v", "w")], "venue string, url string")
    got = {r.url: (r.outcome, r.slug) for r in X.extract_events(msgs, pages, snapshot_order="fetched_at").collect()}
    assert got == {"u": ("extracted", "newest"), "w": ("no_script", None)}
    assert {r.slug for r in X.extract_events(msgs, pages).collect()} == {"last-written", None}  # by page_id alone


def test_extract_against_bucketed_pages_shuffles_only_messages(spark):
    from eventpipe.sources.tables import write_bucketed_pages

    raw = spark.createDataFrame(
        [(i, f"https://v/{i}", page(wrap({"title": f"T{i}", "slug": f"t{i}", "price": i}))) for i in range(40)],
        "page_id long, url string, html string",
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # inspect the static plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for pages too large to broadcast
    try:
        pages = write_bucketed_pages(raw, "eventpipe_test_pages", 8)
        msgs = spark.createDataFrame([("v", f"https://v/{i}") for i in range(0, 60, 3)], "venue string, url string")
        out = X.extract_events(msgs, pages)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Bucketed: true" in plan, plan
        assert plan.count("Exchange hashpartitioning") == 1, plan  # the messages only
        got = {r.url: r.outcome for r in out.collect()}
        assert sum(v == "extracted" for v in got.values()) == 14 and sum(v == "not_fetched" for v in got.values()) == 6
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_decoder_applies_keys_in_order_and_survives_surrogates():
    from eventpipe.functions.strict_json import decode_fields, valid_rfc3339

    spec = {"venue": "string"}
    assert decode_fields('{"venue":"a","VENUE":"b"}', spec)["venue"] == "b"
    assert decode_fields('{"venue":"a","venue":null}', spec)["venue"] == "a"
    assert not decode_fields('{"venue":5,"venue":"x"}', spec)["ok"]
    assert decode_fields('{"venue":"\\ud800x"}', spec)["venue"] == "�x"
    assert not valid_rfc3339("2024-01-01T00:00:00Z\n") and not valid_rfc3339("２024-01-01T00:00:00Z")


def test_hostile_markup(spark):
    from pyspark.sql import functions as F

    from eventpipe.functions import html as H

    page = (
        '<a title="x > y" href="/one">1</a><a title=" href=/wrong" href="/right">2</a><a href="?a=1&#38;b=2">3</a>'
        '<script id="d">{"t":"a <!-- b --> c"}</script><!-- <script id="d">no</script> -->'
    )
    row = spark.createDataFrame([(page,)], "html string").select(
        H.select_attr(F.col("html"), "a", "href").alias("links"), H.select_text(F.col("html"), "script", "id", "d").alias("texts")
    ).first()
    assert row.links == ["/one", "/right", "?a=1&b=2"]
    assert row.texts == ['{"t":"a <!-- b --> c"}']


def _parts(spark, n):
    one = spark.range(n).coalesce(1)
    return one.select(
        F.when(F.col("id") % 10 > 0, F.col("id")).alias("p_partkey"), F.concat(F.lit("name "), F.col("id").cast("string")).alias("p_name"), F.concat(F.lit("Brand#"), (F.col("id") % 3).cast("string")).alias("p_brand"),
        (F.col("id") % 50).cast("int").alias("p_size"), F.lit(12.5).alias("p_retailprice"),
    )


def test_event_pages_of_one_file_are_written_and_decoded_by_many_tasks(spark):
    """A part is a few bytes and its page many: one file of parts must not be one task; null keys do not gather in one."""
    from eventpipe.sources import derived
    from eventpipe.sources.tables import SPREAD_ROWS

    n = 4 * SPREAD_ROWS
    decoded = X.decode_event_data(X.embedded_json(derived.part_event_pages(_parts(spark, n))))
    sizes = [r["count"] for r in decoded.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and len(sizes) == 4 and max(sizes) < 1.2 * SPREAD_ROWS


def test_spread_keeps_every_row(spark):
    from eventpipe.sources.tables import spread

    rows = [(1, "a"), (1, "a"), (None, "a"), (None, None), (2, "b")]
    for given in (rows, []):
        df = spark.createDataFrame(given, "k long, v string")
        assert sorted(map(str, spread(df, ["k", "v"], 2).collect())) == sorted(map(str, df.collect()))


def test_pages_are_never_broadcast(spark):
    """Parts are so short that the planner takes the pages written from them for a small table."""
    from eventpipe.plans.errors import SHAPES
    from eventpipe.sources import derived

    part = _parts(spark, 50)
    messages, pages = derived.part_extract_messages(part), derived.part_snapshots(part)
    for out in (X.extract_events(messages, pages, snapshot_order="fetched_at"), X.extract_by_spec(messages, pages, list(SHAPES), "fetched_at")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, plan


def test_newest_snapshots_lie_in_as_many_partitions_as_their_text_asks_for(spark, monkeypatch):
    """Not in as many as the session's shuffles have, and a URL that holds most rows is cut down by each task before its rows meet."""
    from eventpipe.sources import tables

    hot = [(i, "hot", f"text {i}" if i % 7 else None, i % 5) for i in range(400)] + [(399, "hot", "text 399", 4)]
    rest = [(i, f"u{i % 60}", f"text {i}", None if i % 3 else i % 4) for i in range(200)]
    pages = spark.createDataFrame(hot + rest, "page_id long, url string, html string, fetched_at int").repartition(6)
    monkeypatch.setattr(tables, "TEXT_PARTITION_BYTES", 200)
    n = tables.text_partitions(pages, "html")
    assert n == -(-sum(len(r.html or "") for r in pages.collect()) // 200) > 8
    for order in ("fetched_at", None):
        got = X.newest_snapshot(pages, order, n)
        assert got.rdd.getNumPartitions() == n
        assert sorted(map(str, got.collect())) == sorted(map(str, X.newest_snapshot(pages, order).collect()))
    out = X.extract_events(pages.select("url").distinct().withColumn("venue", F.lit("v")), pages, partitions=n)
    assert f", {n})" in out._jdf.queryExecution().executedPlan().toString()


def test_list_responses_are_written_where_their_parts_lie(spark, tmp_path):
    """A page's parts meet before documents are made of them: the documents are not shuffled, and no one task makes them all."""
    from eventpipe.plans import store as plans

    _parts(spark, 500).write.parquet(str(tmp_path / "part.parquet"))
    out = plans._responses(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan, plan
    assert out.count() == 6  # of 100 keys each, and one of the null keys
