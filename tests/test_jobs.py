"""Venue specs as the extension surface: scrape and extract runs."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from eventpipe import jobs
from eventpipe.operators import crawl
from eventpipe.specs import DEFAULT_VENUES, find_venue

SITE = {
    "https://vega.dk": '<a data-theme="secondary" href="/event/a">a</a><a data-theme="secondary" href="https://vega.dk/event/b#x">b</a>'
                       '<a href="/about">about</a><a data-theme="secondary" href="https://tickets.example.com/t">off-host</a>',
    "https://vega.dk/event/a": '<a data-theme="secondary" href="/event/c">c</a><a data-theme="secondary" href="/event/b">b again</a>'
                               '<script id="__NEXT_DATA__">' + json.dumps({"props": {"pageProps": {"data": {"title": "A", "slug": "a", "price": 100, "firstDate": "2026-05-01T20:00:00+02:00"}}}}) + "</script>",
    "https://vega.dk/event/b": '<script id="__NEXT_DATA__">{"props":{"pageProps":{"data":{"title":"B","price":1.5}}}}</script>',
    "https://vega.dk/event/c": '<a data-theme="secondary" href="/event/a">back</a>',
}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(SITE.items())], "page_id long, url string, html string")


def test_scrape_depth_one(spark, pages):
    msgs = jobs.scrape(pages, find_venue("vega"), "2026-01-01 00:00:00", max_depth=1).orderBy("seq").collect()
    assert [(m.url, m.seq, m.delay_s) for m in msgs] == [
        ("https://vega.dk/event/a", 1, 15),
        ("https://vega.dk/event/b", 2, 30),
        ("https://tickets.example.com/t", 3, 45),
    ]
    assert msgs[0].body == '{"venue":"vega","url":"https://vega.dk/event/a"}'


def test_scrape_follows_on_host_only(spark, pages):
    msgs = jobs.scrape(pages, find_venue("vega"), "2026-01-01 00:00:00", publish_scope="host", max_depth=None)
    assert sorted(m.url for m in msgs.collect()) == ["https://vega.dk/event/a", "https://vega.dk/event/b", "https://vega.dk/event/c"]


def test_all_venues_in_one_run(spark, pages):
    from eventpipe.specs import LinkSpec

    more = spark.createDataFrame(
        [(50, "https://b.example.com/", '<a href="/x">x</a><a name="n">no href</a>'), (51, "https://b.example.com/x", '<a href="https://vega.dk">home</a>'),
         (52, "https://nobody.example.com/", '<a href="/y">y</a>')],
        "page_id long, url string, html string",
    )
    registry = spark.createDataFrame(
        [("vega", "vega.dk", "https://vega.dk", 0), ("b", "b.example.com", "https://b.example.com/", 1), ("stub", "richter-gladsaxe.dk", "https://richter-gladsaxe.dk", None)],
        jobs.REGISTRY_SCHEMA,
    )
    messages, errors = jobs.scrape_all(pages.unionByName(more), registry, [find_venue("vega").links, LinkSpec()], "2026-01-01 00:00:00")
    got = sorted((m.venue, m.seq, m.url) for m in messages.collect())
    alone = jobs.scrape(pages, find_venue("vega"), "2026-01-01 00:00:00")
    assert [g for g in got if g[0] == "vega"] == sorted((m.venue, m.seq, m.url) for m in alone.collect())
    assert [g for g in got if g[0] != "vega"] == [("b", 1, "https://b.example.com/x"), ("b", 2, "https://vega.dk")]
    assert [tuple(e) for e in errors.collect()] == [("b", "links", "https://b.example.com/", 2, "missing_href")]


def test_visited_pages_are_neither_published_nor_followed(spark, pages):
    visited = spark.createDataFrame([("https://vega.dk/event/a",)], "url string")
    got = jobs.scrape(pages, find_venue("vega"), "2026-01-01 00:00:00", visited=visited).collect()
    assert sorted(m.url for m in got) == ["https://tickets.example.com/t", "https://vega.dk/event/b"]


def test_a_second_run_publishes_only_new_urls(spark, pages, tmp_path):
    vega = find_venue("vega")
    registry = spark.createDataFrame([(vega.name, vega.host, vega.seed_url, 0)], jobs.REGISTRY_SCHEMA)
    seen = crawl.VisitedTable(spark, f"visited_{uuid.uuid4().hex}")
    run = lambda snapshots: jobs.scrape_to_log(snapshots, registry, [vega.links], "2026-01-01 00:00:00", seen, "event-extract", str(tmp_path))[0]
    first = sorted(r.url for r in run(pages).collect())
    assert first and run(pages).collect() == []
    log = spark.read.parquet(str(tmp_path))
    assert sorted(r.url for r in log.collect()) == first == sorted(r.url for r in seen.read().collect())


def test_stub_venue_yields_nothing(spark, pages):
    assert jobs.scrape(pages, find_venue("richter"), "2026-01-01 00:00:00").count() == 0


def test_unknown_venue_is_an_error():
    with pytest.raises(KeyError):
        find_venue("nowhere")
    assert [v.name for v in DEFAULT_VENUES] == ["richter", "vega"]


def test_extract_run(spark, pages):
    msgs = spark.createDataFrame([("vega", "https://vega.dk/event/a"), ("vega", "https://vega.dk/event/b"), ("vega", "https://vega.dk/event/c"), ("vega", "https://vega.dk/gone")], "venue string, url string")
    rows = {r.url: r for r in jobs.extract(msgs, pages, find_venue("vega")).collect()}
    assert {u: r.outcome for u, r in rows.items()} == {
        "https://vega.dk/event/a": "extracted",
        "https://vega.dk/event/b": "bad_json",
        "https://vega.dk/event/c": "no_script",
        "https://vega.dk/gone": "not_fetched",
    }
    assert rows["https://vega.dk/event/a"].pathname == "a.json"
    assert rows["https://vega.dk/event/a"].event["offers"]["price"] == 100


def test_venue_post_step(spark, pages):
    from dataclasses import replace

    from pyspark.sql import functions as F

    spec = replace(find_venue("vega"), post=lambda df: df.withColumn("venue_note", F.lit("checked")))
    msgs = spark.createDataFrame([("vega", "https://vega.dk/event/a")], "venue string, url string")
    assert jobs.extract(msgs, pages, spec).first().venue_note == "checked"


def test_bounded_broadcast(spark):
    from eventpipe.operators.joins import bounded_broadcast

    small = spark.range(10)
    big = spark.range(100)
    assert "BroadcastExchange" in small.join(bounded_broadcast(small, 10), "id")._jdf.queryExecution().executedPlan().toString()
    plan = spark.range(1000).join(bounded_broadcast(big, 50), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower()


def test_seed_is_marked_visited_as_given(spark):
    """The seed string is visited exactly as written: with the seed ``https://vega.dk``, a
    link to ``https://vega.dk/`` is a new URL (the reference compares strings)."""
    site = spark.createDataFrame(
        [(1, "https://vega.dk", '<a data-theme="secondary" href="https://vega.dk/">home</a>'
                                '<a data-theme="secondary" href="https://vega.dk">self</a>')],
        "page_id long, url string, html string",
    )
    urls = [m.url for m in jobs.scrape(site, find_venue("vega"), "2026-01-01 00:00:00").collect()]
    assert urls == ["https://vega.dk/"]


def test_extract_all_reads_each_venue_by_its_spec(spark):
    from eventpipe import jobs
    from eventpipe.specs import JsonSpec, ScriptSpec, VenueSpec

    specs = [
        VenueSpec("next", "https://n", script=ScriptSpec()),
        VenueSpec("flat", "https://f", script=ScriptSpec(value="d"), currency="EUR", data=JsonSpec((), (("title", "name"), ("slug", "id"), ("firstDate", "at")))),
        VenueSpec("silent", "https://s"),
    ]
    data = '{"title":"T","slug":"t","price":7,"firstDate":"2024-01-01T10:00:00Z"}'
    nested = '<script id="__NEXT_DATA__">{"props":{"pageProps":{"data":%s}}}</script>' % data
    flat = '<script id="d">{"name":"N","id":"n","price":9,"at":"2024-01-01T10:00:00+00:00"}</script>'
    pages = spark.createDataFrame([(1, "https://n/1", nested), (2, "https://f/1", flat), (3, "https://f/2", nested), (4, "https://f/3", '<script id="d">{"id":1}</script>')], "page_id long, url string, html string")
    rows = [("next", "https://n/1"), ("flat", "https://f/1"), ("flat", "https://f/2"), ("flat", "https://f/3"), ("flat", "https://f/4"), ("silent", "https://n/1"), ("who", "https://n/1"), ("flat", "https://[f")]
    out = jobs.extract_all(spark.createDataFrame(rows, "venue string, url string"), pages, specs).collect()
    got = {(r.venue, r.url): (r.outcome, r.pathname if r.outcome == "extracted" else None) for r in out}
    assert got == {
        rows[0]: ("extracted", "t.json"), rows[1]: ("extracted", "n.json"), rows[2]: ("no_script", None), rows[3]: ("bad_json", None),
        rows[4]: ("not_fetched", None), rows[5]: ("unknown_venue", None), rows[6]: ("unknown_venue", None), rows[7]: ("bad_url", None),
    }
    body = {r.venue: r.body for r in out if r.outcome == "extracted"}
    assert '"price":0,"priceCurrency":"EUR"' in body["flat"] and '"price":7,"priceCurrency":"DKK"' in body["next"] and '"startDate":"2024-01-01T10:00:00Z"' in body["flat"]


def test_route_counts_in_the_pass_that_writes(spark, tmp_path):
    from eventpipe import jobs
    from eventpipe.operators import routing as R
    from eventpipe.specs import VenueSpec

    bodies = ['{"venue":"v","url":"a"}'] * 3 + ['{"venue":"w","url":"b"}', '{"venue":"x","url":"c"}', "no", None, '{"venue": "v"}', '{"venue":null}']
    messages = spark.createDataFrame(list(enumerate(bodies)), "message_id int, body string").repartition(3)
    specs = [VenueSpec("v", "https://v"), VenueSpec("w", "https://w"), VenueSpec("none/such", "https://n")]
    counts = jobs.route(messages, specs, str(tmp_path / "routed"))
    assert counts == {("v", "accepted"): 4, ("w", "accepted"): 1, ("", "unknown_venue"): 2, ("", "malformed"): 2}
    stored = {(r.venue if r.venue in ("v", "w") else "", r.outcome): 0 for r in spark.read.parquet(str(tmp_path / "routed")).select("venue", "outcome").collect()}
    for r in R.run_metrics(spark.read.parquet(str(tmp_path / "routed"))).collect():
        stored[r.venue if r.venue in ("v", "w") else "", r.outcome] += r.n
    assert stored == counts

