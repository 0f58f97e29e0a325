"""Link selection and resolution on hand-made pages (FIXTURES.md §3, links)."""

import pytest
from pyspark.sql import functions as F

from eventpipe.functions import urls as U
from eventpipe.operators import links
from eventpipe.operators.html_exact import extract_links_exact, links_of
from eventpipe.specs import LinkSpec

PAGE = """<html><head><script>var s = '<a href="/in-script">x</a>';</script>
<style>a[href="/in-style"]{}</style></head><body>
<a href="/double">d</a><a href='/single'>s</a><a href=/bare>b</a>
<A HREF="/UPPER">u</A><a class="x" href="/q?a=1&amp;b=2">amp</a>
<!-- <a href="/in-comment">c</a> -->
<a name="no-href">n</a><a href="">empty</a><a href="#frag">f</a>
<a href="rel/page">r</a><a href="//other.example.org/x">h</a><a href="mailto:a@b.c">m</a>
<a data-href="/not-this" href="/this">t</a>
</body></html>"""

BASE = "https://venue.example.com/dir/page.html#top"


def _links(spark, html=PAGE, base=BASE, spec=LinkSpec()):
    pages = spark.createDataFrame([(1, base, html)], "page_id long, url string, html string")
    return links.resolve_links(links.extract_links(pages, spec)).orderBy("pos").collect()


def test_selection_skips_comments_scripts_styles(spark):
    hrefs = [r.href for r in _links(spark)]
    assert hrefs == [
        "/double", "/single", "/bare", "/UPPER", "/q?a=1&b=2", None, "", "#frag",
        "rel/page", "//other.example.org/x", "mailto:a@b.c", "/this",
    ]


def test_regex_path_equals_exact_parser(spark):
    native = [r.href for r in _links(spark)]
    assert native == links_of(PAGE, LinkSpec())
    pages = spark.createDataFrame([(1, BASE, PAGE)], "page_id long, url string, html string")
    exact = [r.href for r in extract_links_exact(pages).orderBy("pos").collect()]
    assert exact == native


BROKEN = {
    "tag": "<a " + "x" * (1 << 20),
    "attributes": "<a " + "x " * (1 << 19),
    "tags": "<a " * (1 << 18),
    "quotes": "<a x " * (1 << 17) + '">',
    "values": '<a x="' * (1 << 17),
    "comments": "<!--" * (1 << 18),
    "scripts": "<script " * (1 << 17),
    "signs": "<" * (1 << 20),
}


@pytest.mark.parametrize("name", sorted(BROKEN))
def test_a_megabyte_without_an_end(spark, name):
    """A recursive or backtracking pattern ends the executor or never ends here."""
    hrefs = [r.href for r in _links(spark, '<a href="/ok">' + BROKEN[name])]
    assert hrefs[0] == "/ok" and not any(hrefs[1:])


def test_a_long_tag_and_many_references(spark):
    html = "<a " + "x=1 " * (1 << 18) + "href=/last>" + '<a href="' + "&amp;" * 50_000 + '">'
    assert [r.href for r in _links(spark, html)] == ["/last", "&" * 50_000]


REFERENCES = {
    "&aring;&#229;&#xE5;&#XE5;": "\u00e5" * 4, "&#38;amp;": "&amp;", "&amp;lt;": "&lt;", "a&copy=1": "a&copy=1", "a&copy": "a\u00a9",
    "&copyx;": "&copyx;", "&none;": "&none;", "&": "&", "&&amp;": "&&", "&#0;&#xD800;&#x110000;&#99999999999;": "\ufffd" * 4, "&#128;&#150;": "\u20ac\u2013",
    "&NotEqualTilde;": "\u2242\u0338", "&#x1F600;": "\U0001f600", "&#12a;": "\x0ca;", "&nbsp;x": "\xa0x",
}


def test_references_are_decoded_once(spark):
    html = "".join(f'<a href="/{k}">' for k in REFERENCES)
    assert [r.href for r in _links(spark, html)] == ["/" + v for v in REFERENCES.values()]


def test_broken_pages_equal_an_independent_parser(spark):
    import random
    import re

    rng = random.Random(3)
    parts = ['<a href="/x">', "<a href='/y' title=z>", "<a ", "href=/q", ">", '"', "'", " ", "=", "<!--", "-->", "<script>", "</script>", "<style a=b>", "</style>", "text",
             "<b>", "</a>", "<A HREF=/U>", "&amp;", '<a title="<a href=/no>" href="/in">', "/", '<a href="/s"/>', '<a href="/1"href="/2">']
    pages = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    pages = [p for p in pages if "<!-->" not in p and "<!--" not in re.sub(r"(?s)<!--.*?-->", "", p)]  # the standard parser reads on in an open comment
    frame = spark.createDataFrame([(i, BASE, p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {}
    for r in links.extract_links(frame).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append(r.href)
    wrong = [(p, got.get(i, []), links_of(p, LinkSpec())) for i, p in enumerate(pages) if got.get(i, []) != links_of(p, LinkSpec())]
    assert len(pages) > 700 and not wrong, wrong[:3]


def test_resolution(spark):
    rows = {r.href: (r.status, r.abs_url) for r in _links(spark)}
    assert rows["/double"] == ("ok", "https://venue.example.com/double")
    assert rows["rel/page"] == ("ok", "https://venue.example.com/dir/rel/page")
    assert rows["//other.example.org/x"] == ("ok", "https://other.example.org/x")
    assert rows["mailto:a@b.c"] == ("ok", "mailto:a@b.c")
    assert rows["#frag"] == ("fragment_only", None)
    assert rows[""] == ("empty_href", "https://venue.example.com/dir/page.html")
    assert rows[None] == ("missing_href", None)
    assert rows["/q?a=1&b=2"][1] == "https://venue.example.com/q?a=1&b=2"


@pytest.mark.parametrize(
    "base,want",
    [
        ('<base href="/shop/">', "https://venue.example.com/shop/rel"),
        ('<base target="_top"><BASE HREF="https://other.example.org/x/y.html">', "https://other.example.org/x/rel"),
        ('<!-- <base href="/no/"> --><script>"<base href=/no/>"</script>', "https://venue.example.com/dir/rel"),
        ('<base href="#top">', "https://venue.example.com/dir/rel"),
        ("<basefont href='/no/'>", "https://venue.example.com/dir/rel"),
    ],
)
def test_links_are_relative_to_the_declared_base(spark, base, want):
    pages = spark.createDataFrame([(1, BASE, f"<head>{base}</head><a href='rel'>r</a><a href='?q'>q</a>")], "page_id long, url string, html string")
    rows = links.with_link_host(links.resolve_links(links.extract_links(pages))).orderBy("pos").collect()
    assert rows[0].abs_url == want and rows[0].host == want.split("/")[2] == rows[1].host


def test_attribute_selector(spark):
    html = '<div><a data-theme="secondary" href="/e/1">1</a><a data-theme="primary" href="/e/2">2</a>' \
           "<span data-theme='secondary' href='/e/3'>3</span></div>"
    spec = LinkSpec(tag="[^\\s>]+", attr="data-theme", value="secondary")
    got = [r.href for r in _links(spark, html, spec=spec)]
    assert got == ["/e/1", "/e/3"]
    assert links_of(html, LinkSpec(tag="*", attr="data-theme", value="secondary")) == ["/e/1", "/e/3"]


def test_url_functions(spark):
    cases = [
        ("https://Venue.Example.com:8443/a", "/b/../c/./d", "https://Venue.Example.com:8443/c/d", "Venue.Example.com"),
        ("https://h.example.com/a/b/", "../../../x", "https://h.example.com/x", "h.example.com"),
        ("https://h.example.com", "x", "https://h.example.com/x", "h.example.com"),
        ("https://h.example.com/a", "/èê ü", "https://h.example.com/%C3%A8%C3%AA%20%C3%BC", "h.example.com"),
        ("https://h.example.com/a?q=1", "?z=2#f", "https://h.example.com/a?z=2", "h.example.com"),
        ("http://[::1]:80/a", "b/", "http://[::1]:80/b/", "::1"),
        ("https://u:p@h.example.com/", "/", "https://u:p@h.example.com/", "h.example.com"),
        ("https://h.example.com/a/b", "..", "https://h.example.com/", "h.example.com"),
    ]
    df = spark.createDataFrame([(b, r) for b, r, _, _ in cases], "base string, ref string")
    out = df.select(U.resolve(F.col("base"), F.col("ref")).alias("abs")).withColumn("host", U.host(F.col("abs"))).collect()
    for (b, r, want, want_host), row in zip(cases, out):
        assert row.abs == want, (b, r, row.abs)
        assert row.host == want_host, (b, r, row.host)


def test_host_scope_is_exact(spark):
    html = '<a href="https://www.venue.example.com/x">w</a><a href="/y">y</a><a href="https://venue.example.com:81/z">p</a>'
    pages = spark.createDataFrame([(1, "https://venue.example.com/", html)], "page_id long, url string, html string")
    scoped = links.scope_to_host(links.followable(links.resolve_links(links.extract_links(pages))))
    assert sorted(r.abs_url for r in scoped.collect()) == ["https://venue.example.com/y", "https://venue.example.com:81/z"]


def test_element_callback(spark):
    from eventpipe.operators.html_exact import map_elements

    html = '<ul><li data-theme="secondary"><a href="/a">A <b>bold</b></a></li><li><a href="/b">B</a></li></ul>'
    pages = spark.createDataFrame([(1, "https://v/", html)], "page_id long, url string, html string")

    def on_anchor(url, tag, attrs, text):
        yield (url, attrs.get("href"), text)

    got = map_elements(pages, on_anchor, "url string, href string, text string", tag="a").orderBy("href").collect()
    assert [(r.href, r.text) for r in got] == [("/a", "A bold"), ("/b", "B")]


def test_elements_without_an_end(spark):
    from eventpipe.operators.html_exact import map_elements

    def found(html, **how):
        pages = spark.createDataFrame([(1, "https://v/", html)], "page_id long, url string, html string")
        return [(r.tag, r.text) for r in map_elements(pages, lambda url, tag, attrs, text: [(tag, text)], "tag string, text string", **how).collect()]

    assert found('<img src="a"><img src="b">', tag="img") == [("img", ""), ("img", "")]
    assert found("<ul><li>a<li>b <b>c</b></ul>d", tag="li") == [("li", "a"), ("li", "b c")]
    assert found("<div>x<br>y</div>z") == [("div", "xy"), ("br", "")]
    assert found("<div>a<div>b</div>c</div>d", tag="div") == [("div", "abc"), ("div", "b")]
    assert found("<li>a<ul><li>b</ul>c", tag="li") == [("li", "abc"), ("li", "b")]
    assert found("<p>open <i>to the end", tag="i") == [("i", "to the end")]


def test_list_files(spark, tmp_path):
    from eventpipe.sources.tables import list_files, read_html_folder

    (tmp_path / "a.html").write_text("<a href='/x'>x</a>")
    (tmp_path / "b.html").write_text("<p>none</p>")
    (tmp_path / "c.txt").write_text("skip")
    files = list_files(spark, str(tmp_path), "*.html").collect()
    assert sorted(r.length for r in files) == [11, 18]
    pages = read_html_folder(spark, str(tmp_path))
    assert pages.count() == 2 and links.extract_links(pages).count() == 1


def test_resolved_host_equals_host_of_resolved(spark):
    refs = ["/a", "b", "//x.example.org/p", "https://Y.example.net:8/q", "mailto:z@q", "", "#f", None, "?q=1", "http:rel"]
    bases = ["https://venue.example.com/d/p#t", "http://h.example.com", "https://u@v.example.com:9/x/"]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "base string, ref string")
    out = df.select(
        F.coalesce(U.host(U.resolve(F.col("base"), F.col("ref"))), F.lit("")).alias("a"),
        U.resolved_host(F.col("base"), F.col("ref")).alias("b"),
    ).collect()
    assert all(r.a == r.b for r in out), [(r.a, r.b) for r in out if r.a != r.b]


def test_resolve_matches_sql_oracle_on_edge_cases(spark):
    """The fast paths of ``resolve`` agree with the plain SQL form the oracle uses."""
    import duckdb

    from eventpipe.plans import sql as S

    bases = ["https://h.example.com/a/b.html?x=1#t", "http://h.example.com", "https://h.example.com/", "https://u@h.example.com:8/d/e/",
             "mailto:x@y", "https://h.example.com/a/./b/../c"]
    refs = ["/p", "/p?q=1", "/a/../b", "/./c/.", "p/q", "../x", "./", "?z", "", "#f", "//o.example.org/p/../q", "https://O.example/x/./y",
            "/èé", "p q", "/%41", "a?b#c", "..", ".", "/p#frag?x", "ftp:rel", "/a//b"]
    pairs = [(b, r) for b in bases for r in refs]
    got = spark.createDataFrame(pairs, "base string, ref string").select(
        "base", "ref", U.resolve(F.col("base"), F.col("ref")).alias("abs")
    ).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t(base VARCHAR, ref VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", pairs)
    want = {(b, r): a for b, r, a in con.execute(f"SELECT base, ref, {S.resolve('base', 'ref')} FROM t").fetchall()}
    bad = [(r.base, r.ref, r.abs, want[(r.base, r.ref)]) for r in got if r.abs != want[(r.base, r.ref)]]
    assert not bad, bad[:5]


def test_parsable_urls(spark):
    import duckdb

    from eventpipe.plans import sql as S

    cases = {
        "https://vega.dk/event/example": True,
        "https://vega.dk:8080/x": True,
        "http://[::1]:80/a": True,
        "https://u:p@h.example.com/": True,
        "https://h.example.com/a%20b": True,
        "mailto:x@y": True,
        "": True,
        "https://[vega.dk/e/": False,
        "https://vega.dk:80x/": False,
        "https://ve ga.dk/": False,
        "https://vega.dk/%zz": False,
        "https://vega.dk/%4": False,
        "https://vega.dk/\x01": False,
        ":no-scheme": False,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    got = {r.u: r.ok for r in df.select("u", U.parsable(F.col("u")).alias("ok")).collect()}
    assert got == cases
    con = duckdb.connect()
    con.execute("CREATE TABLE t(u VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(u,) for u in cases])
    assert dict(con.execute(f"SELECT u, {S.parsable('u')} FROM t").fetchall()) == cases


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_regex_and_parser_agree_on_driver_pages(spark, sf):
    import os

    if not os.path.exists(f"{sf}/pages.parquet"):
        pytest.skip("no test data")
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    native = links.extract_links(pages).select("page_id", "pos", "href")
    exact = extract_links_exact(pages).select("page_id", "pos", "href")
    assert native.count() > 0
    assert native.exceptAll(exact).count() == 0 and exact.exceptAll(native).count() == 0
