"""The exact HTML path for link selection: the standard library's HTML parser, run per
partition with ``mapInPandas`` (Arrow batches).

The native regex path is the default; this one tokenises real HTML (quotes,
entities, raw-text elements, comments) and is the reference the regex path is
tested against. Per-row Python stays a small helper here: Spark partitions the
pages, the parser only walks one page at a time.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from ..specs import LinkSpec

LINK_SCHEMA = "page_id long, src_url string, pos long, href string"


class _Collector(HTMLParser):
    def __init__(self, spec: LinkSpec):
        super().__init__(convert_charrefs=True)
        self.spec = spec
        self.found: list = []

    def _take(self, tag, attrs):
        s = self.spec
        if s.tag not in ("*", "[^\\s>]+") and tag.lower() != s.tag.lower():
            return
        amap = {}
        for k, v in attrs:
            amap.setdefault(k.lower(), v)
        if s.attr is not None and amap.get(s.attr.lower()) != s.value:
            return
        v = amap.get(s.take.lower())
        self.found.append(v.strip() if v is not None else (None if s.take.lower() not in amap else ""))

    def handle_starttag(self, tag, attrs):
        self._take(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self._take(tag, attrs)


def links_of(html: str, spec: LinkSpec) -> list:
    c = _Collector(spec)
    c.feed(html or "")
    c.close()
    return c.found


def extract_links_exact(pages: DataFrame, spec: LinkSpec = LinkSpec()) -> DataFrame:
    """``page_id, src_url, pos, href`` with the standard-library parser, one partition at a time."""

    def run(batches):
        for pdf in batches:
            rows = []
            for pid, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
                for i, h in enumerate(links_of(html, spec), start=1):
                    rows.append((pid, url, i, h))
            yield pd.DataFrame(rows, columns=["page_id", "src_url", "pos", "href"])

    return pages.select("page_id", "url", "html").mapInPandas(run, LINK_SCHEMA)


#: Elements without content, and elements that one of the same kind ends.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}}
#: Elements that an end implied by a sibling does not reach beyond.
LISTS = frozenset("ul ol dl select table tbody thead tfoot".split())


class _Elements(HTMLParser):
    """The selected elements as ``[tag, attrs, text pieces]`` in page order; text runs to the element's own end.

    An element ends with its end tag, with that of one around it, where a sibling of
    its kind begins (``<li>a<li>b``), or with the page; one without content at once.
    """

    def __init__(self, tag: str, attr: str | None, value: str | None):
        super().__init__(convert_charrefs=True)
        self.tag, self.attr, self.value = tag.lower(), attr, value
        self.found: list = []
        self._open: list = []  # (tag, the element if it is selected)

    def handle_starttag(self, tag, attrs):
        ended = SIBLINGS.get(tag, ())
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] in LISTS and not (tag == "tr" and self._open[i][0] in ("tbody", "thead", "tfoot")):
                break
            if self._open[i][0] in ended:
                del self._open[i:]
        amap = {k.lower(): v for k, v in reversed(attrs)}
        element = None
        if self.tag in ("*", tag) and (self.attr is None or amap.get(self.attr.lower()) == self.value):
            element = [tag, amap, []]
            self.found.append(element)
        if tag not in VOID:
            self._open.append((tag, element))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash means nothing on an element with content

    def handle_data(self, data):
        for _, element in self._open:
            if element is not None:
                element[2].append(data)

    def handle_endtag(self, tag):
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] == tag:
                del self._open[i:]
                return


def map_elements(pages: DataFrame, fn, schema: str, tag: str = "*", attr: str | None = None, value: str | None = None) -> DataFrame:
    """Per-element callback (the reference's ``OnHTML``): ``fn(url, tag, attrs, text)`` yields rows of ``schema``.

    Runs with ``mapInPandas`` over the pages' partitions; each page is parsed on
    its own, so the work is spread by Spark and nothing is gathered.
    """
    cols = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches):
        for pdf in batches:
            rows = []
            for url, html in zip(pdf["url"], pdf["html"]):
                p = _Elements(tag, attr, value)
                p.feed(html or "")
                p.close()
                for t, a, pieces in p.found:
                    rows.extend(fn(url, t, a, "".join(pieces)))
            yield pd.DataFrame(rows, columns=cols)

    return pages.select("url", "html").mapInPandas(run, schema)
