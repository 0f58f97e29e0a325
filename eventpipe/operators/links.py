"""Link extraction (P1), resolution (P3), hosts (P4) and host scope (P5).

All narrow: one pass over the pages, no shuffle. The per-page work is native
regular expressions and higher-order array functions inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..specs import LinkSpec


def with_venue_host(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Venue of a page snapshot = its host (exact text, port dropped)."""
    return pages.withColumn("venue", U.host(F.col(url_col)))


_BASE = "_base_url"
_ORIGIN = "_base_origin"
_DIR = "_base_dir"
BASE_RE = r"(?i)<base[\s/>]"  # fixed value: what a page with a base element holds
LINK_COLUMNS = ["page_id", "src_url", "venue", "depth", "pos", "href"]


def with_base_url(pages: DataFrame) -> DataFrame:
    """Adds what the page's links are relative to: the ``href`` of its first ``base`` element that has one, else its own URL.

    In steps, so that each piece is computed once; most pages have no such element
    and are only searched for it.
    """
    hrefs = F.filter(H.select_attr(F.col("html"), "base", "href"), lambda h: h.isNotNull())
    declared = pages.withColumn("_declared", F.when(F.col("html").rlike(BASE_RE), F.get(hrefs, F.lit(0))))
    found = U.with_resolved(declared, U.base_parts(F.col("url")), "_declared", _BASE)
    return found.withColumn(_BASE, F.coalesce(_BASE, "url")).drop("_declared")


def hrefs_of(spec: LinkSpec) -> Column:
    """The selected attribute of each selected element of ``html``, in page order."""
    return H.select_attr(F.col("html"), spec.tag, spec.take, spec.attr, spec.value)


def extract_links(pages: DataFrame, spec: LinkSpec = LinkSpec(), depth: int = 1, hrefs: Column | None = None, keep: tuple = ()) -> DataFrame:
    """One row per selected element: ``page_id, src_url, venue, depth, pos, href``.

    ``pos`` counts from 1 in page order; ``href`` is null when the element has no
    such attribute. Comments, scripts and styles are ignored. ``hrefs`` replaces the
    spec's selection (for pages of several specs); ``keep`` names columns to carry on. Three helper columns carry the
    page's base URL and its origin and directory, computed once per page for
    ``resolve_links``.
    """
    hrefs = hrefs_of(spec) if hrefs is None else hrefs
    parts = U.base_parts(F.col(_BASE))
    return (
        with_base_url(with_venue_host(pages))
        .select(
            "page_id",
            F.col("url").alias("src_url"),
            "venue",
            *keep,
            _BASE,
            parts["origin"].alias(_ORIGIN),
            parts["dir_path"].alias(_DIR),
            F.posexplode(hrefs).alias("pos0", "href"),
        )
        .select(
            "page_id",
            "src_url",
            "venue",
            F.lit(depth).cast("int").alias("depth"),
            (F.col("pos0") + 1).cast("long").alias("pos"),
            "href",
            *keep,
            _BASE,
            _ORIGIN,
            _DIR,
        )
    )


def resolve_links(links: DataFrame) -> DataFrame:
    """Adds ``status`` and ``abs_url`` (null for a fragment-only or missing link)."""
    parts = U.base_parts(F.col(_BASE if _BASE in links.columns else "src_url"))
    if _ORIGIN in links.columns:
        parts.update(origin=F.col(_ORIGIN), dir_path=F.col(_DIR))
    out = U.with_resolved(links.withColumn("status", U.link_status(F.col("href"))), parts, "href", "abs_url")
    return out.drop(_ORIGIN, _DIR)


def with_link_host(resolved: DataFrame) -> DataFrame:
    """Adds ``host`` of the resolved link (computed from ``href``, so filters on it stay cheap)."""
    return resolved.withColumn("host", U.resolved_host(F.col(_BASE if _BASE in resolved.columns else "src_url"), F.col("href")))


def followable(resolved: DataFrame) -> DataFrame:
    """Links that can be followed: ``status == 'ok'``; the rest go to the error table."""
    return resolved.where(F.col("status") == "ok")


def link_errors(resolved: DataFrame) -> DataFrame:
    """Error rows (``stage, url, reason``) for links that cannot be followed; never a failed job."""
    return resolved.where(F.col("status") != "ok").select(
        F.lit("links").alias("stage"), F.col("src_url").alias("url"), "pos", F.col("status").alias("reason")
    )


def scope_to_host(resolved: DataFrame, host_col: str = "venue") -> DataFrame:
    """Only links on the allowed host (exact compare, so ``www.`` is another host)."""
    return with_link_host(resolved).where(F.col("host") == F.col(host_col))
