"""URL resolution and host extraction as native column expressions.

Resolution follows RFC 3986 reference resolution the way the reference's crawler
applies it to links: a fragment-only link gives nothing, fragments are dropped,
dot segments are removed and the path is percent-escaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# URL grammar pieces, shared with the SQL oracle.
SCHEME_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
ORIGIN_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"
PATH_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"
QUERY_RE = r"^[^?#]*(\?[^#]*)"
HOST_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
DOT_SEGMENT_RE = r"(^|/)\.\.?(/|$)"
# What makes the reference's URL parser fail (control characters, a bad
# percent escape, an unclosed IPv6 bracket, a port that is not a number, a space in the host).
CONTROL_RE = r"[\x00-\x1f\x7f]"
BAD_ESCAPE_RE = r"%([0-9A-Fa-f]?([^0-9A-Fa-f]|$))"
AUTHORITY_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
HOSTPORT_OK_RE = r"^(\[[^\]]*\]|[^\[\]:\s]*)(:[0-9]*)?$"
# Characters kept as they are in a path; every other byte is written as %XX.
PATH_SAFE_RE = r"[A-Za-z0-9\-._~!$&'()*+,;=:@/%]"
NEEDS_ESCAPE_RE = r"[^A-Za-z0-9\-._~!$&'()*+,;=:@/%]"


def host(url: Column) -> Column:
    """Host without port and brackets, case kept; empty string when there is none."""
    h = F.regexp_extract(url, HOST_RE, 1)
    return F.regexp_replace(h, F.lit(r"^\[|\]$"), F.lit(""))


def scheme(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, F.lit(r"(?s)#.*$"), F.lit(""))


def remove_dot_segments(path: Column) -> Column:
    """RFC 3986 5.2.4 on an absolute path, as a fold over its segments."""
    segs = F.split(path.substr(F.lit(2), F.length(path)), "/")
    empty = F.array().cast("array<string>")

    def step(acc, s):
        return (
            F.when(s == ".", acc)
            .when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
            .otherwise(F.concat(acc, F.array(s)))
        )

    folded = F.aggregate(segs, empty, step)
    last = F.element_at(segs, -1)
    folded = F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    cleaned = F.concat(F.lit("/"), F.array_join(folded, "/"))
    # the cheap contains() keeps the regex off the common path without dots
    return F.when(path.contains(".") & path.rlike(DOT_SEGMENT_RE) & path.startswith("/"), cleaned).otherwise(path)


def escape_path(path: Column) -> Column:
    """Percent-escape, byte by byte in UTF-8, every character outside the path set."""
    chars = F.split(path, "")
    escaped = F.transform(
        chars,
        lambda c: F.when(c.rlike(PATH_SAFE_RE), c).otherwise(
            F.regexp_replace(F.hex(F.encode(c, "UTF-8")), r"(..)", "%$1")
        ),
    )
    return F.when(path.rlike(NEEDS_ESCAPE_RE), F.array_join(escaped, "")).otherwise(path)


def _clean_path(path: Column) -> Column:
    return escape_path(remove_dot_segments(path))


def base_parts(base: Column) -> dict:
    """Pieces of the page URL that every link on the page reuses (computed once per page)."""
    origin = F.regexp_extract(base, ORIGIN_RE, 1)
    path = F.regexp_extract(base, PATH_RE, 1)
    return {
        "base": base,
        "origin": origin,
        "dir_path": F.when(path.contains("/"), F.regexp_extract(path, r"^(.*/)", 1)).otherwise(F.lit("/")),
        "scheme": scheme(base),
        "no_fragment": without_fragment(base),
        "no_query": F.regexp_replace(base, F.lit(r"(?s)[?#].*$"), F.lit("")),
    }


def _stripped(ref: Column) -> Column:
    return F.when(ref.contains("#"), without_fragment(ref)).otherwise(ref)


def _generic_target(parts: dict, r: Column) -> Column:
    """The full target text for absolute, ``//``, empty, ``?`` and non-hierarchical links; null otherwise."""
    origin = parts["origin"]
    return (
        F.when(r.startswith("//"), F.concat(parts["scheme"], F.lit(":"), r))
        .when(r.startswith("/") & (origin == ""), F.concat(origin, r))
        .when(r.startswith("/"), F.lit(None).cast("string"))
        .when(r.rlike(SCHEME_RE), r)
        .when(r == "", parts["no_fragment"])
        .when(r.startswith("?"), F.concat(parts["no_query"], r))
        .when(origin == "", F.concat(origin, parts["dir_path"], r))
    )


def _assemble(parts: dict, ref: Column, r: Column, generic: Column) -> Column:
    is_generic = generic.isNotNull()
    o = F.when(is_generic, F.regexp_extract(generic, ORIGIN_RE, 1)).otherwise(parts["origin"])
    fast_path = F.concat(F.when(r.startswith("/"), F.lit("")).otherwise(parts["dir_path"]), F.substring_index(r, "?", 1))
    p = F.when(is_generic, F.regexp_extract(generic, PATH_RE, 1)).otherwise(fast_path)
    q = F.when(is_generic, F.regexp_extract(generic, QUERY_RE, 1)).otherwise(
        F.when(r.contains("?"), F.substr(r, F.instr(r, "?"))).otherwise(F.lit(""))
    )
    out = F.when(is_generic & (o == ""), generic).otherwise(F.concat(o, _clean_path(p), q))
    return F.when(ref.isNull() | ref.startswith("#"), F.lit(None).cast("string")).otherwise(out)


def resolve_with(parts: dict, ref: Column) -> Column:
    """``resolve`` given the page's ``base_parts``, as one expression.

    The common links (``/path`` and relative paths on a hierarchical page) take
    their origin and directory from the page and split off the query with
    ``substring_index`` / ``instr``, without a regular expression; absolute,
    ``//``, empty and ``?`` links are written out in full and parsed. The path is
    cleaned (dot segments, escapes) once. ``with_resolved`` is the same in three
    projections, which keeps the generated code small.
    """
    r = _stripped(ref)
    return _assemble(parts, ref, r, _generic_target(parts, r))


def with_resolved(df: DataFrame, parts: dict, ref_col: str, out: str) -> DataFrame:
    """Adds ``out`` = the resolved link, computed in steps so each piece is generated once."""
    ref = F.col(ref_col)
    staged = df.withColumn("_r", _stripped(ref)).withColumn("_g", _generic_target(parts, F.col("_r")))
    return staged.withColumn(out, _assemble(parts, ref, F.col("_r"), F.col("_g"))).drop("_r", "_g")


def resolve(base: Column, ref: Column) -> Column:
    """Absolute URL of ``ref`` against page ``base``; null for a fragment-only or missing link."""
    return resolve_with(base_parts(base), ref)


def resolved_host(base: Column, ref: Column) -> Column:
    """``host(resolve(base, ref))`` without resolving: only an absolute or ``//`` link changes host.

    Cheap enough to sit in a pushed-down filter, where the full resolution would
    be evaluated a second time.
    """
    r = without_fragment(ref)
    h = (
        F.when(r.rlike(SCHEME_RE), host(r))
        .when(r.startswith("//"), host(F.concat(scheme(base), F.lit(":"), r)))
        .otherwise(host(base))
    )
    return F.when(ref.isNull() | ref.startswith("#"), F.lit("")).otherwise(h)


def parsable(url: Column) -> Column:
    """False where the reference's URL parser fails: such a message is ``bad_url`` and retried."""
    authority = F.regexp_extract(url, AUTHORITY_RE, 1)
    hostport = F.regexp_replace(authority, r"^.*@", "")
    bad = (
        url.rlike(CONTROL_RE)
        | url.startswith(":")
        | (url.contains("%") & url.rlike(BAD_ESCAPE_RE))
        | ~hostport.rlike(HOSTPORT_OK_RE)
    )
    return F.coalesce(~bad, F.lit(False))


def link_status(ref: Column) -> Column:
    """Why a link cannot be followed, or ``ok``."""
    return (
        F.when(ref.isNull(), F.lit("missing_href"))
        .when(ref == "", F.lit("empty_href"))
        .when(ref.startswith("#"), F.lit("fragment_only"))
        .otherwise(F.lit("ok"))
    )
