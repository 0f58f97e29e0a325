"""DuckDB expression builders for the oracle SQL, mirroring ``eventpipe.functions``.

They produce SQL text only; nothing here runs Spark. The patterns for HTML are the
oracle's own, for pages whose tags are whole; the cases of broken pages are literal
rows (``plans/hostile.py``) and tests.
"""

from __future__ import annotations

from ..functions import urls as U


# What the oracle takes for markup (RE2).
COMMENT_RE = r"(?s)<!--.*?-->"
NOISE_RE = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
OPEN_TAIL_RE = r"""(?:\s(?:[^>"']|"[^"]*"|'[^']*')*)?>"""
OTHER_ATTR_RE = r"""(?:[\s/]+[^\s=>"'/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+))?)"""
ATTR_VALUE_RE = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""


def tag_re(tag: str) -> str:
    return r"(?is)<" + tag + OPEN_TAIL_RE


def attr_re(name: str) -> str:
    return r"(?is)^<[a-z][^\s/>]*" + OTHER_ATTR_RE + r"*?[\s/]+" + name + ATTR_VALUE_RE


def element_re(tag: str) -> str:
    return r"(?is)<" + tag + OPEN_TAIL_RE + r".*?</" + tag + r"\s*>"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def host(x: str) -> str:
    h = f"regexp_extract({x}, {lit(U.HOST_RE)}, 1)"
    return f"regexp_replace({h}, {lit(r'^\[|\]$')}, '', 'g')"


def without_fragment(x: str) -> str:
    return f"regexp_replace({x}, {lit(r'(?s)#.*$')}, '')"


def origin(x: str) -> str:
    return f"regexp_extract({x}, {lit(U.ORIGIN_RE)}, 1)"


def unquote(raw: str) -> str:
    inner = f"CASE WHEN starts_with({raw}, '\"') OR starts_with({raw}, '''') THEN substring({raw}, 2, length({raw}) - 2) ELSE {raw} END"
    return f"trim(replace({inner}, '&amp;', '&'))"


def attr_value(tag: str, name: str) -> str:
    pat = lit(attr_re(name))
    return f"CASE WHEN regexp_matches({tag}, {pat}) THEN {unquote(f'regexp_extract({tag}, {pat}, 1)')} END"


def select_attr(html: str, tag: str, take: str, attr: str | None = None, value: str | None = None) -> str:
    clean = f"regexp_replace({html}, {lit(NOISE_RE)}, '', 'g')"
    tags = f"regexp_extract_all({clean}, {lit(tag_re(tag))}, 0)"
    if attr is not None:
        tags = f"list_filter({tags}, lambda t: coalesce({attr_value('t', attr)} = {lit(value)}, false))"
    return f"list_transform({tags}, lambda t: {attr_value('t', take)})"


def select_text(html: str, tag: str, attr: str | None = None, value: str | None = None) -> str:
    clean = f"regexp_replace({html}, {lit(COMMENT_RE)}, '', 'g')"
    els = f"regexp_extract_all({clean}, {lit(element_re(tag))}, 0)"
    open_re = lit(r"(?is)^<" + tag + r"(?:\s[^>]*)?>")
    if attr is not None:
        els = f"list_filter({els}, lambda e: coalesce({attr_value(f'regexp_extract(e, {open_re}, 0)', attr)} = {lit(value)}, false))"
    body_re = lit(r"(?is)^<" + tag + r"(?:\s[^>]*)?>(.*)</" + tag + r"\s*>$")
    return f"list_transform({els}, lambda e: regexp_extract(e, {body_re}, 1))"


def _directory(base: str) -> str:
    path = f"regexp_extract({base}, {lit(U.PATH_RE)}, 1)"
    return f"concat({origin(base)}, CASE WHEN contains({path}, '/') THEN regexp_extract({path}, '^(.*/)', 1) ELSE '/' END)"


def remove_dot_segments(p: str) -> str:
    segs = f"string_split(substring({p}, 2), '/')"
    fold = (
        f"list_reduce({segs}, lambda acc, s: CASE WHEN s = '.' THEN acc "
        f"WHEN s = '..' THEN acc[1:len(acc) - 1] ELSE list_append(acc, s) END, []::VARCHAR[])"
    )
    last = f"{segs}[-1]"
    fold = f"CASE WHEN {last} IN ('.', '..') THEN list_append({fold}, '') ELSE {fold} END"
    return (
        f"CASE WHEN regexp_matches({p}, {lit(U.DOT_SEGMENT_RE)}) AND starts_with({p}, '/') "
        f"THEN concat('/', array_to_string({fold}, '/')) ELSE {p} END"
    )


def escape_path(p: str) -> str:
    per_char = (
        f"list_transform(string_split({p}, ''), lambda c: CASE WHEN regexp_matches(c, {lit(U.PATH_SAFE_RE)}) "
        f"THEN c ELSE regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') END)"
    )
    return f"CASE WHEN regexp_matches({p}, {lit(U.NEEDS_ESCAPE_RE)}) THEN array_to_string({per_char}, '') ELSE {p} END"


def resolve(base: str, ref: str) -> str:
    r = without_fragment(ref)
    target = (
        f"(CASE WHEN regexp_matches({r}, {lit(U.SCHEME_RE)}) THEN {r} "
        f"WHEN starts_with({r}, '//') THEN concat(regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1), ':', {r}) "
        f"WHEN starts_with({r}, '/') THEN concat({origin(base)}, {r}) "
        f"WHEN {r} = '' THEN {without_fragment(base)} "
        f"WHEN starts_with({r}, '?') THEN concat(regexp_replace({base}, '(?s)[?#].*$', ''), {r}) "
        f"ELSE concat({_directory(base)}, {r}) END)"
    )
    path = f"regexp_extract({target}, {lit(U.PATH_RE)}, 1)"
    query = f"regexp_extract({target}, {lit(U.QUERY_RE)}, 1)"
    rebuilt = f"concat({origin(target)}, {escape_path(remove_dot_segments(path))}, {query})"
    out = f"CASE WHEN {origin(target)} = '' THEN {target} ELSE {rebuilt} END"
    return f"CASE WHEN {ref} IS NULL OR starts_with({ref}, '#') THEN NULL ELSE {out} END"


def parsable(url: str) -> str:
    hostport = f"regexp_replace(regexp_extract({url}, {lit(U.AUTHORITY_RE)}, 1), '^.*@', '')"
    bad = (
        f"(regexp_matches({url}, {lit(U.CONTROL_RE)}) OR starts_with({url}, ':') "
        f"OR (contains({url}, '%') AND regexp_matches({url}, {lit(U.BAD_ESCAPE_RE)})) "
        f"OR NOT regexp_matches({hostport}, {lit(U.HOSTPORT_OK_RE)}))"
    )
    return f"coalesce(NOT {bad}, false)"


def link_status(ref: str) -> str:
    return (
        f"CASE WHEN {ref} IS NULL THEN 'missing_href' WHEN {ref} = '' THEN 'empty_href' "
        f"WHEN starts_with({ref}, '#') THEN 'fragment_only' ELSE 'ok' END"
    )


def json_str(x: str) -> str:
    """JSON string literal of ``x`` with the reference encoder's HTML escapes."""
    s = f"replace(replace({x}, '\\', '\\\\'), '\"', '\\\"')"
    s = f"replace(replace(replace({s}, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e')"
    return f"concat('\"', {s}, '\"')"
