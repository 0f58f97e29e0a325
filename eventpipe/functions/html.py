"""HTML selection as native regular expressions over the page text, in one pass over its tokens.

A page is read as a browser's tokenizer reads it, from left to right: comments, raw-text
elements, start and end tags. Every token is consumed whole, also one that the page's end cuts
off, so nothing inside a comment, a script or another tag's attribute is taken for a tag, and no
place of the page is read more than twice. All repetitions are possessive: the matcher keeps no
stack and never goes back, so a tag of any length takes time in proportion, and an unclosed tag or
quote takes the rest of the page with it.
"""

from __future__ import annotations

import functools
import json
from html.entities import codepoint2name, html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokenizer's grammar (Java regex).
VALUE_RE = r"""(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|(?!["'])[^\s>]*+)"""
ATTR_NAME_RE = r"(?:=[^\s/>=]*+|[^\s/>=]++)"
ATTR_RE = ATTR_NAME_RE + r"(?:\s*+=\s*+" + VALUE_RE + r")?+"
TAG_REST_RE = r"(?:[\s/]++|" + ATTR_RE + r")*+"
TAG_END_RE = r"(?=[\s/>])"
COMMENT_RE = r"<!--(?:-?>|(?:[^-]++|-(?!-!?>))*+(?:--!?>|\z))"
#: Elements whose content is text up to their own end tag.
RAW_TEXT = ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp")

#: The named references that need no semicolon are those of Latin-1 and of markup itself, some also in capitals.
_BARE = {n: chr(c) for c, n in codepoint2name.items() if c < 256} | {"AMP": "&", "COPY": "©", "GT": ">", "LT": "<", "QUOT": '"', "REG": "®"}
#: What numeric references to C1 controls stand for (the code page that pages mean by them).
_C1 = {c: bytes([c]).decode("cp1252") for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _text_re(tag: str) -> str:
    """Raw text up to the end tag of this name, or all the rest: runs without ``<`` are taken whole."""
    return r"(?:[^<]++|<(?!/" + tag + TAG_END_RE + r"))*+"


_RAW_RE = r"<(" + "|".join(RAW_TEXT) + r")" + TAG_END_RE + TAG_REST_RE + r"(?:>" + _text_re(r"\2") + r"|\z)"
_ANY_RE = r"</?[a-z][^\s/>]*+" + TAG_REST_RE + r"(?:>|\z)"


def _tokens_re(wanted: str, whole: bool = False) -> str:
    """A page's tokens; group 1 is what is wanted where a token begins with it (or is it, if ``whole``), and empty elsewhere."""
    if whole:
        return r"(?is)" + COMMENT_RE + r"|(" + wanted + r")|" + _RAW_RE + r"|" + _ANY_RE
    return r"(?is)" + COMMENT_RE + r"|(?:(?=(" + wanted + r"))|)(?:" + _RAW_RE + r"|" + _ANY_RE + r")"


def tags_re(tag: str) -> str:
    """Tokens with the opening tags of this name (or pattern of names)."""
    return _tokens_re(r"<(?:" + tag + r")" + TAG_END_RE + TAG_REST_RE + r">")


def elements_re(tag: str) -> str:
    """Tokens with the raw-text elements of this name, from the opening tag up to the end tag, which must be there."""
    return _tokens_re(r"<" + tag + TAG_END_RE + TAG_REST_RE + r">" + _text_re(tag) + r"(?=<)", whole=tag.lower() in RAW_TEXT)


def open_re(tag: str) -> str:
    """The opening tag that an element begins with."""
    return r"(?is)^<" + tag + TAG_END_RE + TAG_REST_RE + r">"


def attr_re(name: str) -> str:
    """An opening tag up to the value (group 1, quotes and all) of its first attribute of this name, if it has one."""
    mine = name + r"(?=[\s=/>])"
    return r"(?is)^<[a-z][^\s/>]*+(?:[\s/]++|(?!" + mine + r")" + ATTR_RE + r")*+" + mine + r"(?:\s*+=\s*+(" + VALUE_RE + r"))?+"


@functools.cache
def _names() -> str:
    """Named references as a JSON object; names with a semicolon are spelled with it."""
    return json.dumps({n: c for n, c in html5.items() if n.endswith(";")} | _BARE)


def _character(code: Column) -> Column:
    """The character of a numeric reference; what is no character becomes U+FFFD."""
    wrong = (code <= 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF) | code.isNull()
    plain = F.decode(F.unhex(F.lpad(F.hex(F.when(wrong, F.lit(0xFFFD)).otherwise(code)), 8, "0")), "UTF-32")
    c1 = F.element_at(F.from_json(F.lit(json.dumps({str(k): v for k, v in _C1.items()})), "map<string,string>"), code.cast("string"))
    return F.coalesce(F.when(code.between(0x80, 0x9F), c1), plain)


def _referenced(piece: Column) -> Column:
    """A piece of text that followed an ampersand, with its reference decoded if it begins with one."""
    number = F.regexp_extract(piece, r"^#(?:[0-9]++|[xX][0-9a-fA-F]++);?", 0)
    digits = F.ltrim(F.regexp_replace(number, "[#xX;]", ""), F.lit("0"))
    code = F.when(F.lower(F.substring(number, 2, 1)) == "x", F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long")
    code = F.when(F.length(digits) < 10, code)  # more digits name no character
    name = F.regexp_extract(piece, r"^[a-zA-Z][a-zA-Z0-9]*+;?", 0)
    named = F.element_at(F.from_json(F.lit(_names()), "map<string,string>"), name)
    in_query = ~F.endswith(name, F.lit(";")) & (F.substr(piece, F.length(name) + 1, F.lit(1)) == "=")  # a parameter, not a reference
    rest = lambda of: F.substr(piece, F.length(of) + 1)
    return (
        F.when(number != "", F.concat(_character(code), rest(number)))
        .when((name != "") & named.isNotNull() & ~in_query, F.concat(named, rest(name)))
        .otherwise(F.concat(F.lit("&"), piece))
    )


def decode_references(text: Column) -> Column:
    """Character references of an attribute's value decoded, each once: what a reference gives is never read as another."""
    pieces = F.split(text, "&")
    decoded = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(_referenced(p))), "")
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def _of(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: inside a lambda each mention of a column is computed anew."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unquote(raw: Column) -> Column:
    """Attribute value without its quotes, with character references decoded and outer space trimmed."""
    quoted = raw.startswith('"') | raw.startswith("'")
    inner = F.when(quoted, raw.substr(F.lit(2), F.length(raw) - F.lit(2))).otherwise(raw)
    return F.trim(_of(inner, decode_references))


def attr_value(tag: Column, name: str) -> Column:
    """Value of attribute ``name`` in an opening tag (empty if it has none); null when the attribute is absent."""
    pattern = attr_re(name)
    return F.when(tag.rlike(pattern), _of(F.regexp_extract(tag, pattern, 1), unquote))


def select_tags(html: Column, tag: str, attr: str | None = None, value: str | None = None) -> Column:
    """Array of opening tags ``tag`` (optionally with ``attr == value``), in page order."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(tags_re(tag)), F.lit(1)), lambda t: t != "")
    if attr is None:
        return tags
    return F.filter(tags, lambda t: F.coalesce(attr_value(t, attr) == F.lit(value), F.lit(False)))


def select_attr(html: Column, tag: str, take: str, attr: str | None = None, value: str | None = None) -> Column:
    """Array of attribute ``take`` of the selected elements; null entries where it is missing."""
    return F.transform(select_tags(html, tag, attr, value), lambda t: attr_value(t, take))


def select_text(html: Column, tag: str, attr: str | None = None, value: str | None = None) -> Column:
    """Array of the raw text of the selected raw-text elements (e.g. ``script``), in page order."""
    elements = F.filter(F.regexp_extract_all(html, F.lit(elements_re(tag)), F.lit(1)), lambda e: e != "")
    if attr is not None:
        elements = F.filter(
            elements,
            lambda e: _of(F.regexp_extract(e, open_re(tag), 0), lambda t: F.coalesce(attr_value(t, attr) == F.lit(value), F.lit(False))),
        )
    body = lambda e: F.substr(e, F.length(F.regexp_extract(e, open_re(tag), 0)) + 1)
    return F.transform(elements, body)
