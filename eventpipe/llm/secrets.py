"""Secret scans: fixed patterns, and zstandard novelty with primed dictionaries (operator 8).

Three patterns give the base findings (``assign``, ``access``, ``hex``). The
method adds ``novel`` findings: a token of 16 or more key characters, letters and
digits among them, that follows a sensitive word closely. Of ``name=value`` the
value alone is the token, and the name belongs to the text before it; if the name
holds the sensitive word, the value may be of letters or digits only. The token is
compressed by zstandard with a dictionary made of common identifiers and of the
text around it (without the token). What it adds to the compressed size are its
marginal bytes: names, paths and repeated words are found in the dictionary and
add little, a random string adds about its own length, whatever its alphabet: a long
token is measured in parts so short that only repeats save bytes. A token whose marginal
bytes reach ``NOVELTY`` of its length is reported, unless one base finding holds all of it.

A whole text is read, never a prefix, in time in proportion to its length and findings, also a very long one. A first pass of an automaton (RE2, in
Arrow) over each column of texts finds the texts that can hold a finding at all;
it accepts more than the patterns, never less.

Defined results: a null or empty text has no findings; repeated rows each give a
row; a null id stays null; other columns pass through ``redact``; an empty table
gives an empty result. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready, texts_of
from .text import slices

#: The base patterns and the least length of what they must find (the value group, or the whole match).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = re.compile(r"passw|passphrase|secret|token|key|credential|auth|bearer|private|signature|session", re.IGNORECASE | re.ASCII)
LEAST = 16  # characters of a token
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{{{LEAST},}}")
NAME = re.compile(r"[^=]*=+(?=[^=])")
#: Common identifiers of code and configuration, for the compressor's dictionary.
IDENTIFIERS = (
    "https://www.example.com/index.html http://localhost:8080/api/v1/ application/json content-type charset=utf-8 "
    "username password passwd passphrase secret token access_token refresh_token api_key apikey private_key public_key "
    "authorization: bearer authentication credentials signature session_id client_id client_secret aws_access_key_id "
    "aws_secret_access_key database_url connection_string environment configuration settings development production "
    "function return import export default const static public private protected class interface implements extends "
    "undefined null true false string integer boolean object array length index value result response request "
    "getElementById addEventListener toString valueOf hashCode equals size isEmpty begin end first last next previous "
    "org.apache.commons com.example.project src/main/java src/test/resources node_modules package.json README.md "
    "/usr/local/bin /var/log /home/user/.ssh/id_rsa.pub abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 "
    "version license copyright author description timestamp created_at updated_at deleted_at placeholder changeme"
).encode()
AROUND = 400  # code points of text on each side that prime the dictionary
REACH = 48  # code points before a token in which the sensitive word must begin
NOVELTY = 0.75
PIECE = 48  # characters compressed at a time: of longer literals zstandard also codes the alphabet, and a long random key seems compressible
BLOCK_BYTES = 4 << 20
#: Texts that hold no match of this cannot have a finding.
SCREEN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}|AKIA[A-Z0-9]{12}|[0-9a-f]{32}|"""
    r"(?i:passw|passphrase|secret|token|key|credential|auth|bearer|private|signature|session)"
)
FINDING = "array<struct<kind: string, start: int, end: int, value_start: int, novelty: float>>"


def marginal_bytes(token: str, before: str, after: str) -> int:
    """Bytes that the token adds to a compressed stream primed with identifiers and the text around it."""
    import zstandard

    primer = zstandard.ZstdCompressionDict(IDENTIFIERS + after.encode() + before.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    c = zstandard.ZstdCompressor(level=9, dict_data=primer, write_content_size=False, write_checksum=False)
    return len(c.compress(token.encode())) - len(c.compress(b""))


def pieces(s: int, e: int) -> list[tuple[int, int]]:
    """A span in equal parts of at most ``PIECE`` characters."""
    n = -(-(e - s) // PIECE)
    cuts = [s + (e - s) * k // n for k in range(n + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _share(text: str, s: int, e: int) -> float:
    """Marginal bytes of a token for each of its characters, part by part; what stands before a part, also of the token itself, primes it."""
    after = text[e : e + AROUND]
    return sum(marginal_bytes(text[a:b], text[max(0, a - AROUND) : a], after) for a, b in pieces(s, e)) / (e - s)


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


def _value_start(text: str, s: int, e: int) -> int:
    """Where the value begins in a candidate: after its leading ``name=``, of which there may be several.

    A name is too short for a token, holds a sensitive word or adds little to the text around it.
    """
    while m := NAME.match(text, s, e):
        end = m.end()
        name = m.group().rstrip("=")
        if len(name) >= LEAST and not SENSITIVE.search(name) and _share(text, s, s + len(name)) >= NOVELTY:
            break
        s = end
    return s


def find(text: str) -> list[tuple[str, int, int, int, float]]:
    """(kind, start, end, start of the secret itself, novelty or 0) by start, then kind."""
    out = [("assign", m.start(), m.end(), m.start(2), 0.0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [("access", m.start(), m.end(), m.start(), 0.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end(), m.start(), 0.0) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    words = [m.start() for m in SENSITIVE.finditer(text)]
    if words:
        taken = sorted((s, e) for _, s, e, _, _ in out)
        begins, reached = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
        held = lambda s, e: (k := bisect_right(begins, s)) > 0 and reached[k - 1] >= e  # noqa: E731 - one base finding holds all of it
        at = 0
        for m in CANDIDATE.finditer(text):
            s, e = m.span()
            while at < len(words) and words[at] < s - REACH:
                at += 1
            if at == len(words) or words[at] >= e:
                continue
            value = _value_start(text, s, e)
            if words[at] >= value or held(value, e):
                continue
            named = bisect_left(words, s) < bisect_left(words, value)
            starts = [value] if e - value >= LEAST and (named or _mixed(text[value:e])) else []
            if value > s and words[at] < s and _mixed(text[s:e]):
                starts.append(s)  # what looks like a name may be a part of the token
            for k in starts:
                share = _share(text, k, e)
                if share >= NOVELTY:
                    out.append(("novel", k, e, k, share))
                    break
    return sorted(out, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


def _findings(column: pa.Array) -> list[list[tuple]]:
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    maybe = pc.match_substring_regex(texts, SCREEN).to_pylist()
    return [find(texts[i].as_py()) if m else [] for i, m in enumerate(maybe)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, findings): every finding of every whole text, by start and then kind."""
    names = ("kind", "start", "end", "value_start", "novelty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32()), ("novelty", pa.float32())]))
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                found = [[dict(zip(names, f, strict=True)) for f in fs] for fs in _findings(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], names=["doc_id", "findings"])

    ready(docs)
    return texts_of(docs, id_col, text_col).mapInArrow(run, f"doc_id long, findings {FINDING}")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents with each secret (of an assignment: its value) replaced by ``[REDACTED:kind]``.

    Overlapping findings are replaced as one, under the first kind. Other texts stay
    as they are, also null ones. ``length_col`` is set anew where a text changed.
    """

    def clean(text: str, found: list[tuple]) -> str:
        out, at = [], 0
        for kind, _, end, start, _ in sorted(found, key=lambda f: (f[3], -f[2])):
            if end <= at:
                continue
            if start >= at:
                out += [text[at:start], f"[REDACTED:{kind}]"]
            at = end  # a finding that overlaps the last one lengthens it
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            for part in slices(batch, text_col, BLOCK_BYTES):
                found = _findings(part.column(k))
                if any(found):
                    texts = part.column(k).to_pylist()
                    new = [clean(t, f) if f else t for t, f in zip(texts, found, strict=True)]
                    part = part.set_column(k, part.schema.field(k), pa.array(new, part.schema.field(k).type))
                    c = part.schema.get_field_index(length_col) if length_col else -1
                    if c >= 0 and pa.types.is_integer(part.schema.field(c).type):
                        sizes = [len(t) if f else n for t, f, n in zip(new, found, part.column(c).to_pylist(), strict=True)]
                        part = part.set_column(c, part.schema.field(c), pa.array(sizes, part.schema.field(c).type))
                yield part

    ready(docs)
    return docs.mapInArrow(run, docs.schema)


def spelled(findings: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
