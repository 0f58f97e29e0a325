"""JSON text helpers that keep byte parity with the reference's encoder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def html_safe(json_text: Column) -> Column:
    """Escape ``<``, ``>``, ``&`` and the two Unicode line separators as ``\\u`` sequences.

    The reference's encoder does this by default; in JSON text these characters
    can only occur inside strings, so a plain replace is exact.
    """
    out = F.replace(json_text, F.lit("&"), F.lit("\\u0026"))
    out = F.replace(out, F.lit("<"), F.lit("\\u003c"))
    out = F.replace(out, F.lit(">"), F.lit("\\u003e"))
    out = F.replace(out, F.lit("\u2028"), F.lit("\\u2028"))
    return F.replace(out, F.lit("\u2029"), F.lit("\\u2029"))


def encode(struct_col: Column) -> Column:
    """``to_json`` of a struct, field order kept, HTML characters escaped."""
    return html_safe(F.to_json(struct_col))
