"""Base64 as the reference's queue client writes it: standard alphabet, padded, one line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def b64encode(text: Column) -> Column:
    """Standard base64 without line breaks (Spark's encoder may wrap at 76 characters)."""
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"[\r\n]", "")


def b64decode_text(b64: Column) -> Column:
    """Decoded UTF-8 text; null when the input is not valid base64."""
    return F.try_to_binary(b64, F.lit("base64")).cast("string")
