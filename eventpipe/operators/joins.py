"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 64 << 20


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``broadcast(df)`` only when it is measured to hold at most ``max_rows`` rows and ``max_bytes``, else ``df`` as is.

    The measure is one aggregate that every partition combines first; bytes are those
    of all columns as text and 16 for each row. Above a bound the planner (and AQE)
    pick the join from measured sizes.
    """
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(16).cast("long"))
    size = df.agg(F.count("*").alias("rows"), F.sum(width).alias("bytes")).first()
    return F.broadcast(df) if size["rows"] <= max_rows and (size["bytes"] or 0) <= max_bytes else df
