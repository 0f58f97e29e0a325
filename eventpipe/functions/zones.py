"""Wall clock and offset text in a named zone, independent of the session time zone.

All conversions are arithmetic on microseconds with a constant zone
(``to_utc_timestamp`` / ``from_utc_timestamp``) and ``TIMESTAMP_NTZ`` math, so the
session's own time zone never enters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EPOCH_NTZ = "1970-01-01 00:00:00"


def ntz_epoch(local: Column) -> Column:
    """Seconds from 1970-01-01 00:00 to a wall clock, reading the wall clock as if it were UTC."""
    return F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit(_EPOCH_NTZ)), local)


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def ntz_text(ts: Column, time: bool = True) -> Column:
    """``yyyy-MM-dd'T'HH:mm:ss`` (or ``yyyy-MM-dd``) of a ``TIMESTAMP_NTZ`` from its fields.

    ``date_format`` casts a ``TIMESTAMP_NTZ`` through the session zone, which
    moves wall clocks inside a daylight-saving gap; the field functions do not.
    """
    date = F.concat(_pad(F.year(ts), 4), F.lit("-"), _pad(F.month(ts), 2), F.lit("-"), _pad(F.dayofmonth(ts), 2))
    if not time:
        return date
    return F.concat(date, F.lit("T"), _pad(F.hour(ts), 2), F.lit(":"), _pad(F.minute(ts), 2), F.lit(":"), _pad(F.second(ts), 2))


def day_text(ts: Column) -> Column:
    """``yyyy-MM-dd`` of a ``TIMESTAMP_NTZ`` (no session zone involved)."""
    return F.to_date(ts).cast("string")


def offset_seconds(local: Column, zone: str) -> Column:
    """UTC offset of ``zone`` at the wall clock ``local`` (``TIMESTAMP_NTZ``), in seconds."""
    e = ntz_epoch(local)
    return e - F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(e), zone))


def offset_text_of(seconds: Column) -> Column:
    """``Z`` for zero, else ``+hh:mm`` / ``-hh:mm`` (RFC 3339)."""
    m = F.abs(seconds) / 60
    text = F.concat(
        F.when(seconds < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad((m / 60).cast("int").cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((m % 60).cast("int").cast("string"), 2, "0"),
    )
    return F.when(seconds == 0, F.lit("Z")).otherwise(text)


def with_rfc3339_local(df: DataFrame, local_col: str, out: str, zone: str) -> DataFrame:
    """Adds ``out``: RFC 3339 text of a wall clock in ``zone`` with that zone's offset then.

    The offset is its own column first, so it is computed once per row rather
    than once per branch of the text expression.
    """
    tmp = f"_{out}_off"
    return (
        df.withColumn(tmp, offset_seconds(F.col(local_col), zone))
        .withColumn(out, F.concat(ntz_text(F.col(local_col)), offset_text_of(F.col(tmp))))
        .drop(tmp)
    )


def wall_clock(epoch: Column, zone: str) -> Column:
    """Wall clock in ``zone`` for an epoch, as ``TIMESTAMP_NTZ``."""
    shifted = F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(epoch), zone))
    return F.timestamp_add("SECOND", shifted, F.to_timestamp_ntz(F.lit(_EPOCH_NTZ)))
