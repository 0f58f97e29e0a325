"""Date text as the reference writes it, and instants taken from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text of an unset time, and the Danish short month names used by
# the listing page's date format (day-month-year, 24 h clock).
ZERO_TIME_TEXT = "0001-01-01T00:00:00Z"
DANISH_MONTHS = ("jan.", "feb.", "mar.", "apr.", "maj", "jun.", "jul.", "aug.", "sep.", "okt.", "nov.", "dec.")
DISPLAY_ZONE = "Europe/Copenhagen"

_FRACTION_RE = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})\.\d+"
_ZERO_OFFSET_RE = r"[+-]00:00$"


def rfc3339_seconds(text: Column) -> Column:
    """RFC 3339 text with the fraction dropped, the offset kept and a zero offset as ``Z``.

    Works on the text, never through a timestamp, so ``+02:00`` survives; an
    unset value gives the year-1 text.
    """
    t = F.regexp_replace(text, _FRACTION_RE, "$1")
    t = F.regexp_replace(t, _ZERO_OFFSET_RE, "Z")
    return F.coalesce(t, F.lit(ZERO_TIME_TEXT))


def epoch_seconds(text: Column) -> Column:
    """The instant in whole seconds since 1970 (null when unset or unparsable)."""
    return F.unix_timestamp(F.try_to_timestamp(text))


def danish_display(local: Column) -> Column:
    """``15. okt. 2026 kl. 20.00`` from a wall-clock ``TIMESTAMP_NTZ`` in the display zone."""
    months = F.array(*[F.lit(m) for m in DANISH_MONTHS])
    return F.concat(
        F.dayofmonth(local).cast("string"),
        F.lit(". "),
        F.element_at(months, F.month(local)),
        F.lit(" "),
        F.year(local).cast("string"),
        F.lit(" kl. "),
        F.lpad(F.hour(local).cast("string"), 2, "0"),
        F.lit("."),
        F.lpad(F.minute(local).cast("string"), 2, "0"),
    )


def local_wall_clock(epoch: Column, zone: str = DISPLAY_ZONE) -> Column:
    """Wall clock in ``zone`` for an epoch, as ``TIMESTAMP_NTZ`` (independent of the session zone)."""
    from .zones import wall_clock

    return wall_clock(epoch, zone)
