"""Danish currency text, as the listing page formats prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Danish grouping uses '.', the decimal mark is ',', a no-break space
# precedes the currency sign, and DKK is written 'kr.'.
NBSP = " "
CURRENCY_SIGNS = {"DKK": "kr."}


def danish_price(amount: Column, currency: Column) -> Column:
    """``1234.5, 'DKK'`` -> ``1.234,50 kr.``; another currency keeps its code; halves round away from zero."""
    number = F.translate(F.format_number(F.round(amount, 2), 2), ",.", ".,")
    sign = F.coalesce(
        F.when(currency == "DKK", F.lit(CURRENCY_SIGNS["DKK"])),
        currency,
    )
    return F.concat(number, F.lit(NBSP), sign)
