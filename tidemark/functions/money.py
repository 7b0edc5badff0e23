"""Exact decimals: types, parsing, medians and basis points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE = "decimal(20,10)"
QUANTITY = "decimal(24,8)"
#: Four digits short of Spark's maximum so that (a + b) / 2 keeps every digit.
NOTIONAL = "decimal(34,13)"
#: Lots: sixteen whole digits and all decimals that a decimal can hold beside them.  Times
#: a price, eleven decimals are kept, more than any account is stated in.
LOT = "decimal(38,22)"
MEDIAN = "decimal(37,14)"
BPS = "decimal(20,10)"

BASIS_POINTS = 10_000


def parse_money(text: Column, kind: str) -> Column:
    """Decimal text to an exact decimal; anything else (NaN included) is NULL."""
    return text.try_cast(kind)


def exact_median(values: Column) -> Column:
    """Median of an array of decimals: the middle value, or the mean of the two.

    An empty array has no median, so the answer is NULL rather than zero.
    """
    ordered = F.sort_array(values)
    count = F.size(values)
    below = F.get(ordered, ((count - 1) / 2).cast("int"))
    above = F.get(ordered, (count / 2).cast("int"))
    return F.when(count > 0, ((below + above) * F.lit("0.5").cast("decimal(1,1)")).cast(MEDIAN))


def spread_bps(bid: Column, ask: Column) -> Column:
    """(ask - bid) over the mid price, in basis points; NULL for an unusable book."""
    usable = (bid > 0) & (ask > 0) & (ask >= bid)
    doubled = F.lit(2 * BASIS_POINTS).cast("decimal(5,0)")
    width = ((ask - bid) * doubled).cast("decimal(27,10)")
    return F.when(usable, F.try_divide(width, (bid + ask).cast("decimal(21,10)")).cast(BPS))


def power_of_ten(exponent: Column, kind: str = LOT) -> Column:
    """10 to the power ``-exponent``, exactly; NULL where ``kind`` cannot hold it."""
    text = F.when(exponent <= 0, F.rpad(F.lit("1"), 1 - exponent, F.lit("0"))).otherwise(
        F.concat(F.lit("0."), F.repeat(F.lit("0"), exponent - 1), F.lit("1"))
    )
    value = text.try_cast(kind)
    return F.when(value > 0, value)
