"""Instants: refresh boundaries, timeframes and closing times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.fixed_values import TIMEFRAME_SECONDS


def days(count: int) -> Column:
    return F.make_dt_interval(days=F.lit(count))


def seconds(count: int) -> Column:
    return F.expr(f"make_dt_interval(0, 0, 0, {count})")


def refresh_on_or_after(instant: Column) -> Column:
    """The first UTC month start that is not before ``instant``."""
    floor = F.date_trunc("month", instant)
    return F.when(floor == instant, floor).otherwise(floor + F.expr("INTERVAL 1 MONTH"))


def refreshes_between(first: Column, last: Column) -> Column:
    """Array of month starts within [first, last], both ends included."""
    start = refresh_on_or_after(first)
    stop = F.date_trunc("month", last)
    none = F.array().cast("array<timestamp>")
    return F.when(start <= stop, F.sequence(start, stop, F.expr("INTERVAL 1 MONTH"))).otherwise(
        none
    )


def timeframe_seconds(timeframe: Column) -> Column:
    """Length of a bar; NULL for a timeframe no venue serves."""
    pairs = [F.lit(item) for pair in TIMEFRAME_SECONDS.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), timeframe)


def close_time(open_time: Column, timeframe: Column) -> Column:
    """When a bar became knowable: derived, never stored."""
    length = timeframe_seconds(timeframe).cast("decimal(18,6)")
    return open_time + F.make_dt_interval(secs=length)


def from_epoch_millis(millis: Column) -> Column:
    return F.timestamp_millis(millis.cast("bigint"))


def is_listed(listed_at: Column, delisted_at: Column, as_of: Column) -> Column:
    """Listing is inclusive, delisting exclusive, no delisting means still listed."""
    return (listed_at <= as_of) & (delisted_at.isNull() | (as_of < delisted_at))


def iso(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss")


def month_label(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM")
