"""Point-in-time statistics over daily histories.

The look-ahead boundary is stated once, here: a daily bar is visible at an
instant only if it opened at least one day before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.fixed_values import TIMEFRAME_SECONDS
from tidemark.functions import instants as ts
from tidemark.functions import money
from tidemark.operators import order_statistics

INSTRUMENT = ("venue", "symbol")


def to_refreshes(bars: DataFrame, lookback_days: int) -> DataFrame:
    """Attach each daily bar to the month starts it can serve.

    A bar serves the first refresh at or after its close (the as-of price), and
    every further refresh up to ``lookback_days`` after its open (the trailing
    window).  The refreshes follow from the bar alone, so there is no join: a
    range join becomes a projection followed by one keyed aggregation.
    """
    first = ts.refresh_on_or_after(F.col("open_time") + ts.days(1))
    last = F.date_trunc("month", F.col("open_time") + ts.days(lookback_days))
    span = F.when(first <= last, F.sequence(first, last, F.expr("INTERVAL 1 MONTH")))
    return bars.select(
        "*",
        F.explode(F.coalesce(span, F.array(first))).alias("as_of"),
    ).withColumn("in_window", F.col("open_time") + ts.days(lookback_days) >= F.col("as_of"))


def refresh_facts(bars: DataFrame, lookback_days: int) -> DataFrame:
    """Everything the rules need per (venue, symbol, refresh), in one shuffle.

    The group key includes the refresh, so even an instrument with a third of
    all bars is spread over its months, and a group never holds more than the
    bars of one window.
    """
    seen = F.col("in_window")
    return (
        to_refreshes(bars, lookback_days)
        .groupBy(*INSTRUMENT, "as_of")
        .agg(
            F.count_if(seen).alias("observations"),
            F.collect_list(F.when(seen, F.col("quote_volume"))).alias("volumes"),
            F.max_by("close", "open_time").alias("period_close"),
            F.min("open_time").alias("first_open"),
            F.max("open_time").alias("last_open"),
        )
        .select(
            *INSTRUMENT,
            "as_of",
            "observations",
            money.exact_median(F.col("volumes")).alias("median_quote_volume"),
            "period_close",
            "first_open",
            "last_open",
        )
    )


def window_at(
    bars: DataFrame, as_ofs: DataFrame, lookback_days: int, bar_seconds: int = TIMEFRAME_SECONDS["1d"]
) -> DataFrame:
    """Range join of bars to arbitrary instants: ``[as_of - L days, as_of - 1 bar]``.

    Each instant is fanned out to the calendar days its window touches, which
    turns the range into an equality on the day plus an exact filter.  The fan
    out is on the instants, never on the bars.  ``as_ofs`` has (venue, as_of).
    """
    floor = F.col("as_of") - ts.days(lookback_days)
    ceiling = F.col("as_of") - ts.seconds(bar_seconds)
    touched = as_ofs.distinct().select(
        "venue",
        "as_of",
        F.explode(F.sequence(F.to_date(floor), F.to_date(ceiling))).alias("day"),
    )
    return bars.withColumn("day", F.to_date("open_time")).join(touched, ["venue", "day"]).where(
        (F.col("open_time") >= floor) & (F.col("open_time") <= ceiling)
    )


def window_statistics(windowed: DataFrame) -> DataFrame:
    """Observation count (NULL turnover counted) and exact median per instant."""
    return (
        windowed.groupBy(*INSTRUMENT, "as_of")
        .agg(
            F.count("*").alias("observations"),
            F.collect_list("quote_volume").alias("volumes"),
        )
        .select(
            *INSTRUMENT,
            "as_of",
            "observations",
            money.exact_median(F.col("volumes")).alias("median_quote_volume"),
        )
    )


def window_medians(windowed: DataFrame) -> DataFrame:
    """The same for windows of fine bars: medians by counting, nothing gathered."""
    medians = order_statistics.exact_medians(windowed, [*INSTRUMENT, "as_of"], "quote_volume")
    return medians.withColumnRenamed("median", "median_quote_volume")


def close_as_of(bars: DataFrame, probes: DataFrame) -> DataFrame:
    """As-of join: the newest close visible at each (venue, symbol, as_of).

    Bars and probes are unioned and ordered by time inside (instrument, day), so
    neither a hot instrument nor very many probes of one are sorted in one task.
    A probe that finds nothing in its own day takes the close carried from the
    days before, which is a table of one row per instrument and day.
    At equal times the bar comes first: a bar closing exactly at the instant is
    visible.
    """
    closes = bars.select(
        *INSTRUMENT,
        (F.col("open_time") + ts.days(1)).alias("moment"),
        F.lit(0).alias("kind"),
        "close",
    )
    asked = probes.select(
        *INSTRUMENT,
        F.col("as_of").alias("moment"),
        F.lit(1).alias("kind"),
        F.lit(None).cast(money.PRICE).alias("close"),
    ).distinct()
    # Shuffled once, explicitly: both uses below are satisfied by this partitioning
    # and read the same exchange.  The keys are filtered here because Catalyst
    # would otherwise infer the filter on one of the two uses and plan them apart.
    timeline = (
        closes.unionByName(asked)
        .withColumn("day", F.date_trunc("day", "moment"))
        .where("venue IS NOT NULL AND symbol IS NOT NULL AND day IS NOT NULL")
        .repartition(*INSTRUMENT, "day")
    )
    within = (
        Window.partitionBy(*INSTRUMENT, "day")
        .orderBy("moment", "kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    daily = timeline.groupBy(*INSTRUMENT, "day").agg(
        F.max_by("close", F.when(F.col("kind") == 0, F.col("moment"))).alias("day_close")
    )
    before = (
        Window.partitionBy(*INSTRUMENT)
        .orderBy("day")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = daily.select(
        *INSTRUMENT,
        "day",
        F.last("day_close", ignorenulls=True).over(before).alias("carried"),
    )
    return (
        timeline.withColumn("in_day", F.last("close", ignorenulls=True).over(within))
        .where("kind = 1")
        .join(carried, [*INSTRUMENT, "day"])
        .select(
            *INSTRUMENT,
            F.col("moment").alias("as_of"),
            F.coalesce("in_day", "carried").alias("close_as_of"),
        )
    )


def so_far():
    """An instrument's refreshes up to the current one; bounded by their number."""
    return (
        Window.partitionBy(*INSTRUMENT)
        .orderBy("as_of")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def carry_close(grid: DataFrame) -> DataFrame:
    """Fill ``period_close`` forward over an instrument's own refreshes."""
    carried = F.last("period_close", ignorenulls=True).over(so_far())
    return grid.withColumn("close_as_of", carried)


def extents(bars: DataFrame) -> DataFrame:
    """First and last open time and bar count per instrument."""
    return bars.groupBy(*INSTRUMENT).agg(
        F.min("open_time").alias("first_open"),
        F.max("open_time").alias("last_open"),
        F.count("*").alias("bars"),
    )


def extents_of_facts(facts: DataFrame) -> DataFrame:
    """The same first and last open times, folded out of the refresh facts.

    Every bar belongs to at least one refresh, so nothing is lost.
    """
    return facts.groupBy(*INSTRUMENT).agg(
        F.min("first_open").alias("first_open"), F.max("last_open").alias("last_open")
    )


def observed_windows(extent: DataFrame) -> DataFrame:
    """The span a venue's bars cover: one row per venue, none when it has no bars."""
    return extent.groupBy("venue").agg(
        F.min("first_open").alias("observed_from"),
        F.max("last_open").alias("observed_to"),
        F.count("*").alias("series"),
    )


def span_days(first: Column, last: Column) -> Column:
    """Whole days between two instants."""
    return F.floor((F.unix_seconds(last) - F.unix_seconds(first)) / 86_400).cast("bigint")


def ordinals(bars: DataFrame) -> DataFrame:
    """Position of every bar in its instrument's history, oldest first.

    Rows are numbered inside (instrument, month) and shifted by the number of
    rows in earlier months, so no task sorts a whole history.
    """
    monthly = bars.withColumn("month", F.date_trunc("month", "open_time"))
    before = (
        Window.partitionBy(*INSTRUMENT)
        .orderBy("month")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = (
        monthly.groupBy(*INSTRUMENT, "month")
        .agg(F.count("*").alias("rows"))
        .select(
            *INSTRUMENT, "month", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("shift")
        )
    )
    inside = Window.partitionBy(*INSTRUMENT, "month").orderBy("open_time")
    return (
        monthly.withColumn("place", F.row_number().over(inside))
        .join(shifts, [*INSTRUMENT, "month"])
        .withColumn("ordinal", (F.col("shift") + F.col("place")).cast("bigint"))
        .drop("month", "place", "shift")
    )


def ordinals_in_place(bars: DataFrame) -> DataFrame:
    """The same for bars laid out by instrument: one window and no shuffle.

    What a history began with stands beside every bar.
    """
    by_time = Window.partitionBy(*INSTRUMENT).orderBy("open_time")
    return bars.withColumns(
        {
            "ordinal": F.row_number().over(by_time).cast("bigint"),
            "first_open": F.first("open_time").over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        }
    )
