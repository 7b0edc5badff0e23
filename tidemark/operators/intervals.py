"""Interval joins: which rows lie inside one of many intervals of their key.

An instant is matched with intervals by equality on bins of time.  How wide the bins
are follows from an interval's own length: it is sent to bins of the widest width
that is not longer than itself, so it covers at most ``FAN`` and two of them, however
long it is, and one without an end is a single bin.  An instant lies in exactly one
bin of each width, so it is compared only with intervals that pass nearby; a key with
very many rows is spread over its bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import lookup

#: How much wider the next bins are.
FAN = 32
#: Widths of bins in seconds, up to 34 years; what outlasts 32 of those is one bin.
WIDTHS = tuple(FAN**level for level in range(7))
ALL_TIME = len(WIDTHS)


def merged(intervals: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Overlapping and touching intervals of a key joined, so that the rest are disjoint.

    Half-open; a missing end never ends.  Intervals without a start, or that end
    before they begin, hold nothing and are left out.
    """
    # An end after every instant, for the comparison only.
    until = F.coalesce(F.unix_micros(end), F.lit(2**63 - 1))
    rows = intervals.select(*keys, F.unix_micros(start).alias("_from"), until.alias("_until")).where("_from < _until")
    before = Window.partitionBy(*keys).orderBy("_from", "_until").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*keys).orderBy("_from", "_until").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = F.max("_until").over(before)
    fresh = F.when(reached.isNull() | (F.col("_from") > reached), 1).otherwise(0)
    return (
        rows.withColumn("_fresh", fresh)
        .withColumn("_island", F.sum("_fresh").over(so_far))
        .groupBy(*keys, "_island")
        .agg(F.min("_from").alias("_from"), F.max("_until").alias("_until"))
        .drop("_island")
    )


def _level(seconds: Column) -> Column:
    level = F.lit(0)
    for at, width in enumerate(WIDTHS):
        level = F.when(seconds >= width, F.lit(at)).otherwise(level)
    return F.when(seconds >= WIDTHS[-1] * FAN, F.lit(ALL_TIME)).otherwise(level)


def _bin(micros: Column, level: int) -> Column:
    """Where the bin begins, in microseconds."""
    if level == ALL_TIME:
        return F.lit(0).cast("bigint")
    return micros - F.pmod(micros, F.lit(WIDTHS[level] * 1_000_000))


def binned(disjoint: DataFrame, level: int) -> DataFrame:
    """The intervals of one level, once for every bin they cover."""
    first, last = _bin(F.col("_from"), level), _bin(F.col("_until") - 1, level)
    step = F.lit(1 if level == ALL_TIME else WIDTHS[level] * 1_000_000).cast("bigint")
    return disjoint.where(F.col("_level") == level).drop("_level").withColumn("_bin", F.explode(F.sequence(first, last, step)))


def label(
    facts: DataFrame, intervals: DataFrame, keys: Sequence[str], moment: str, start: str, end: str, name: str
) -> DataFrame:
    """``facts`` with a flag: does an interval of the row's key hold its instant?

    Every row stays once: intervals are merged first, so at most one of each level
    holds an instant.  A missing instant has no answer, a missing key no interval.
    """
    seconds = (F.col("_until") - F.col("_from")) / 1_000_000
    disjoint = merged(intervals, keys, start, end).withColumn("_level", _level(seconds))
    # At most one number per width: which levels occur at all.
    levels = sorted(r["_level"] for r in disjoint.select("_level").distinct().collect())
    at = F.unix_micros(moment)
    rows, found = facts, F.lit(False)
    for level in levels:
        # Disjoint intervals that are no shorter than a bin: at most three share one.
        # Only those below a second can be more, and end within that second.
        hit = f"_hit_{level}"
        near = (
            binned(disjoint, level)
            .groupBy(*keys, "_bin")
            .agg(F.collect_list(F.struct("_from", "_until")).alias(hit))
        )
        rows = lookup(rows.withColumn("_bin", _bin(at, level)), near, [*keys, "_bin"]).drop("_bin")
        held = F.exists(hit, lambda i: (i["_from"] <= at) & (at < i["_until"]))
        found = found | F.coalesce(held, F.lit(False))
    return rows.select(*facts.columns, F.when(F.col(moment).isNotNull(), found).alias(name))
