"""Exact medians without gathering or sorting a group's values.

A median is found by counting: the range of a group's values is cut into ``RANGES``
pieces, the values in each are counted (each task hands on one number per piece), and
the piece that holds the middle is cut again until it holds a single value.  A group
of any size costs a few passes and never meets in one task.  For an even number of
values both middle ones are looked for, and their mean keeps every digit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import money
from tidemark.session import BROADCAST_ROW_LIMIT, small, staging_path

#: Pieces a range is cut into: 1,024 of them reach one value of 34 digits in twelve passes
#: at the very worst, and usually in two.
RANGES = 1_024


def _written(frame: DataFrame, label: str) -> DataFrame:
    path = staging_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def exact_medians(values: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """keys, observations, median: one row per group of ``values``.

    Observations count every row, the median only values that are there; a group
    without any has none.  ``values`` is read once per pass, so hand in a table.
    """
    keys = list(keys)
    value = F.col(column).cast(money.NOTIONAL)
    given = values.select(*keys, value.alias("_v"))
    groups = _written(
        given.groupBy(*keys).agg(
            F.count("*").alias("observations"), F.count("_v").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
        ),
        "median-groups",
    )
    ranks = F.array_distinct(F.array(F.expr("(_n - 1) div 2"), F.expr("_n div 2")))
    targets = groups.where("_n > 0").select(*keys, F.explode(ranks).alias("_rank"), "_low", "_high", F.lit(0).cast("bigint").alias("_below"))
    found = []
    while True:
        found.append(targets.where("_low = _high").select(*keys, "_rank", F.col("_low").alias("_v")))
        targets = targets.where("_low < _high")
        if not targets.limit(1).count():
            break
        targets = _narrowed(given, targets, keys)
    middle = found[0]
    for more in found[1:]:
        middle = middle.unionByName(more)
    # One or two rows per group; the mean of the two is exact at one more digit.
    sums = middle.groupBy(*keys).agg(F.min("_v").alias("_one"), F.max("_v").alias("_two"))
    mean = ((F.col("_one") + F.col("_two")) * F.lit("0.5").cast("decimal(1,1)")).cast(money.MEDIAN)
    together = [F.col(f"g.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    return (
        groups.alias("g").join(sums.alias("s"), together, "left")
        .select(*[f"g.{k}" for k in keys], "observations", mean.alias("median"))
    )


def _narrowed(given: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """The piece of each target's range that holds its rank, as a written table.

    A piece keeps the least and greatest value seen in it, so a range with more than
    one value always gets smaller: its ends lie in different pieces.
    """
    ranges = targets.select(*keys, "_low", "_high", "_below").distinct()
    # Rounding to double keeps the order of values, which is all a piece needs.
    place = (F.col("_v") - F.col("_low")).cast("double") / (F.col("_high") - F.col("_low")).cast("double") * RANGES
    piece = F.least(F.floor(place).cast("int"), F.lit(RANGES - 1))
    inside = _with_ranges(given, ranges, keys).where((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
    counted = inside.groupBy(*keys, "_low", "_below", piece.alias("_piece")).agg(
        F.count("*").alias("_count"), F.min("_v").alias("_least"), F.max("_v").alias("_most")
    )
    earlier = Window.partitionBy(*keys, "_low", "_below").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = counted.withColumn("_start", F.col("_below") + F.coalesce(F.sum("_count").over(earlier), F.lit(0)))
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"p.{k}")) for k in (*keys, "_low", "_below")]
    holds = (F.col("t._rank") >= F.col("p._start")) & (F.col("t._rank") < F.col("p._start") + F.col("p._count"))
    return _written(
        targets.alias("t").join(pieces.alias("p"), same).where(holds).select(
            *[f"t.{k}" for k in keys], "t._rank", F.col("p._least").alias("_low"), F.col("p._most").alias("_high"),
            F.col("p._start").alias("_below"),
        ),
        "median-ranges",
    )


def _with_ranges(given: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Values beside the one or two ranges their group still looks into."""
    open_ = ranges.groupBy(*keys).agg(F.collect_list(F.struct("_low", "_high", "_below")).alias("_ranges"))
    groups = open_.limit(BROADCAST_ROW_LIMIT + 1).count()
    same = [F.col(f"v.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    beside = given.alias("v").join(small(open_, groups).alias("r"), same)
    return beside.select(*[f"v.{k}" for k in keys], "_v", F.inline("_ranges"))
