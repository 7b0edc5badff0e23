"""Comparison of two sources that should describe the same instruments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("venue", "symbol")


def disagreement(archive: DataFrame, current: DataFrame) -> DataFrame:
    """Symbols only one source knows, in both directions, in one full outer join."""
    left = archive.select(*KEY).distinct().withColumn("in_archive", F.lit(True))
    right = current.select(*KEY).distinct().withColumn("in_current", F.lit(True))
    return (
        left.join(right, list(KEY), "full")
        .where(F.col("in_archive").isNull() | F.col("in_current").isNull())
        .select(
            *KEY,
            F.when(F.col("in_current").isNull(), F.lit("archive_only"))
            .otherwise(F.lit("current_only"))
            .alias("side"),
        )
    )


def visibility(every: DataFrame, visible: DataFrame) -> DataFrame:
    """How many of all pairs a jurisdiction can see, per venue."""
    seen = visible.select(*KEY).distinct().withColumn("seen", F.lit(True))
    return (
        every.select(*KEY)
        .distinct()
        .join(seen, list(KEY), "left")
        .groupBy("venue")
        .agg(F.count("*").alias("pairs"), F.count("seen").alias("visible"))
    )


def not_yet_stored(wanted: DataFrame, stored: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Resume: wanted instruments without any stored series.

    ``also`` names further columns a series is stored by, such as its year.
    """
    keys = [*KEY, *also]
    return wanted.join(stored.select(*keys).distinct(), keys, "left_anti")
