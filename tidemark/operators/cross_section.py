"""Cross-sectional features: defined over one universe slice, members only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.policy import SLICE


def rank_and_score(members: DataFrame, value: str) -> DataFrame:
    """Rank and z-score of ``value`` within each slice.

    All three come from one shuffle of the members by slice, so what makes the
    members is computed once; a slice is at most one venue's instruments.
    """
    number = F.col(value).cast("double")
    whole = Window.partitionBy(*SLICE)
    mean, deviation = F.avg(number).over(whole), F.stddev_samp(number).over(whole)
    return members.withColumn("rank", F.rank().over(whole.orderBy(F.col(value).desc()))).withColumn(
        "z_score", (number - mean) / F.nullif(deviation, F.lit(0.0))
    )
