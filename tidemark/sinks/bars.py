"""Stored bars: one row per key, partitioned for range reads, safe to write twice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import money
from tidemark.sources import bars as bar_source
from tidemark.session import delete_path, path_exists, staging_path

PARTITION = ("venue", "timeframe", "month")
ROWS_PER_FILE = 2_000_000


def with_month(bars: DataFrame) -> DataFrame:
    return bars.withColumn("month", F.date_format("open_time", "yyyy-MM"))


@dataclass(frozen=True)
class BarStore:
    """A parquet dataset keyed by (venue, symbol, timeframe, open_time)."""

    spark: SparkSession
    path: str

    def exists(self) -> bool:
        return path_exists(self.spark, self.path)

    def table(self) -> DataFrame:
        # A declared schema: left to inference, the partition value 1d is a number.
        schema = f"{bar_source.BAR_SCHEMA}, month string"
        return self.spark.read.schema(schema).parquet(self.path)

    def read(
        self, wanted: DataFrame, start: Column, end: Column, closed_only: bool = True
    ) -> DataFrame:
        """Bars of an explicit instrument set in ``[start, end)``, closed by default.

        The months of the range prune partitions; the open time and the flag are
        pushed to the scan; the instruments are a semi-join.
        """
        months = F.col("month").between(
            F.date_format(start, "yyyy-MM"), F.date_format(end, "yyyy-MM")
        )
        ranged = bar_source.within(self.table().where(months), start, end, not closed_only)
        return bar_source.for_instruments(ranged, wanted).select(*bar_source.BAR_COLUMNS)

    def write(self, incoming: DataFrame) -> int:
        """Merge bars into the store; the copy observed last wins.  Returns rows kept.

        The incoming rows are staged first, so whatever produces them runs once.
        Whole partitions are replaced, so the stored rows of the touched
        partitions are merged in and the result staged as well: a job cannot
        overwrite what it is reading, and a rerun after a failure starts from
        the same inputs.  The touched partitions are a short list of names and
        go into the scan as literals, so nothing else of the store is read.  The
        staged copies are deleted once the store is written.
        """
        staged: list[str] = []
        try:
            return self._merge(incoming, staged)
        finally:
            for path in staged:
                delete_path(self.spark, path)

    def touched(self, batch: DataFrame) -> DataFrame:
        """The stored rows of the partitions that ``batch`` (with its month) falls into."""
        months: dict[tuple[str, str], list[str]] = {}
        for row in batch.select(*PARTITION).distinct().collect():
            months.setdefault((row["venue"], row["timeframe"]), []).append(row["month"])
        wanted = F.lit(False)
        for (venue, timeframe), some in sorted(months.items()):
            wanted = wanted | ((F.col("venue") == venue) & (F.col("timeframe") == timeframe) & F.col("month").isin(*sorted(some)))
        return self.table().where(wanted)

    def _merge(self, incoming: DataFrame, staged: list[str]) -> int:
        table = self._staged(incoming.select(*bar_source.BAR_COLUMNS), staged)
        if self.exists():
            kept = self.touched(table)
            table = self._staged(table.unionByName(kept.select(*table.columns)).drop("month"), staged)
        size = (
            table.groupBy(*PARTITION)
            .agg(F.count("*").alias("bars"))
            .agg(F.coalesce(F.sum("bars"), F.lit(0)).alias("rows"), F.count("*").alias("parts"))
            .first()
        )
        # Ranges over (partition, symbol, time) cut a crowded venue-month into
        # several files instead of sending it to one task.  There are as many as
        # the rows need, or enough to write the touched partitions side by side.
        ranges = max(
            -(-size["rows"] // ROWS_PER_FILE),
            min(self.spark.sparkContext.defaultParallelism, size["parts"]),
            1,
        )
        (
            table.repartitionByRange(ranges, *PARTITION, "symbol", "open_time")
            .sortWithinPartitions(*PARTITION, "symbol", "open_time")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*PARTITION)
            .parquet(self.path)
        )
        return size["rows"]

    def _staged(self, bars: DataFrame, staged: list[str]) -> DataFrame:
        path = staging_path(self.spark, "bars")
        staged.append(path)
        bar_source.newest_observation(bars).write.parquet(path)
        return with_month(self.spark.read.schema(bar_source.BAR_SCHEMA).parquet(path))


SERIES_SCHEMA = (
    "venue string, symbol string, timeframe string, open_millis bigint, "
    f"close {money.PRICE}, quote_volume {money.NOTIONAL}"
)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SERIES_SCHEMA).parquet(path)


def write_series(bars: DataFrame, path: str) -> None:
    """Reduced daily series (open millis, close, turnover) as one dataset."""
    bars.select(
        "venue",
        "symbol",
        "timeframe",
        F.unix_millis("open_time").alias("open_millis"),
        "close",
        "quote_volume",
    ).write.mode("overwrite").partitionBy("venue", "timeframe").parquet(path)
