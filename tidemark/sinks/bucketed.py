"""Stored bars laid out for work by instrument: joins and windows without a shuffle.

The files of every year are dealt into buckets by (venue, symbol).  A scan that reads
them bucket by bucket hands Catalyst rows that are already together by instrument, so
grouping, windows and joins by instrument, also by instrument and month or refresh,
plan no exchange over the stored bars.  A bucket is one task; where one instrument
holds a large part of all bars, ``table(by_instrument=False)`` reads the same files in
even splits and shuffles, as the other store does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import delete_path, path_exists, staging_path
from tidemark.sources import bars as bar_source

PARTITION = ("timeframe", "year")
_COLUMNS = [name for name in bar_source.BAR_COLUMNS if name not in PARTITION]


@dataclass(frozen=True)
class BucketedBars:
    """A bucketed table of bars at ``path``, known to the catalog as ``name``."""

    spark: SparkSession
    name: str
    path: str
    buckets: int

    def create(self) -> None:
        """Declare the table; what already lies at its path is found again."""
        types = {f.name: f.dataType.simpleString() for f in T.StructType.fromDDL(bar_source.BAR_SCHEMA)}
        columns = ", ".join(f"{name} {types[name]}" for name in _COLUMNS)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, timeframe string, year int) USING parquet "
            f"PARTITIONED BY ({', '.join(PARTITION)}) "
            f"CLUSTERED BY (venue, symbol) SORTED BY (venue, symbol, open_time) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        if path_exists(self.spark, self.path):
            self.spark.catalog.recoverPartitions(self.name)

    def table(self, by_instrument: bool = True) -> DataFrame:
        if by_instrument:
            return self.spark.table(self.name)
        schema = f"{bar_source.BAR_SCHEMA}, year int"
        return self.spark.read.schema(schema).parquet(self.path)

    def write(self, incoming: DataFrame) -> None:
        """Merge bars into the table; the copy observed last wins, and writing twice is harmless.

        As in the other store: only the partitions of the batch are read and replaced,
        and the merged rows are staged, since a job cannot overwrite what it reads.
        """
        staged: list[str] = []
        try:
            table = self._staged(incoming.select(*bar_source.BAR_COLUMNS), staged)
            wanted = F.lit(False)
            for row in table.select(*PARTITION).distinct().collect():
                wanted = wanted | ((F.col("timeframe") == row["timeframe"]) & (F.col("year") == row["year"]))
            kept = self.table(by_instrument=False).where(wanted) if path_exists(self.spark, self.path) else None
            if kept is not None:
                table = self._staged(table.unionByName(kept.select(*table.columns)).drop("year"), staged)
            # A task writes whole buckets, so a bucket of a year is one sorted file.
            dealt = table.repartition(self.buckets, "venue", "symbol").select(*_COLUMNS, *PARTITION)
            self._replace_partitions(dealt)
        finally:
            for path in staged:
                delete_path(self.spark, path)

    def _replace_partitions(self, rows: DataFrame) -> None:
        """Inserting into a table heeds the session's mode only, not an option of the write."""
        mode, conf = "spark.sql.sources.partitionOverwriteMode", self.spark.conf
        before = conf.get(mode)
        conf.set(mode, "dynamic")
        try:
            rows.write.mode("overwrite").insertInto(self.name)
        finally:
            conf.set(mode, before)

    def _staged(self, bars: DataFrame, staged: list[str]) -> DataFrame:
        path = staging_path(self.spark, "bars")
        staged.append(path)
        bar_source.newest_observation(bars).write.parquet(path)
        return self.spark.read.schema(bar_source.BAR_SCHEMA).parquet(path).withColumn("year", F.year("open_time"))

