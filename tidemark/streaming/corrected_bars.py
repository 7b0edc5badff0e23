"""Bars that stay right when prints come late.

The watermark of a streaming aggregation drops what comes behind it.  Here every
batch archives its prints first; bars that the watermark has passed with this batch
are built from the archive and published, and prints behind the watermark are kept
on a side path: they are counted, and the published bars they belong to, and only
those, are built again from the archive and merged into the store.

Everything a batch writes carries its number and replaces what an earlier attempt
of the same batch wrote, so a replay after a failure changes nothing.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.fixed_values import TIMEFRAME_SECONDS
from tidemark.session import list_names, path_exists
from tidemark.sinks.bars import BarStore
from tidemark.sources import bars as bar_source

_KEY = ("venue", "symbol", "open_time")
_DAY_MICROS = 86_400_000_000


def _day(micros: int) -> str:
    return (datetime.date(1970, 1, 1) + datetime.timedelta(days=micros // _DAY_MICROS)).isoformat()


@dataclass(frozen=True)
class CorrectedBars:
    """A stream of prints and polls kept as closed bars in ``store``.

    ``path`` holds the archive of prints by day and batch, the late prints, one
    progress row per batch, and the stream's checkpoint, which numbers the batches.
    """

    store: BarStore
    path: str
    timeframe: str
    lateness_seconds: int
    order_by: Sequence[str] = ("ts",)

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def run_available(self, stream: DataFrame) -> None:
        """Take in everything that has landed and stop."""
        (
            stream.writeStream.foreachBatch(lambda batch, number: self.take(batch, number))
            .option("checkpointLocation", f"{self.path}/checkpoint")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )

    def take(self, batch: DataFrame, number: int) -> None:
        """Archive one batch, publish the bars it closes and correct those it touches."""
        before = self._watermark(number - 1)
        prints = batch.where("symbol IS NOT NULL").withColumns(
            {"open_time": self._opened(), "day": F.date_format(self._opened(), "yyyy-MM-dd"), "batch": F.lit(number)}
        )
        # Ranges of time, so that a crowded day is several files and a quiet one a single file.
        (
            prints.repartitionByRange("open_time")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("day", "batch")
            .parquet(f"{self.path}/prints")
        )
        seen = batch.agg(
            F.max(F.unix_micros("ts")).alias("newest"),
            F.count("symbol").alias("rows"),
            F.collect_set(F.when(F.col("symbol").isNotNull(), F.date_format(self._opened(), "yyyy-MM-dd"))).alias("days"),
        ).first()
        moved = [] if seen["newest"] is None else [seen["newest"] - self.lateness_seconds * 1_000_000]
        after = max([*moved, *([] if before is None else [before])], default=None)

        late = self._late(seen["days"], number, before)
        if after is not None:
            touched = late.groupBy(*_KEY).agg(F.count("*").alias("prints"))
            self._publish(self._closing(before, after), touched, after, number)
        counts = late.agg(F.count("*").alias("prints"), F.count_distinct(*_KEY).alias("bars")).first()
        self.spark.createDataFrame(
            [(after, seen["rows"], counts["prints"], counts["bars"])],
            "watermark_micros bigint, prints bigint, late_prints bigint, corrected_bars bigint",
        ).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/progress/batch={number}")

    def late_prints(self) -> DataFrame:
        """Every print that came behind the watermark, with the batch that brought it."""
        if not path_exists(self.spark, f"{self.path}/late"):
            return self.spark.createDataFrame([], "venue string, symbol string, open_time timestamp, batch int")
        return self.spark.read.parquet(f"{self.path}/late")

    def progress(self) -> DataFrame:
        """Per batch: watermark, prints, late prints, and bars they corrected."""
        return self.spark.read.parquet(f"{self.path}/progress")

    def _size(self) -> int:
        return TIMEFRAME_SECONDS[self.timeframe] * 1_000_000

    def _opened(self) -> Column:
        micros = F.unix_micros("ts")
        return F.timestamp_micros(micros - F.pmod(micros, F.lit(self._size())))

    def _end(self) -> Column:
        return F.unix_micros("open_time") + self._size()

    def _watermark(self, number: int) -> int | None:
        path = f"{self.path}/progress/batch={number}"
        if number < 0 or not path_exists(self.spark, path):
            return None
        return self.spark.read.parquet(path).first()["watermark_micros"]

    def _archive(self, days: Sequence[str]) -> DataFrame | None:
        """The archived prints of some days; folders of other days are not even listed."""
        if not days:
            return None
        root = f"{self.path}/prints"
        return self.spark.read.option("basePath", root).parquet(*[f"{root}/day={day}" for day in sorted(days)])

    def _late(self, days: Sequence[str], number: int, before: int | None) -> DataFrame:
        """The prints of this batch whose bar had been published, as a written table."""
        path = f"{self.path}/late/batch={number}"
        mine = self._archive(days)
        if mine is None:
            return self.spark.createDataFrame([], "venue string, symbol string, open_time timestamp")
        behind = F.lit(False) if before is None else self._end() <= before
        mine.where((F.col("batch") == number) & behind).drop("day", "batch").write.mode("overwrite").parquet(path)
        return self.spark.read.schema(mine.drop("day", "batch").schema).parquet(path)

    def _closing(self, before: int | None, after: int) -> DataFrame | None:
        """Archived prints of the bars that the watermark passes with this batch."""
        folders = list_names(self.spark, f"{self.path}/prints") if path_exists(self.spark, f"{self.path}/prints") else []
        days = [name.removeprefix("day=") for name in folders if name.startswith("day=")]
        first = "" if before is None else _day(before - self._size())
        found = self._archive([day for day in days if first <= day <= _day(after)])
        if found is None:
            return None
        return found.where((self._end() <= after) & (F.lit(True) if before is None else self._end() > before))

    def _publish(self, closing: DataFrame | None, touched: DataFrame, after: int, number: int) -> None:
        days = [r["day"] for r in touched.select(F.date_format("open_time", "yyyy-MM-dd").alias("day")).distinct().collect()]
        again = self._archive(days)
        if again is not None:
            again = again.join(touched.select(*_KEY), list(_KEY), "left_semi")
        parts = [p.drop("day", "batch") for p in (closing, again) if p is not None]
        if not parts:
            return
        prints = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        # The batch number in the microseconds: a later correction was observed later.
        observed = F.timestamp_micros(F.lit(after + self.lateness_seconds * 1_000_000 + number))
        bars = bar_source.from_prints(prints.drop("open_time"), self.timeframe, self.order_by)
        self.store.write(bars.withColumns({"is_closed": F.lit(True), "observed_at": observed}))
