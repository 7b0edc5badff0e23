"""Bars from a stream of prints; a bar appears only once it can no longer change.

What a venue was asked travels in the same stream as what it answered: a poll is a
row without a symbol whose time is the instant of observation.  Polls move the
watermark like prints do, so the last bar of a quiet market closes when somebody has
looked after its end, with no further print.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.fixed_values import TIMEFRAME_SECONDS
from tidemark.functions import money
from tidemark.sources.bars import first_and_last_by


def closed_bars(
    prints: DataFrame, timeframe: str, lateness: str, order_by: Sequence[str] = ("ts",)
) -> DataFrame:
    """Tumbling windows in append mode: closed bars only.

    A bar closes when the watermark, the newest print or poll minus the allowed
    lateness, has passed its end.
    """
    order = first_and_last_by(order_by)
    # Polls must reach the watermark: a condition that does not read the time would
    # be moved below it.
    is_print = F.when(F.col("ts").isNotNull(), F.col("symbol")).isNotNull()
    return (
        prints.withWatermark("ts", lateness)
        .where(is_print)
        .groupBy("venue", "symbol", F.window("ts", f"{TIMEFRAME_SECONDS[timeframe]} seconds"))
        .agg(
            F.min_by("price", order).cast(money.PRICE).alias("open"),
            F.max("price").cast(money.PRICE).alias("high"),
            F.min("price").cast(money.PRICE).alias("low"),
            F.max_by("price", order).cast(money.PRICE).alias("close"),
            F.sum("qty").cast(money.QUANTITY).alias("volume"),
            F.sum("quote_qty").cast(money.NOTIONAL).alias("quote_volume"),
        )
        .select(
            "venue",
            "symbol",
            F.lit(timeframe).alias("timeframe"),
            F.col("window.start").alias("open_time"),
            "open",
            "high",
            "low",
            "close",
            "volume",
            "quote_volume",
        )
    )


def land(prints: DataFrame, observed_at: Column, path: str, moment: str = "ts") -> None:
    """Add the prints of one poll to a landing folder, and after them the poll.

    The poll is a file of its own and the younger one, so that a stream that takes
    one file at a time never meets the poll before its prints.
    """
    prints.write.mode("append").parquet(path)
    given = {moment: observed_at}
    poll = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in prints.schema]
    prints.sparkSession.range(1, numPartitions=1).select(*poll).write.mode("append").parquet(path)


def landed_prints(spark: SparkSession, schema: StructType, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Prints and polls of a landing folder as a stream, oldest file first."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def append_available(bars: DataFrame, path: str, checkpoint: str) -> None:
    """Write every bar that has closed so far and stop."""
    (
        bars.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
