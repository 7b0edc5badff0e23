"""Incremental bar ingestion into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidemark.sinks.bars import BarStore


#: Landed files a batch takes in; a backlog of more is several batches.
FILES_PER_BATCH = 1_000


def landed_bars(
    spark: SparkSession, schema: StructType, path: str, files_per_batch: int = FILES_PER_BATCH
) -> DataFrame:
    """New parquet files in a landing folder, as a stream of bounded batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest_available(stream: DataFrame, store: BarStore, checkpoint: str) -> None:
    """Take in everything that has landed, batch after batch, and stop.

    A batch that is replayed after a failure merges to the same rows, because
    the store keeps one row per key.
    """
    (
        stream.writeStream.foreachBatch(lambda batch, _: store.write(batch) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
