"""Cutting lineage with tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import staging_path


def written(frame: DataFrame, label: str, rows: int = 0) -> DataFrame:
    """``frame`` as a table that survives lost executors and is computed once.

    Rows of megabytes should lie in files of a few ``rows``, which are read one at a time.
    """
    path = staging_path(frame.sparkSession, label)
    writer = frame.write.option("maxRecordsPerFile", rows) if rows else frame.write
    writer.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """How many pieces of work a stage has: what the job sets, at least one."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def unused(columns: list[str], *wanted: str) -> list[str]:
    """Names like ``wanted`` that none of ``columns`` has; Spark does not tell case apart."""
    taken, found = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
