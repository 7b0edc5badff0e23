"""Session settings, literal dimensions and the shared staging folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dimensions built from Python parameters are broadcast only up to this many
#: rows; the row count is known when the plan is built, so the check is exact.
BROADCAST_ROW_LIMIT = 50_000


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings whose value changes results, not just speed."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def build_session(app_name: str = "tidemark", **settings: str) -> SparkSession:
    """A session with adaptive execution, UTC time and wide object-hash aggregation."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Split a hot key even where the next step must then shuffle once more.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        # The exact median gathers at most one window per group; the default of
        # 128 groups would push every such aggregation into the sort path.
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "65536")
        # Call-site capture costs milliseconds for every column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def sized_for(input_bytes: int) -> dict[str, str]:
    """Shuffle settings for a job that reads ``input_bytes``.

    Adaptive execution merges small partitions but cannot split what started too
    coarse, so the starting number follows the input: about 128 MB each, were
    everything shuffled, and never fewer than Spark's default.
    """
    target = 128 * 1024**2
    partitions = min(max(200, -(-input_bytes // target)), 200_000)
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(2 * target),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target),
    }


def dimension(spark: SparkSession, rows: Sequence[dict], schema: pa.Schema) -> DataFrame:
    """A parameter table held in the plan itself, so its size is known to Catalyst."""
    return spark.createDataFrame(pa.Table.from_pylist(list(rows), schema=schema))


def small(frame: DataFrame, known_rows: int) -> DataFrame:
    """Mark a side for broadcast when its known row count is inside the limit.

    Beyond the limit the frame is returned untouched and the join shuffles.
    """
    return F.broadcast(frame) if known_rows <= BROADCAST_ROW_LIMIT else frame


def lookup(facts: DataFrame, reference: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join a large table to an instrument-level one without shuffling the large side.

    The smaller side is counted first, up to the limit.  Inside the limit it is
    broadcast, so a key with a third of all rows stays spread over the tasks that
    read it.  Beyond it the join shuffles and adaptive execution splits hot keys.
    """
    counted = reference.limit(BROADCAST_ROW_LIMIT + 1).count()
    return facts.join(small(reference, counted), keys, how)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; for folders whose number of entries is small, such as days."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop_path)
    return [status.getPath().getName() for status in found]


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def staging_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder all executors share.

    ``spark.checkpoint.dir`` names that folder on a cluster.  Only where it is
    unset, as on a laptop, is a temporary folder used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
