"""Calendars and request journals as files that can be diffed and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import instants as ts
from tidemark.operators.listing import CALENDAR_COLUMNS, METHOD

_ENTRY = """struct<
  symbol: string, listed_at: string, delisted_at: string, provenance: string, note: string,
  metadata_available: boolean>"""


def write_calendar(calendar: DataFrame, path: str, methodology: str = METHOD) -> None:
    """Entries in order, with the method stated beside every one of them."""
    (
        calendar.select(*CALENDAR_COLUMNS)
        .withColumn("methodology", F.lit(methodology))
        .repartitionByRange("venue", "symbol")
        .sortWithinPartitions("venue", "symbol")
        .write.mode("overwrite")
        .parquet(path)
    )


def read_calendar_json(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Calendar documents ``{venue, methodology, entries: [...]}`` to entries.

    Instants carry their offset.  An entry with an instant that cannot be read, or
    without a listing instant, fails the job: a lost delisting would turn a dead
    symbol into a survivor.
    """
    documents = (
        spark.read.schema(f"venue string, methodology string, entries array<{_ENTRY}>")
        .options(multiLine=one_per_file, mode="FAILFAST")
        .json(path)
    )
    entry = documents.select("venue", "methodology", F.inline("entries"))
    has_offset = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"

    def instant(name: str, required: bool) -> Column:
        read = F.when(F.col(name).rlike(has_offset), F.try_to_timestamp(F.col(name)))
        fault = F.concat_ws(
            " ", F.lit("calendar:"), "venue", "symbol", F.lit(f"{name}: not an instant with an offset:"), F.coalesce(name, F.lit("null"))
        )
        wrong = read.isNull() if required else read.isNull() & F.col(name).isNotNull()
        return F.when(wrong, F.raise_error(fault).cast("timestamp")).otherwise(read).alias(name)

    return entry.select(
        "venue",
        "symbol",
        instant("listed_at", required=True),
        instant("delisted_at", required=False),
        "provenance",
        F.coalesce("note", F.lit("")).alias("note"),
        "metadata_available",
        "methodology",
    )


def calendar_documents(calendar: DataFrame, methodology: str = METHOD) -> DataFrame:
    """One document per venue; its size is the number of symbols a venue lists."""
    stamp = lambda name: F.concat(ts.iso(F.col(name)), F.lit("+00:00")).alias(name)
    entry = F.struct(
        "symbol",
        stamp("listed_at"),
        stamp("delisted_at"),
        "provenance",
        "note",
        "metadata_available",
    )
    return calendar.groupBy("venue").agg(
        F.lit(methodology).alias("methodology"),
        F.sort_array(F.collect_list(entry)).alias("entries"),
    )


def write_journal(journal: DataFrame, path: str) -> None:
    """One JSON object per attempt, parameters as an object."""
    (
        journal.withColumn("params", F.str_to_map("params", F.lit("&"), F.lit("=")))
        .write.mode("overwrite")
        .json(path)
    )


JOURNAL_SCHEMA = """venue string, method string, url string, params map<string,string>,
  requested_at timestamp, responded_at timestamp, status int, payload_bytes bigint, attempt int,
  outcome string, detail string, run string"""


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JOURNAL_SCHEMA).option("mode", "FAILFAST").json(path)
