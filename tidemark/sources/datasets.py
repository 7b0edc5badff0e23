"""A venue's landed files: metadata, daily series and an optional spread snapshot."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import instants as ts
from tidemark.functions import money
from tidemark.session import path_exists

METADATA_FILES = ("symbol_metadata.json", "pair_metadata.json")
SPREAD_FILE = "spread_snapshot.json"

_METADATA = """map<string, struct<
  canonical: string, base: string, quote: string, status: string, tick_size: string,
  lot_size: string, min_notional: string>>"""
_SNAPSHOT = "struct<observed_at: string, bps: map<string, string>>"


def _read(text: Column, parsed: Column, kind: str, what: str) -> Column:
    """``parsed``, or a failed job naming what cannot be read; only NULL text may be NULL."""
    fault = F.concat(F.lit(f"{what}: not readable: "), text)
    return F.when(text.isNotNull() & parsed.isNull(), F.raise_error(fault).cast(kind)).otherwise(parsed)


def _money(text: Column, kind: str, what: str) -> Column:
    return _read(text, money.parse_money(text, kind), kind, what)


@dataclass(frozen=True)
class VenueFiles:
    metadata: DataFrame
    bars: DataFrame
    spreads: DataFrame


def load(spark: SparkSession, venue: str, root: str, series_per_line: bool = False) -> VenueFiles:
    """Read one venue's folder with declared schemas; nothing is inferred.

    Two metadata names are accepted.  A venue without a snapshot has an empty
    spread table, and a venue without metadata is an error, not an empty venue.
    """
    found = next((name for name in METADATA_FILES if path_exists(spark, f"{root}/{name}")), None)
    if found is None:
        raise FileNotFoundError(f"{root}: neither {' nor '.join(METADATA_FILES)}")
    described = (
        spark.read.text(f"{root}/{found}", wholetext=True)
        .select(
            F.explode(
                F.coalesce(
                    F.from_json("value", _METADATA), F.raise_error(F.lit(f"{root}/{found}: not readable"))
                )
            )
        )
        .select(
            F.lit(venue).alias("venue"),
            F.col("key").alias("symbol"),
            F.col("value.canonical").alias("canonical"),
            F.col("value.base").alias("base"),
            F.col("value.quote").alias("quote"),
            F.col("value.status").alias("status"),
            _money(F.col("value.tick_size"), money.PRICE, f"{root}/{found}: tick_size").alias("tick_size"),
            _money(F.col("value.lot_size"), money.LOT, f"{root}/{found}: lot_size").alias("lot_size"),
            _money(F.col("value.min_notional"), money.NOTIONAL, f"{root}/{found}: min_notional").alias("min_notional"),
        )
    )
    return VenueFiles(
        described, _series(spark, venue, root, series_per_line), _snapshot(spark, venue, root)
    )


def together(venues: list[VenueFiles]) -> VenueFiles:
    """Several venues as one data set; every row says which venue it is from."""
    metadata, bars, spreads = (
        reduce(DataFrame.unionByName, [getattr(v, part) for v in venues]) for part in ("metadata", "bars", "spreads")
    )
    return VenueFiles(metadata, bars, spreads)


def _series(spark: SparkSession, venue: str, root: str, per_line: bool) -> DataFrame:
    schema = "symbol string, timeframe string, rows array<array<string>>"
    if path_exists(spark, f"{root}/bars"):
        reader = spark.read.schema(schema).options(multiLine=not per_line, mode="FAILFAST")
        documents = reader.json(f"{root}/bars")
    else:
        documents = spark.createDataFrame([], schema)
    row = F.col("row")
    opened = F.coalesce(F.get(row, F.lit(0)), F.lit("null"))
    return documents.select(
        F.lit(venue).alias("venue"), "symbol", "timeframe", F.explode("rows").alias("row")
    ).select(
        "venue",
        "symbol",
        "timeframe",
        ts.from_epoch_millis(_read(opened, opened.try_cast("bigint"), "bigint", f"{root}/bars: open time")).alias("open_time"),
        _money(F.get(row, F.lit(1)), money.PRICE, f"{root}/bars: close").alias("close"),
        # An empty text means the venue gave no turnover, which is not zero.
        _money(F.nullif(F.get(row, F.lit(2)), F.lit("")), money.NOTIONAL, f"{root}/bars: turnover").alias("quote_volume"),
    )


def _snapshot(spark: SparkSession, venue: str, root: str) -> DataFrame:
    if not path_exists(spark, f"{root}/{SPREAD_FILE}"):
        return spark.createDataFrame(
            [], f"venue string, symbol string, spread_bps {money.BPS}, observed_at timestamp"
        )
    path = f"{root}/{SPREAD_FILE}"
    body = F.from_json("value", _SNAPSHOT)
    body = F.when(body["observed_at"].isNull() | body["bps"].isNull(), F.raise_error(F.lit(f"{path}: not readable")).cast(_SNAPSHOT)).otherwise(body)
    return (
        spark.read.text(f"{root}/{SPREAD_FILE}", wholetext=True)
        .select(body["observed_at"].alias("observed"), F.explode(body["bps"]))
        .select(
            F.lit(venue).alias("venue"),
            F.col("key").alias("symbol"),
            _money(F.col("value"), money.BPS, f"{path}: bps").alias("spread_bps"),
            _read(F.col("observed"), F.try_to_timestamp("observed"), "timestamp", f"{path}: observed_at").alias("observed_at"),
        )
    )
