"""Tiny markets with known answers."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.functions import money
from tidemark.parameters import Thresholds, VenueProfile
from tidemark.plans.universe import Market
from tidemark.sources.bars import BAR_COLUMNS

DECISION = dt.datetime(2024, 6, 1)
VENUE = "test_venue"


def history(symbol, days=200, volume="1000", until=DECISION, close="100", skip=()):
    """Daily bars ending the day before ``until``: rows of (symbol, open, close, turnover)."""
    return [
        (symbol, until - dt.timedelta(days=n), close, volume)
        for n in range(days, 0, -1)
        if n not in skip
    ]


def bars(spark, rows):
    frame = spark.createDataFrame(
        rows, "symbol string, open_time timestamp_ntz, price string, turnover string"
    )
    price = F.col("price").cast(money.PRICE)
    return frame.select(
        F.lit(VENUE).alias("venue"),
        "symbol",
        F.lit("1d").alias("timeframe"),
        F.col("open_time").cast("timestamp").alias("open_time"),
        price.alias("open"),
        price.alias("high"),
        price.alias("low"),
        price.alias("close"),
        F.lit(1).cast(money.QUANTITY).alias("volume"),
        F.col("turnover").cast(money.NOTIONAL).alias("quote_volume"),
        F.lit(True).alias("is_closed"),
        (F.col("open_time").cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("observed_at"),
    ).select(*BAR_COLUMNS)


def metadata(spark, symbols, **changes):
    """One description per symbol; ``changes`` maps a symbol to overrides."""
    rows = []
    for symbol in symbols:
        row = {
            "base": symbol,
            "quote": "EUR",
            "status": "TRADING",
            "lot_size": "0.0001",
            "min_notional": "10",
        }
        row.update(changes.get(symbol, {}))
        rows.append((symbol, *row.values()))
    frame = spark.createDataFrame(
        rows,
        "symbol string, base string, quote string, status string, lot string, least string",
    )
    return frame.select(
        F.lit(VENUE).alias("venue"),
        "symbol",
        F.lit(None).cast("string").alias("canonical"),
        "base",
        "quote",
        "status",
        F.lit("0.01").cast(money.PRICE).alias("tick_size"),
        F.col("lot").cast(money.QUANTITY).alias("lot_size"),
        F.col("least").cast(money.NOTIONAL).alias("min_notional"),
    )


def no_spreads(spark):
    return spark.createDataFrame(
        [], f"venue string, symbol string, spread_bps {money.BPS}, observed_at timestamp"
    )


def market(
    spark, rows, symbols, truncates=False, announced=(), floor="500", spreads=None, **changes
):
    thresholds = Thresholds(
        minimum_median_quote_volume=Decimal(floor),
        excluded_bases=("USDT",),
        quote_policies={"EUR": ("EUR",)},
    )
    profile = VenueProfile(VENUE, ("TRADING",), truncates, tuple(announced))
    return Market.of(
        bars(spark, rows),
        metadata(spark, symbols, **changes),
        no_spreads(spark) if spreads is None else spreads,
        (profile,),
        thresholds,
    )


def at_decision(verdicts, moment=DECISION):
    stamp = moment.strftime("%Y-%m-%d")
    rows = verdicts.where(F.date_format("as_of", "yyyy-MM-dd") == stamp).collect()
    return {row["symbol"]: row for row in rows}
