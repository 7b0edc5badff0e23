"""Top-of-book snapshots to spreads in basis points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import money
from tidemark.sources.bars import for_instruments

_TICKERS = "array<struct<symbol: string, bidPrice: string, askPrice: string>>"
_LEVELS = """struct<
  error: array<string>,
  result: map<string, struct<a: array<string>, b: array<string>>>>"""


def ticker_spreads(payloads: DataFrame, wanted: DataFrame) -> DataFrame:
    """Arrays of best bid and ask, restricted to the wanted symbols."""
    books = payloads.select("venue", "as_of", F.inline(_readable(_TICKERS)))
    return _spreads(
        for_instruments(books, wanted).select(
            "venue",
            "symbol",
            "as_of",
            money.parse_money(F.col("bidPrice"), money.PRICE).alias("bid"),
            money.parse_money(F.col("askPrice"), money.PRICE).alias("ask"),
        )
    )


def level_spreads(payloads: DataFrame, metadata: DataFrame) -> DataFrame:
    """Maps of canonical name to price levels, renamed through the metadata.

    A canonical name the metadata does not know keeps its own name.
    """
    books = payloads.select(
        "venue", "as_of", F.explode(_readable(_LEVELS, "result"))
    ).select(
        "venue",
        F.col("key").alias("canonical"),
        "as_of",
        money.parse_money(F.get("value.b", F.lit(0)), money.PRICE).alias("bid"),
        money.parse_money(F.get("value.a", F.lit(0)), money.PRICE).alias("ask"),
    )
    names = metadata.select("venue", "canonical", "symbol")
    named = books.join(names, ["venue", "canonical"], "left").withColumn(
        "symbol", F.coalesce("symbol", "canonical")
    )
    return _spreads(named.select("venue", "symbol", "as_of", "bid", "ask"))


def _readable(schema: str, field: str | None = None) -> Column:
    """The parsed page; a page without the expected content fails the job."""
    parsed = F.from_json("payload", schema)
    content = parsed if field is None else parsed[field]
    complaint = F.concat(F.lit("unreadable book page: "), F.substring("payload", 1, 200))
    return F.coalesce(content, F.raise_error(complaint))


def _spreads(books: DataFrame) -> DataFrame:
    return books.select(
        "venue", "symbol", "as_of", money.spread_bps(F.col("bid"), F.col("ask")).alias("spread_bps")
    ).where(F.col("spread_bps").isNotNull())
