"""Market tables derived by Spark from the driver tables.

Line items are trade prints and part brands are instruments; parts are listed
symbols; events are intraday prints, request attempts and recorded responses.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import instants as ts
from tidemark.functions import money
from tidemark.parameters import Thresholds, VenueProfile, profile_table
from tidemark.plans.universe import Market
from tidemark.session import staging_path
from tidemark.sources import bars as bar_source
from tidemark.sources import envelopes

PROFILES = (
    VenueProfile("alpha", ("TRADING",), False),
    VenueProfile(
        "beta",
        ("TRADING",),
        True,
        (("Gone#1", "1998-05-01 00:00:00"), ("Gone#2", "2000-02-01 00:00:00")),
    ),
)
THRESHOLDS = Thresholds(
    minimum_median_quote_volume=Decimal(75_000), excluded_bases=("Brand#4", "Brand#9")
)
#: Prints that agree in these agree in price, so no further column is needed.
TIE_BREAK = ("l_orderkey", "l_linenumber", "l_partkey")


_schemas: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its schema is looked up once, since every look-up is a job."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def brand_number_of(column: str) -> Column:
    return F.substring(column, 7, 10).try_cast("int")


def brand_number() -> Column:
    return brand_number_of("p_brand")


def venue_of_brand() -> Column:
    return F.when(F.col("n") <= 15, F.lit("alpha")).otherwise(F.lit("beta"))


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prints behind the market: halted brands stop in 1999, late brands start in 1997."""
    n, moment = brand_number_of("symbol"), F.col("ts")
    cut = ((n % 5 == 0) & (moment > F.lit("1999-06-30").cast("timestamp"))) | (
        (n % 7 == 0) & (moment < F.lit("1997-03-15").cast("timestamp"))
    )
    return all_prints(spark, sf_dir).where(~cut)


def all_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a trade print."""
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", "p_retailprice", brand_number().alias("n")
    )
    return (
        table(spark, sf_dir, "lineitem")
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            venue_of_brand().alias("venue"),
            F.col("p_brand").alias("symbol"),
            F.col("l_shipdate").cast("timestamp").alias("ts"),
            F.col("p_retailprice").cast("decimal(18,2)").alias("price"),
            F.col("l_quantity").cast("decimal(18,2)").alias("qty"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("quote_qty"),
            *TIE_BREAK,
        )
    )


def print_order() -> Column:
    """Time of day, then the tie break, as one number: a single column keeps bars in hash tables.

    Microseconds of a day take 11 digits, an order 10, a line 1 and a part 10: two
    long integers, joined by the only wide multiplication.
    """
    micros = F.pmod(F.unix_micros("ts"), F.lit(86_400_000_000))
    high = micros * 10_000_000 + F.floor(F.col("l_orderkey") / 1_000)
    low = F.pmod("l_orderkey", F.lit(1_000)) * 100_000_000_000 + F.col("l_linenumber").cast("bigint") * 10_000_000_000 + F.col("l_partkey")
    return (high.cast("decimal(19,0)") * F.lit("1" + "0" * 14).cast("decimal(15,0)") + low.cast("decimal(15,0)")).cast("decimal(38,0)")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = prints(spark, sf_dir).withColumn("place", print_order())
    return (
        bar_source.from_prints(ordered, "1d", ["place"])
        .withColumn("is_closed", F.lit(True))
        .withColumn("observed_at", F.col("open_time") + ts.days(1))
        .select(*bar_source.BAR_COLUMNS)
    )


def staged_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily bars in a written table, for queries that read them repeatedly."""
    path = staging_path(spark, "bars")
    daily_bars(spark, sf_dir).write.parquet(path)
    return spark.read.schema(bar_source.BAR_SCHEMA).parquet(path)


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per brand, with its current trading constraints."""
    n = F.col("n")
    return (
        table(spark, sf_dir, "part")
        .select("p_brand", brand_number().alias("n"))
        .distinct()
        .select(
            venue_of_brand().alias("venue"),
            F.col("p_brand").alias("symbol"),
            F.lit(None).cast("string").alias("canonical"),
            F.col("p_brand").alias("base"),
            F.when(n % 3 == 0, "EUR").when(n % 3 == 1, "USD").otherwise("USDT").alias("quote"),
            F.when(n % 5 == 0, "BREAK").otherwise("TRADING").alias("status"),
            F.lit("0.01").cast(money.PRICE).alias("tick_size"),
            F.when(n % 2 == 0, "0.001").otherwise("0.01").cast(money.LOT).alias("lot_size"),
            F.when(n % 6 == 0, "50").otherwise("10").cast(money.NOTIONAL).alias("min_notional"),
            # Constraints are today's; on a past date they are a reconstruction.
            F.to_timestamp(F.lit("2001-11-05 12:00:00")).alias("constraints_as_of"),
        )
    )


def spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot for every second brand."""
    return (
        table(spark, sf_dir, "part")
        .select("p_brand", brand_number().alias("n"))
        .distinct()
        .where(F.col("n") % 2 == 0)
        .select(
            venue_of_brand().alias("venue"),
            F.col("p_brand").alias("symbol"),
            (F.col("n") * 2).cast(money.BPS).alias("spread_bps"),
            F.to_timestamp(F.lit("2001-11-05 12:00:00")).alias("observed_at"),
        )
    )


def market(spark: SparkSession, sf_dir: str, with_bars: bool = False) -> Market:
    """The fixture market, staged: one pass over the prints, whatever reads it."""
    return lazy_market(spark, sf_dir).staged(with_bars)


def lazy_market(spark: SparkSession, sf_dir: str) -> Market:
    return Market.of(
        daily_bars(spark, sf_dir),
        metadata(spark, sf_dir),
        spreads(spark, sf_dir),
        PROFILES,
        THRESHOLDS,
    )


def intraday_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as prints: the event type is the symbol, the value the price."""
    return as_prints(table(spark, sf_dir, "events"))


def as_prints(events: DataFrame) -> DataFrame:
    price = F.col("value").cast("decimal(18,2)")
    return events.select(
        F.lit("gamma").alias("venue"),
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        price.alias("price"),
        (F.col("user_id") % 9 + 1).cast("decimal(18,2)").alias("qty"),
        (price * (F.col("user_id") % 9 + 1).cast("decimal(4,0)")).alias("quote_qty"),
        "event_id",
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listed symbol per part, for everything about metadata at scale."""
    key = F.col("p_partkey")
    return (
        table(spark, sf_dir, "part")
        .withColumn("n", brand_number())
        .select(
            venue_of_brand().alias("venue"),
            F.concat(F.lit("P"), key.cast("string")).alias("symbol"),
            F.concat(F.lit("XP"), key.cast("string")).alias("canonical"),
            F.col("p_brand").alias("base"),
            F.element_at(
                F.array(*[F.lit(q) for q in ("EUR", "USD", "USDT", "BTC")]),
                (F.col("p_size") % 4 + 1).cast("int"),
            ).alias("quote"),
            F.when(key % 5 == 0, "BREAK").otherwise("TRADING").alias("status"),
            key.alias("key"),
            F.col("p_size").alias("size"),
            F.col("p_retailprice").cast("decimal(18,2)").alias("price"),
        )
    )


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request attempts: up to five per logical request."""
    key = F.col("event_id")
    request = F.floor(key / 5)
    mix = (key * 31 + F.col("user_id")) % 17
    status = (
        F.when(mix <= 4, 200)
        .when(mix <= 8, 503)
        .when(mix == 9, 429)
        .when(mix == 10, 404)
        .when(mix <= 12, 500)
        .when(mix <= 15, F.lit(None).cast("int"))
        .otherwise(502)
    )
    return (
        table(spark, sf_dir, "events")
        .select(
            F.when(request % 2 == 0, "alpha").otherwise("beta").alias("venue"),
            F.lit("GET").alias("method"),
            F.when(request % 3 == 0, "/klines").otherwise("/ohlc").alias("url"),
            F.concat(
                F.lit("start="),
                request.cast("string"),
                F.lit("&symbol=Brand#"),
                (request % 30 + 1).cast("string"),
            ).alias("params"),
            F.col("ts").cast("timestamp").alias("requested_at"),
            status.alias("status"),
            F.when(status == 200, F.length("props") * 100).otherwise(0).cast("bigint").alias(
                "payload_bytes"
            ),
            (key % 5 + 1).cast("int").alias("attempt"),
        )
        .withColumn("outcome", envelopes.response_outcome(F.col("status")))
        .withColumn(
            "detail",
            F.when(F.col("outcome") == "ok", F.lit("")).otherwise(
                F.concat(F.lit("HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("none")))
            ),
        )
    )


def profiles(spark: SparkSession) -> DataFrame:
    return profile_table(spark, PROFILES)
