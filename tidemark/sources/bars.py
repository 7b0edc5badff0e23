"""Bars from landed payloads, from prints, and from finer bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.fixed_values import TIMEFRAME_SECONDS
from tidemark.functions import instants as ts
from tidemark.functions import money
from tidemark.session import lookup
from tidemark.sources.envelopes import envelope_outcome

KEY = ("venue", "symbol", "timeframe", "open_time")
BAR_COLUMNS = (
    *KEY,
    "open",
    "high",
    "low",
    "close",
    "volume",
    "quote_volume",
    "is_closed",
    "observed_at",
)
BAR_SCHEMA = (
    "venue string, symbol string, timeframe string, open_time timestamp, "
    f"open {money.PRICE}, high {money.PRICE}, low {money.PRICE}, close {money.PRICE}, "
    f"volume {money.QUANTITY}, quote_volume {money.NOTIONAL}, is_closed boolean, "
    "observed_at timestamp"
)
MINIMUM_FIELDS = 8


def _judge(rows: DataFrame) -> DataFrame:
    """Name what is wrong with a parsed bar, or NULL when nothing is."""
    prices = [F.col(name) for name in ("open", "high", "low", "close")]
    unreadable = F.lit(False)
    negative = F.lit(False)
    for price in prices:
        unreadable = unreadable | price.isNull()
        negative = negative | (price < 0)
    return rows.withColumn(
        "reason",
        F.when(
            ts.timeframe_seconds(F.col("timeframe")).isNull(), F.lit("timeframe: not served")
        )
        .when(F.col("fields").isNull(), F.coalesce("fault", F.lit("row: expected an array")))
        .when(F.size("fields") < MINIMUM_FIELDS, F.lit("too few fields"))
        .when(F.col("open_time").isNull(), F.lit("open_time: expected an integer"))
        .when(
            unreadable | F.col("volume").isNull() | F.col("quote_volume").isNull(),
            F.lit("expected a decimal"),
        )
        .when(negative, F.lit("price below zero")),
    ).withColumn(
        "is_closed",
        ts.close_time(F.col("open_time"), F.col("timeframe")) <= F.col("observed_at"),
    )


def _exploded(payloads: DataFrame, rows: Column, fault: Column) -> DataFrame:
    """One row per bar, or one row for a faulty payload, which then keeps its text."""
    nothing = F.array(F.lit(None).cast("array<string>"))
    return payloads.withColumn("fault", fault).select(
        "venue",
        "symbol",
        "timeframe",
        "observed_at",
        "fault",
        F.when(F.col("fault").isNotNull(), F.col("payload")).alias("faulty"),
        F.explode(F.when(F.col("fault").isNotNull(), nothing).otherwise(rows)).alias("fields"),
    )


def parse_klines(payloads: DataFrame) -> DataFrame:
    """(venue, symbol, timeframe, observed_at, payload) to bars plus ``reason``.

    The payload is an array of arrays: 0 open millis, 1-4 open high low close,
    5 volume, 7 quote volume.  An empty array has no bars; a payload that is not
    an array is a row with a reason.
    """
    rows = F.from_json("payload", "array<array<string>>")
    fault = F.when(rows.isNull(), F.lit("payload: expected an array of rows"))
    parsed = _exploded(payloads, rows, fault)
    field = lambda at, kind: money.parse_money(F.get("fields", F.lit(at)), kind)
    return _judge(
        parsed.select(
            "*",
            ts.from_epoch_millis(F.get("fields", F.lit(0)).try_cast("bigint")).alias("open_time"),
            field(1, money.PRICE).alias("open"),
            field(2, money.PRICE).alias("high"),
            field(3, money.PRICE).alias("low"),
            field(4, money.PRICE).alias("close"),
            field(5, money.QUANTITY).alias("volume"),
            field(7, money.NOTIONAL).alias("quote_volume"),
        )
    )


def parse_ohlc(payloads: DataFrame) -> DataFrame:
    """OHLC envelopes to bars plus ``reason``.

    The series is the first result entry not called ``last``; without one there
    are no bars.  Times are epoch seconds, field 5 is the volume-weighted price
    and 6 the volume; turnover is their product, rounded at the scale of the
    notional type.  A refusal or an outage inside the envelope is a row whose
    reason names it.
    """
    envelope = F.from_json("payload", "struct<error: array<string>, result: map<string,string>>")
    series = F.get(
        F.map_values(F.map_filter(envelope["result"], lambda key, _: key != "last")), F.lit(0)
    )
    rows = F.from_json(F.coalesce(series, F.lit("[]")), "array<array<string>>")
    outcome = envelope_outcome(F.col("payload"))
    fault = F.when(outcome != "ok", F.concat(F.lit("envelope: "), outcome)).when(
        rows.isNull(), F.lit("result: expected an array of rows")
    )
    parsed = _exploded(payloads, rows, fault)
    field = lambda at, kind: money.parse_money(F.get("fields", F.lit(at)), kind)
    # Whole and fraction apart, since the product of both types needs more digits
    # than a decimal has.
    price, volume = field(5, money.PRICE), field(6, money.QUANTITY)
    whole = volume.cast("decimal(16,0)")
    turnover = (price * whole).cast(money.NOTIONAL) + (
        price * (volume - whole).cast("decimal(9,8)")
    ).cast(money.NOTIONAL)
    return _judge(
        parsed.select(
            "*",
            F.timestamp_seconds(F.get("fields", F.lit(0)).try_cast("bigint")).alias("open_time"),
            field(1, money.PRICE).alias("open"),
            field(2, money.PRICE).alias("high"),
            field(3, money.PRICE).alias("low"),
            field(4, money.PRICE).alias("close"),
            field(6, money.QUANTITY).alias("volume"),
            turnover.cast(money.NOTIONAL).alias("quote_volume"),
        )
    )


def good_bars(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).select(*BAR_COLUMNS)


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).select(
        "venue",
        "symbol",
        "timeframe",
        "observed_at",
        "reason",
        F.coalesce(F.to_json("fields"), F.col("faulty")).alias("raw"),
    )


def within(bars: DataFrame, start: Column, end: Column, include_open: bool = False) -> DataFrame:
    """Half-open window; bars still forming only on request."""
    window = (F.col("open_time") >= start) & (F.col("open_time") < end)
    return bars.where(window if include_open else window & F.col("is_closed"))


def require_closed(bars: DataFrame) -> DataFrame:
    """Strict use: the job fails on the first bar that is still forming."""
    message = F.concat(
        F.lit("bar still open: "), F.col("venue"), F.lit("/"), F.col("symbol"), F.lit(" "),
        F.col("open_time").cast("string"),
    )
    return bars.where(
        F.when(F.col("is_closed"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    )


def first_and_last_by(order_by: Sequence[str]) -> Column:
    return F.col(order_by[0]) if len(order_by) == 1 else F.struct(*order_by)


def from_prints(
    prints: DataFrame,
    timeframe: str,
    order_by: Sequence[str] = ("ts",),
) -> DataFrame:
    """Trade prints (venue, symbol, ts, price, qty, quote_qty) to bars.

    One algebraic aggregation: each map task reduces its prints to at most one
    row per bar before the shuffle, so a symbol with a third of all prints costs
    no more to shuffle than its number of bars.

    ``order_by`` says which print opens and closes a bar.  A single column, the
    time or a venue's own trade number, keeps the aggregation in hash tables;
    several columns are compared as a struct, which Spark aggregates by sorting
    and which costs about twice the time.
    """
    order = first_and_last_by(order_by)
    length = TIMEFRAME_SECONDS[timeframe]
    micros = length * 1_000_000
    started = F.timestamp_micros(F.unix_micros("ts") - F.pmod(F.unix_micros("ts"), F.lit(micros)))
    return (
        prints.withColumn("open_time", started)
        .groupBy("venue", "symbol", "open_time")
        .agg(
            F.min_by("price", order).cast(money.PRICE).alias("open"),
            F.max("price").cast(money.PRICE).alias("high"),
            F.min("price").cast(money.PRICE).alias("low"),
            F.max_by("price", order).cast(money.PRICE).alias("close"),
            F.sum("qty").cast(money.QUANTITY).alias("volume"),
            F.sum("quote_qty").cast(money.NOTIONAL).alias("quote_volume"),
        )
        .withColumn("timeframe", F.lit(timeframe))
    )


def roll_up(bars: DataFrame, timeframes: Sequence[str]) -> DataFrame:
    """Finer bars to several coarser timeframes in one pass.

    The fine bars are already one row per bar, so fanning each out to the
    requested timeframes multiplies bars, never prints.
    """
    lengths = F.array(
        *[
            F.struct(F.lit(name).alias("timeframe"), F.lit(TIMEFRAME_SECONDS[name]).alias("size"))
            for name in timeframes
        ]
    )
    started = F.timestamp_seconds(
        F.unix_seconds("fine_open") - F.pmod(F.unix_seconds("fine_open"), F.col("target.size"))
    )
    return (
        bars.drop("timeframe")
        .withColumnRenamed("open_time", "fine_open")
        .withColumn("target", F.explode(lengths))
        .withColumn("open_time", started)
        .groupBy("venue", "symbol", F.col("target.timeframe").alias("timeframe"), "open_time")
        .agg(
            F.min_by("open", "fine_open").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "fine_open").alias("close"),
            F.sum("volume").cast(money.QUANTITY).alias("volume"),
            F.sum("quote_volume").cast(money.NOTIONAL).alias("quote_volume"),
        )
    )


def for_instruments(bars: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bars of an explicit set of instruments; one without bars adds nothing."""
    chosen = wanted.select("venue", "symbol").distinct()
    return lookup(bars, chosen, ["venue", "symbol"], "left_semi")


def latest_close_time(instruments: DataFrame, bars: DataFrame) -> DataFrame:
    """Close time of the newest closed bar per instrument and timeframe, or NULL."""
    newest = (
        bars.where("is_closed")
        .groupBy("venue", "symbol", "timeframe")
        .agg(F.max("open_time").alias("open_time"))
        .select(
            "venue",
            "symbol",
            "timeframe",
            ts.close_time(F.col("open_time"), F.col("timeframe")).alias("latest_close"),
        )
    )
    return instruments.join(newest, ["venue", "symbol", "timeframe"], "left")


def earliest_open_time(bars: DataFrame) -> DataFrame:
    """First bar per symbol: a lower bound on the listing instant."""
    return bars.groupBy("venue", "symbol").agg(F.min("open_time").alias("earliest_open"))


def newest_observation(bars: DataFrame) -> DataFrame:
    """One row per bar key: the copy seen last wins.

    Copies seen at the same time are settled by their values, so a rerun keeps
    the same one.
    """
    rest = [name for name in bars.columns if name not in (*KEY, "observed_at")]
    return (
        bars.groupBy(*KEY)
        .agg(F.max(F.struct("observed_at", *rest)).alias("kept"))
        .select(*KEY, "kept.*")
        .select(*bars.columns)
    )
