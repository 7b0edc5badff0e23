"""Itemised trading costs, and equity that reconciles to the smallest unit."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import money
from tidemark.session import lookup

COMPONENTS = ("fee_bps", "spread_bps", "slippage_bps", "funding_bps")

#: A cost model maps trades to one column per component.
CostModel = Callable[[], Mapping[str, Column]]


def total_bps() -> Column:
    """All-in cost: the plain sum of the four components."""
    return (
        F.col("fee_bps") + F.col("spread_bps") + F.col("slippage_bps") + F.col("funding_bps")
    ).cast("decimal(24,10)")


def estimate(trades: DataFrame, model: CostModel) -> DataFrame:
    """Apply a cost model; every component must be given, so none is silently zero."""
    columns = dict(model())
    if set(columns) != set(COMPONENTS):
        raise ValueError(f"a cost model gives exactly {', '.join(COMPONENTS)}")
    itemised = trades.withColumns({name: columns[name].cast(money.BPS) for name in COMPONENTS})
    return itemised.withColumn("total_bps", total_bps())


def cost_amount(notional: Column, bps: Column) -> Column:
    """Cost of a trade in quote units, at eight decimal places."""
    fraction = (bps.cast(money.BPS) * F.lit("0.0001").cast("decimal(4,4)")).cast("decimal(13,10)")
    return (notional.cast(money.QUANTITY) * fraction).cast("decimal(28,8)")


def equity_curve(trades: DataFrame) -> DataFrame:
    """Cumulative gross, cost and net per (venue, symbol, day).

    Trades are summed by day before the running sum, so the window holds one row
    per day and never one per trade.  ``reconciles`` states that gross minus cost
    equals net exactly.
    """
    daily = trades.groupBy("venue", "symbol", "day").agg(
        F.sum("gross").cast("decimal(34,8)").alias("gross"),
        F.sum("cost").cast("decimal(34,8)").alias("cost"),
        F.sum(F.col("gross") - F.col("cost")).cast("decimal(34,8)").alias("net"),
    )
    so_far = (
        Window.partitionBy("venue", "symbol")
        .orderBy("day")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = daily.select(
        "venue",
        "symbol",
        "day",
        *[
            F.sum(name).over(so_far).cast("decimal(34,8)").alias(f"{name}_equity")
            for name in ("gross", "cost", "net")
        ],
    )
    return running.withColumn(
        "reconciles", F.col("gross_equity") - F.col("cost_equity") == F.col("net_equity")
    )


def by_venue_model(trades: DataFrame, fees: DataFrame, venues: list[str]) -> DataFrame:
    """The same trades priced under several venues' schedules, side by side.

    ``fees`` has (model, role, total_bps).  It is folded to one row per role, so
    pricing under more venues adds columns and never rows.  Gross does not
    depend on the model.
    """
    schedule = fees.groupBy("role").agg(
        *[
            F.max(F.when(F.col("model") == venue, F.col("total_bps"))).alias(f"bps_{venue}")
            for venue in venues
        ]
    )
    sums = [F.sum("gross").cast("decimal(34,8)").alias("gross")]
    for venue in venues:
        cost = cost_amount(F.col("gross"), F.col(f"bps_{venue}"))
        sums.append(F.sum(F.col("gross") - cost).cast("decimal(34,8)").alias(f"net_{venue}"))
    return lookup(trades, schedule, ["role"], "inner").groupBy("symbol").agg(*sums)


def delisting_markout(listed: DataFrame, bars: DataFrame) -> DataFrame:
    """Last traded price of every delisted instrument: where a position is marked out."""
    last = bars.groupBy("venue", "symbol").agg(
        F.max_by("close", "open_time").alias("exit_price"),
        F.max("open_time").alias("last_traded"),
    )
    return (
        listed.where(F.col("delisted_at").isNotNull())
        .join(last, ["venue", "symbol"])
        .select("venue", "symbol", "delisted_at", "last_traded", "exit_price")
    )
