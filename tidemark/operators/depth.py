"""What an order of a given size would pay: walking the levels of a book.

A side of a book becomes an array of levels, best first, each with what the book
holds up to and including it: quantity and exact notional.  Filling an order is then
finding the level where the quantity is reached; whole levels before it come from the
running sums and only the last is cut.  Trades stay where they are read; a book has
as many levels as prices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import money

BUY, SELL = "buy", "sell"
#: Price times quantity with every digit of both: 20 before the point, 18 after it.
EXACT = "decimal(38,18)"
#: Steps of a search by halves through a book of any length.
_HALVES = [1 << bit for bit in range(29, -1, -1)]


def notional(price: Column, quantity: Column) -> Column:
    """The exact product; NULL where it does not fit.

    Whole and fraction of the price apart, since the product of both types needs
    more digits than a decimal has.
    """
    price, quantity = price.cast(money.PRICE), quantity.cast(money.QUANTITY)
    whole = F.floor(price).cast("decimal(10,0)")
    fraction = (price - whole).cast("decimal(10,10)")
    return (whole * quantity).try_cast(EXACT) + (fraction * quantity).try_cast(EXACT)


def books(levels: DataFrame, keys: Sequence[str] = ("venue", "symbol")) -> DataFrame:
    """(keys, side, price, quantity) to one row per key with ``bids`` and ``asks``.

    ``side`` is bid or ask.  Equal prices are one level; levels without a price, or
    with nothing to trade, are no levels.
    """
    priced = (
        levels.where("price > 0 AND quantity > 0")
        .groupBy(*keys, "side", F.col("price").cast(money.PRICE).alias("price"))
        .agg(F.sum("quantity").cast(money.QUANTITY).alias("quantity"))
        # The best level first: the highest bid, the lowest ask.
        .withColumn("rank", F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price")))
    )
    upto = Window.partitionBy(*keys, "side").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = priced.select(
        *keys, "side", "rank", "price",
        F.sum("quantity").over(upto).cast(money.QUANTITY).alias("through"),
        F.sum(notional(F.col("price"), F.col("quantity"))).over(upto).cast(EXACT).alias("spent"),
    )
    level = F.struct("rank", "price", "through", "spent")
    sides = {name: F.sort_array(F.collect_list(F.when(F.col("side") == side, level))) for name, side in (("bids", "bid"), ("asks", "ask"))}
    return summed.groupBy(*keys).agg(*[column.alias(name) for name, column in sides.items()])


def filled(trades: DataFrame, side: str = "side", quantity: str = "quantity") -> DataFrame:
    """``trades`` (with ``bids`` and ``asks``) and what the book gives them.

    levels: how many are touched; filled: the quantity that is there, at most what is
    asked for; complete: all of it; notional: exactly what is paid; average: its price
    at ten decimals; slippage_bps: how much worse the average is than the best level.
    A buy takes asks, a sell bids.  Without a book on that side nothing is filled and
    average and slippage are unknown, not zero.
    """
    wanted = F.col(quantity).cast(money.QUANTITY)
    book = F.when(F.col(side) == BUY, F.col("asks")).when(F.col(side) == SELL, F.col("bids"))
    # Running sums only grow, so the levels that are emptied are found by halves.
    further = lambda at, step: F.get("_book", at + step - 1)["through"] <= F.col("_wanted")
    whole = F.aggregate(F.lit(_HALVES), F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))
    zero = F.lit(0)
    last = F.get("_book", F.col("_whole") - 1)
    cut = F.get("_book", F.col("_whole"))
    had, paid = F.coalesce(last["through"], zero.cast(money.QUANTITY)), F.coalesce(last["spent"], zero.cast(EXACT))
    rest = F.when(cut.isNotNull(), F.greatest(F.col("_wanted") - had, zero.cast(money.QUANTITY))).otherwise(zero).cast(money.QUANTITY)
    best = F.get("_book", F.lit(0))["price"]
    some = F.col("filled") > 0
    worse = F.when(F.col(side) == BUY, F.col("average") - F.col("_best")).otherwise(F.col("_best") - F.col("average"))
    return (
        trades.withColumns({"_book": book, "_wanted": wanted})
        .withColumn("_whole", whole)
        .withColumns(
            {
                "levels": (F.col("_whole") + (rest > 0).cast("int")).cast("int"),
                "filled": (had + rest).cast(money.QUANTITY),
                "notional": (paid + F.coalesce(notional(cut["price"], rest), zero.cast(EXACT))).cast(EXACT),
                "_best": best,
            }
        )
        .withColumn("complete", F.col("filled") >= F.col("_wanted"))
        .withColumn("average", F.when(some, (F.col("notional") / F.col("filled")).cast(money.PRICE)))
        .withColumn("slippage_bps", (worse.cast("decimal(20,10)") * money.BASIS_POINTS).cast("decimal(28,10)") / F.col("_best"))
        .withColumn("slippage_bps", F.col("slippage_bps").cast(money.BPS))
        .drop("_book", "_wanted", "_whole", "_best", "bids", "asks")
    )
