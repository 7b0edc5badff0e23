"""Point-in-time rules: a name and a column that is never NULL and never boolean.

A rule reads the verdict grid (one row per candidate and refresh) and answers
admit, reject or not_evaluable.  Users add rules by writing another function
from nothing to a Column over the same grid.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import instants as ts
from tidemark.functions import money
from tidemark.parameters import Thresholds


@dataclass(frozen=True)
class Rule:
    """Anything with a name and a three-valued verdict column."""

    name: str
    verdict: Callable[[], Column]

    @property
    def column(self) -> str:
        return f"v_{self.name}"


def admit_when(condition: Column) -> Column:
    """admit where the condition holds, reject where it does not (or is NULL)."""
    return F.when(condition, F.lit(fv.ADMIT)).otherwise(F.lit(fv.REJECT))


def unless_unknown(unknown: Column, verdict: Column) -> Column:
    """not_evaluable wins over whatever the rule would have said."""
    return F.when(unknown, F.lit(fv.NOT_EVALUABLE)).otherwise(verdict)


def _amount(value, kind: str) -> Column:
    return F.lit(str(value)).cast(kind)


def quote_currency(allowed: Column | None = None) -> Rule:
    """The quote must be fundable; ``allowed`` defaults to the policy in the row."""
    quotes = F.col("policy_quotes") if allowed is None else allowed
    return Rule(
        fv.QUOTE_CURRENCY, lambda: admit_when(F.array_contains(quotes, F.col("quote")))
    )


def listing_age(minimum_days: int) -> Rule:
    def verdict() -> Column:
        old_enough = F.col("as_of") >= F.col("listed_at") + ts.days(minimum_days)
        return unless_unknown(F.col("provenance") == "unverified", admit_when(old_enough))

    return Rule(fv.LISTING_AGE, verdict)


def median_quote_volume(minimum, minimum_observations: int) -> Rule:
    def verdict() -> Column:
        count = F.coalesce("observations", F.lit(0))
        unknown = (count < minimum_observations) | F.col("median_quote_volume").isNull()
        floor = _amount(minimum, money.NOTIONAL)
        return unless_unknown(unknown, admit_when(F.col("median_quote_volume") >= floor))

    return Rule(fv.MEDIAN_QUOTE_VOLUME, verdict)


def median_spread(maximum_bps) -> Rule:
    def verdict() -> Column:
        inside = F.col("spread_bps") <= _amount(maximum_bps, money.BPS)
        return unless_unknown(F.col("spread_bps").isNull(), admit_when(inside))

    return Rule(fv.MEDIAN_SPREAD, verdict)


def min_notional_feasible(allowance) -> Rule:
    def verdict() -> Column:
        least = F.col("min_notional")
        return admit_when((least <= 0) | (least <= _amount(allowance, money.NOTIONAL)))

    return Rule(fv.MIN_NOTIONAL_FEASIBLE, verdict)


def lot_size_feasible(allowance) -> Rule:
    def verdict() -> Column:
        lot, close = F.col("lot_size"), F.col("close_as_of")
        fits = (lot <= 0) | (close <= 0) | (lot * close <= _amount(allowance, money.NOTIONAL))
        return unless_unknown(F.col("close_as_of").isNull(), admit_when(fits))

    return Rule(fv.LOT_SIZE_FEASIBLE, verdict)


def asset_class(excluded_bases: tuple[str, ...], excluded_quotes: tuple[str, ...] = ()) -> Rule:
    def verdict() -> Column:
        excluded = F.col("base").isin(*excluded_bases) | F.col("quote").isin(*excluded_quotes)
        return F.when(excluded, F.lit(fv.REJECT)).otherwise(F.lit(fv.ADMIT))

    return Rule(fv.ASSET_CLASS, verdict)


def standard_rules(thresholds: Thresholds) -> tuple[Rule, ...]:
    """The seven rules, in their reporting order."""
    account = thresholds.account
    return (
        quote_currency(),
        listing_age(thresholds.listing_age_days),
        median_quote_volume(
            thresholds.minimum_median_quote_volume, thresholds.minimum_observations
        ),
        median_spread(thresholds.maximum_spread_bps),
        min_notional_feasible(account.largest_min_notional),
        lot_size_feasible(account.largest_lot_value),
        asset_class(thresholds.excluded_bases, thresholds.excluded_quotes),
    )


def account_columns(equity: Column, positions: Column, min_share, lot_share) -> list[Column]:
    """Target position and the two allowances, for accounts held as rows."""
    target = F.when(
        positions > 0, F.try_divide(equity.cast(money.QUANTITY), positions.cast("decimal(10,0)"))
    ).cast("decimal(24,8)")
    return [
        target.alias("target_position"),
        (target * _amount(min_share, "decimal(4,2)")).cast("decimal(28,10)").alias(
            "max_min_notional"
        ),
        (target * _amount(lot_share, "decimal(4,2)")).cast("decimal(28,10)").alias(
            "max_rounding_loss"
        ),
    ]
