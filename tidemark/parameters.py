"""Thresholds, accounts and venue facts, passed explicitly to every plan."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.session import dimension


@dataclass(frozen=True)
class Account:
    """The wallet that the executable universe is sized for."""

    equity: Decimal = Decimal(1500)
    positions: int = 8
    min_notional_share: Decimal = Decimal("0.25")
    lot_rounding_share: Decimal = Decimal("0.01")

    def __post_init__(self) -> None:
        if self.positions <= 0:
            raise ValueError("positions must be greater than zero")

    @property
    def target(self) -> Decimal:
        return self.equity / self.positions

    @property
    def largest_min_notional(self) -> Decimal:
        return self.target * self.min_notional_share

    @property
    def largest_lot_value(self) -> Decimal:
        return self.target * self.lot_rounding_share


@dataclass(frozen=True)
class Thresholds:
    """Every number a rule compares against."""

    listing_age_days: int = 180
    lookback_days: int = 30
    minimum_observations: int = 20
    minimum_median_quote_volume: Decimal = Decimal(250_000)
    maximum_spread_bps: Decimal = Decimal(25)
    excluded_bases: tuple[str, ...] = fv.EXCLUDED_BASES
    excluded_quotes: tuple[str, ...] = ()
    account: Account = field(default_factory=Account)
    quote_policies: Mapping[str, tuple[str, ...]] = field(
        default_factory=lambda: dict(fv.QUOTE_POLICIES)
    )


@dataclass(frozen=True)
class VenueProfile:
    """What is known about one venue, as data rather than as a branch."""

    venue: str
    live_statuses: tuple[str, ...]
    truncates_history: bool
    announced_delistings: tuple[tuple[str, str], ...] = ()


PUBLIC_VENUES = tuple(
    VenueProfile(
        venue=name,
        live_statuses=fv.LIVE_STATUSES[name],
        truncates_history=fv.TRUNCATES_HISTORY[name],
        announced_delistings=fv.ANNOUNCED_DELISTINGS[name],
    )
    for name in sorted(fv.LIVE_STATUSES)
)


def profile_table(spark: SparkSession, profiles: tuple[VenueProfile, ...]) -> DataFrame:
    """(venue, live_statuses, truncates_history), one row per venue."""
    schema = pa.schema(
        [
            ("venue", pa.string()),
            ("live_statuses", pa.list_(pa.string())),
            ("truncates_history", pa.bool_()),
        ]
    )
    rows = [
        {
            "venue": p.venue,
            "live_statuses": list(p.live_statuses),
            "truncates_history": p.truncates_history,
        }
        for p in profiles
    ]
    return dimension(spark, rows, schema)


def announced_delistings(spark: SparkSession, profiles: tuple[VenueProfile, ...]) -> DataFrame:
    """(venue, symbol, delisted_at); a symbol named twice keeps its last notice."""
    latest = {
        (p.venue, symbol): instant for p in profiles for symbol, instant in p.announced_delistings
    }
    schema = pa.schema(
        [("venue", pa.string()), ("symbol", pa.string()), ("announced", pa.string())]
    )
    rows = [
        {"venue": venue, "symbol": symbol, "announced": instant}
        for (venue, symbol), instant in latest.items()
    ]
    return dimension(spark, rows, schema).select(
        "venue", "symbol", F.to_timestamp("announced").alias("delisted_at")
    )
