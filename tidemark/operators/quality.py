"""Row-level checks: every failing row keeps the name of what failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import fixed_values as fv
from tidemark.functions import money

VENUE_SLUG = "^[a-z][a-z0-9_]{1,31}$"


def price_fault(text: Column) -> Column:
    """Why a price text is unusable: not an exact finite decimal, or negative."""
    value = money.parse_money(text, money.PRICE)
    return F.when(value.isNull(), F.lit("not a finite decimal")).when(
        value < 0, F.lit("below zero")
    )


def require_exact(frame: DataFrame, *columns: str) -> None:
    """Refuse money held in binary floating point, before anything runs."""
    for name in columns:
        if isinstance(frame.schema[name].dataType, (T.FloatType, T.DoubleType)):
            raise TypeError(f"{name}: money must be a decimal, not a float")


def is_venue_slug(name: Column) -> Column:
    return F.coalesce(name.rlike(VENUE_SLUG), F.lit(False))


def in_scope(quote: Column) -> Column:
    return quote.isin(*fv.QUOTES_IN_SCOPE)
