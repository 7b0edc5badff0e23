"""RUL: one verdict per candidate and refresh, for each rule on its own."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.operators import policy, rules
from tidemark.workloads import fixtures as fx
from tidemark.workloads.edge import exact, month
from tidemark.workloads.registry import query


def _one_rule(spark, sf_dir: str, rule: rules.Rule) -> DataFrame:
    grid = fx.market(spark, sf_dir).grid()
    return policy.judge(grid, [rule]).select(
        "venue", "symbol", month(), F.col(rule.column).alias("outcome")
    )


def _one_rule_sql(column: str) -> str:
    return f"""
    SELECT venue, symbol, strftime(as_of, '%Y-%m') AS month, {column} AS outcome
    FROM fx_verdicts WHERE quote_policy = 'EUR+USD'"""


@query("rul_1_quote_currency", _one_rule_sql("v_quote_currency"))
def quote_currency(spark, sf_dir):
    allowed = F.array(*[F.lit(q) for q in fv.QUOTE_POLICIES["EUR+USD"]])
    return _one_rule(spark, sf_dir, rules.quote_currency(allowed))


@query("rul_2_listing_age", _one_rule_sql("v_listing_age"))
def listing_age(spark, sf_dir):
    return _one_rule(spark, sf_dir, rules.listing_age(fx.THRESHOLDS.listing_age_days))


@query("rul_3_median_quote_volume", _one_rule_sql("v_median_quote_volume"))
def median_quote_volume(spark, sf_dir):
    limits = fx.THRESHOLDS
    rule = rules.median_quote_volume(
        limits.minimum_median_quote_volume, limits.minimum_observations
    )
    return _one_rule(spark, sf_dir, rule)


@query("rul_4_median_spread", _one_rule_sql("v_median_spread"))
def median_spread(spark, sf_dir):
    return _one_rule(spark, sf_dir, rules.median_spread(fx.THRESHOLDS.maximum_spread_bps))


@query("rul_5_min_notional_feasible", _one_rule_sql("v_min_notional_feasible"))
def min_notional_feasible(spark, sf_dir):
    allowance = fx.THRESHOLDS.account.largest_min_notional
    return _one_rule(spark, sf_dir, rules.min_notional_feasible(allowance))


@query("rul_6_lot_size_feasible", _one_rule_sql("v_lot_size_feasible"))
def lot_size_feasible(spark, sf_dir):
    allowance = fx.THRESHOLDS.account.largest_lot_value
    return _one_rule(spark, sf_dir, rules.lot_size_feasible(allowance))


@query("rul_7_asset_class", _one_rule_sql("v_asset_class"))
def asset_class(spark, sf_dir):
    return _one_rule(spark, sf_dir, rules.asset_class(fx.THRESHOLDS.excluded_bases))


@query(
    "rul_8_account_parameters",
    """
    SELECT c_custkey AS account,
           (c_acctbal::DECIMAL(18,2)::DECIMAL(26,8) / 8)::DECIMAL(34,8)::VARCHAR AS target_position,
           (c_acctbal::DECIMAL(18,2)::DECIMAL(26,8) * 0.03125)::DECIMAL(34,8)::VARCHAR AS max_min_notional,
           (c_acctbal::DECIMAL(18,2)::DECIMAL(26,8) * 0.00125)::DECIMAL(34,8)::VARCHAR AS max_rounding_loss
    FROM customer""",
)
def account_parameters(spark, sf_dir):
    """Allowances of every customer's account, held by eight positions."""
    account = fx.THRESHOLDS.account
    return fx.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("account"),
        *rules.account_columns(
            F.col("c_acctbal").cast("decimal(18,2)"),
            F.lit(account.positions),
            account.min_notional_share,
            account.lot_rounding_share,
        ),
    ).select(
        "account",
        exact("target_position", 8),
        exact("max_min_notional", 8),
        exact("max_rounding_loss", 8),
    )


@query(
    "rul_9_pluggable_rule",
    """
    SELECT venue, symbol, strftime(as_of, '%Y-%m') AS month,
           CASE WHEN close_as_of IS NULL THEN 'not_evaluable'
                WHEN close_as_of >= 950 THEN 'admit' ELSE 'reject' END AS outcome,
           coalesce(in_research AND close_as_of >= 950, FALSE) AS member
    FROM fx_verdicts WHERE quote_policy = 'EUR+USD+USDT'""",
)
def pluggable_rule(spark, sf_dir):
    """A rule the library does not know: a floor on the price, added by a user."""
    floor = F.lit(Decimal(950)).cast("decimal(20,10)")
    price_floor = rules.Rule(
        "price_floor",
        lambda: rules.unless_unknown(
            F.col("close_as_of").isNull(), rules.admit_when(F.col("close_as_of") >= floor)
        ),
    )
    verdicts = fx.market(spark, sf_dir).verdicts(price_floor)
    stricter = policy.extend(fv.POLICY_RULES["research"], ["price_floor"])
    return verdicts.where("quote_policy = 'EUR+USD+USDT'").select(
        "venue",
        "symbol",
        month(),
        F.col(price_floor.column).alias("outcome"),
        policy.is_member(stricter).alias("member"),
    )
