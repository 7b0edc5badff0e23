"""Report forms of the monthly table: rows, JSON documents and a venue summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.operators import policy
from tidemark.plans.universe import Market


def run_record(
    judged: DataFrame, policies: Mapping[str, Sequence[str]] = fv.POLICY_RULES
) -> DataFrame:
    """(policy, rule, position) next to the columns of ``judged``."""
    named = F.array(
        *[
            F.struct(
                F.lit(name).alias("policy"),
                F.lit(rule).alias("rule"),
                F.lit(position).alias("position"),
            )
            for name, rules in policies.items()
            for position, rule in enumerate(rules, start=1)
        ]
    )
    return judged.select("*", F.inline(named))


def monthly_report(monthly: DataFrame) -> DataFrame:
    """The sixteen report columns.  Rejections are those of the research rules."""
    renamed = {
        "liquidity": "liquidity_size",
        "research": "research_size",
        "with_spread": "research_with_spread_size",
        "executable": "executable_size",
        "band": "power_band",
        "missing": "known_missing",
        "rej_quote": "rejected_quote_currency",
        "rej_age": "rejected_listing_age",
        "ne_age": "unknown_listing_age",
        "rej_volume": "rejected_median_quote_volume",
        "ne_volume": "unknown_median_quote_volume",
        "ne_spread": "unknown_median_spread",
        "rej_class": "rejected_asset_class",
        "rej_min_notional": "rejected_min_notional_feasible",
        "rej_lot_size": "rejected_lot_size_feasible",
    }
    return monthly.select(
        "venue",
        "quote_policy",
        "month",
        *[F.col(source).alias(name) for name, source in renamed.items()],
    )


def _counts(prefix: str, chosen: str) -> Column:
    """Per-rule counts of one policy as an object with its keys in order."""
    return F.struct(
        *[F.col(f"{prefix}_{rule}").alias(rule) for rule in sorted(fv.POLICY_RULES[chosen])]
    )


def month_rows(market: Market) -> DataFrame:
    """One JSON document per venue, quote policy and month, members included."""
    verdicts = policy.with_memberships(market.verdicts())
    members = F.sort_array(
        F.collect_list(F.when(F.col("in_research"), F.concat_ws(":", "venue", "symbol")))
    )
    sizes = {
        "liquidity_size": "in_liquidity",
        "research_size": "in_research",
        "research_with_spread_size": "in_research+spread",
        "executable_size": "in_research+executable",
    }
    counted = policy.tallies(
        verdicts,
        fv.RULE_NAMES,
        [
            *[F.count_if(F.col(f"`{flag}`")).alias(name) for name, flag in sizes.items()],
            members.alias("research_members"),
        ],
    )
    document = F.struct(
        "month",
        *sizes,
        "known_missing",
        policy.band(F.col("research_size")).alias("power_band"),
        "candidates",
        _counts("rejected", "research").alias("research_rejected"),
        _counts("unknown", "research").alias("research_not_evaluable"),
        _counts("rejected", "research+executable").alias("executable_rejected"),
        _counts("unknown", "research+executable").alias("executable_not_evaluable"),
        "research_members",
    )
    return (
        counted.join(market.known_missing(), ["venue", "as_of"], "left")
        .withColumn("known_missing", F.coalesce("known_missing", F.lit(0)))
        .withColumn("month", F.date_format("as_of", "yyyy-MM"))
        .withColumn("payload", F.to_json(document))
    )


def venue_summary(market: Market) -> DataFrame:
    """Extent, series, described symbols, evidence grades and peak sizes per venue."""
    described = market.metadata.groupBy("venue").agg(F.count("*").alias("candidates"))
    grades = (
        market.calendar.groupBy("venue", "provenance")
        .agg(F.count("*").alias("entries"))
        .groupBy("venue")
        .agg(_sorted_pairs("provenance", "entries").alias("provenance"))
    )
    peaks = (
        policy.monthly_table(market.verdicts())
        .groupBy("venue", "quote_policy")
        .agg(F.max("research_size").alias("peak"))
        .groupBy("venue")
        .agg(_sorted_pairs("quote_policy", "peak").alias("peaks"))
    )
    return (
        market.windows.join(described, "venue").join(grades, "venue").join(peaks, "venue")
    )


def _sorted_pairs(name: str, count: str) -> Column:
    """``name=count`` strings in order of name; one per evidence grade or quote policy."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(name).alias("k"), F.col(count).alias("v"))))
    return F.transform(ordered, lambda pair: F.concat(pair["k"], F.lit("="), pair["v"]))
