"""Policies: sets of rules applied together, with independent per-rule tallies."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import instants as ts
from tidemark.operators.rules import Rule

SLICE = ("venue", "quote_policy", "as_of")


def named_quotes(policies: Mapping[str, Sequence[str]]) -> Column:
    """The quote policies as one literal array of (quote_policy, policy_quotes)."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("quote_policy"),
                F.array(*[F.lit(quote) for quote in quotes]).alias("policy_quotes"),
            )
            for name, quotes in policies.items()
        ]
    )


def fitting_quote_policies(
    listings: DataFrame, policies: Mapping[str, Sequence[str]] = fv.QUOTE_POLICIES
) -> DataFrame:
    """Every listing under every quote policy it fits; the policies are nested sets."""
    fitting = F.filter(
        named_quotes(policies), lambda p: F.array_contains(p["policy_quotes"], F.col("quote"))
    )
    return listings.withColumn("quote_policy", F.explode(fitting["quote_policy"]))


def judge(grid: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Every rule against every candidate at every refresh; one column per rule.

    No rule short-circuits another, and none depends on listing: the tallies
    answer which threshold binds, not which rule happened to run first.
    """
    columns = {rule.column: rule.verdict() for rule in rules}
    columns["listed"] = ts.is_listed(F.col("listed_at"), F.col("delisted_at"), F.col("as_of"))
    return grid.withColumns(columns)


def is_member(rules: Sequence[str]) -> Column:
    """Listed and admitted by every rule; no rule can bring an unlisted name back."""
    return reduce(
        lambda so_far, name: so_far & (F.col(f"v_{name}") == fv.ADMIT), rules, F.col("listed")
    )


def with_memberships(
    verdicts: DataFrame, policies: Mapping[str, Sequence[str]] = fv.POLICY_RULES
) -> DataFrame:
    """One boolean column per named policy."""
    return verdicts.withColumns(
        {f"in_{name}": is_member(rules) for name, rules in policies.items()}
    )


def extend(rules: Sequence[str], more: Sequence[str]) -> tuple[str, ...]:
    """A policy built on another one, so that the two can never drift apart."""
    return (*rules, *[name for name in more if name not in rules])


def to_long(verdicts: DataFrame, rules: Sequence[str]) -> DataFrame:
    """One row per (slice, instrument, rule)."""
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("rule"), F.col(f"v_{name}").alias("outcome"))
            for name in rules
        ]
    )
    return verdicts.select(*SLICE, "symbol", "listed", F.inline(pairs))


def tallies(verdicts: DataFrame, rules: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """Per slice: candidates, and rejections and not-evaluables for every rule.

    Conditional counts, so a rule nobody failed is zero rather than absent.
    """
    counts = [F.count("*").alias("candidates")]
    for name in rules:
        verdict = F.col(f"v_{name}")
        counts.append(F.count_if(verdict == fv.REJECT).alias(f"rejected_{name}"))
        counts.append(F.count_if(verdict == fv.NOT_EVALUABLE).alias(f"unknown_{name}"))
    return verdicts.groupBy(*SLICE).agg(*counts, *extra)


def band(size: Column) -> Column:
    """Reporting band of a universe size."""
    return (
        F.when(size < fv.TOO_THIN_BELOW, F.lit("too-thin"))
        .when(size <= fv.LOW_POWER_UP_TO, F.lit("low-power"))
        .otherwise(F.lit("ok"))
    )


def monthly_table(verdicts: DataFrame) -> DataFrame:
    """Sizes of the four policies, per-rule tallies and members, per slice."""
    sizes = [
        F.count_if(F.col("`in_liquidity`")).alias("liquidity_size"),
        F.count_if(F.col("`in_research`")).alias("research_size"),
        F.count_if(F.col("`in_research+spread`")).alias("research_with_spread_size"),
        F.count_if(F.col("`in_research+executable`")).alias("executable_size"),
    ]
    return tallies(with_memberships(verdicts), fv.RULE_NAMES, sizes).withColumn(
        "power_band", band(F.col("research_size"))
    )


def member_lists(verdicts: DataFrame, policy: str) -> DataFrame:
    """Sorted member symbols per slice, as an array; a slice without members is empty.

    The array is bounded by the number of instruments a venue lists.
    """
    member = F.col(f"`in_{policy}`")
    listed = F.collect_list(F.when(member, F.concat_ws(":", "venue", "symbol")))
    return verdicts.groupBy(*SLICE).agg(F.sort_array(listed).alias("members"))


def buffered(verdicts: DataFrame, policy: str) -> DataFrame:
    """Two-refresh buffer: two passes in a row to enter, two failures to leave.

    A delisted name leaves at once.  State is carried by the last entering or
    leaving event, over one instrument's refreshes.
    """
    order = Window.partitionBy("venue", "quote_policy", "symbol").orderBy("as_of")
    passing = F.col(f"`in_{policy}`")
    previous = F.coalesce(F.lag(passing).over(order), F.lit(False))
    event = (
        F.when(~F.col("listed"), F.lit(False))
        .when(passing & previous, F.lit(True))
        .when(~passing & ~previous, F.lit(False))
    )
    carried = F.last("event", ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        verdicts.withColumn("passing", passing)
        .withColumn("event", event)
        .withColumn("buffered_member", F.coalesce(carried, F.lit(False)))
    )


#: What a buffered universe has to remember of an instrument from one refresh to the next.
BUFFER_KEY = ("venue", "quote_policy", "symbol")
BUFFER_STATE = "venue string, quote_policy string, symbol string, as_of timestamp, passing boolean, buffered_member boolean"


def buffer_state(history: DataFrame) -> DataFrame:
    """The state after the last refresh of a ``buffered`` history."""
    last = F.max(F.struct("as_of", "passing", "buffered_member")).alias("last")
    return history.groupBy(*BUFFER_KEY).agg(last).select(*BUFFER_KEY, "last.*")


def advance_buffer(state: DataFrame, verdicts: DataFrame, policy: str) -> DataFrame:
    """The state after one more refresh, from the state before it and its verdicts alone.

    Instruments without a verdict keep what they had.  A verdict that is not newer than
    an instrument's state has been counted already and changes nothing, so handing in
    the same refresh twice is harmless.
    """
    fresh = verdicts.select(
        *BUFFER_KEY, F.col("as_of").alias("new_as_of"), F.col(f"`in_{policy}`").alias("new_passing"), F.col("listed").alias("new_listed")
    )
    same = [F.col(f"s.{key}") == F.col(f"v.{key}") for key in BUFFER_KEY]
    both = state.alias("s").join(fresh.alias("v"), same, "full")
    counts = F.col("new_as_of").isNotNull() & (F.col("as_of").isNull() | (F.col("new_as_of") > F.col("as_of")))
    before, member = F.coalesce("passing", F.lit(False)), F.coalesce("buffered_member", F.lit(False))
    decided = (
        F.when(~F.col("new_listed"), F.lit(False))
        .when(F.col("new_passing") & before, F.lit(True))
        .when(~F.col("new_passing") & ~before, F.lit(False))
        .otherwise(member)
    )
    return both.select(
        *[F.coalesce(f"s.{key}", f"v.{key}").alias(key) for key in BUFFER_KEY],
        F.when(counts, F.col("new_as_of")).otherwise(F.col("as_of")).alias("as_of"),
        F.when(counts, F.col("new_passing")).otherwise(F.col("passing")).alias("passing"),
        F.when(counts, decided).otherwise(F.col("buffered_member")).alias("buffered_member"),
    )


def policy_gap(monthly: DataFrame) -> DataFrame:
    """Research against executable over all refreshes of a venue and quote policy."""
    gap = F.col("research_size") - F.col("executable_size")
    earliest_peak = F.struct("research_size", -F.unix_seconds("as_of"))
    return monthly.groupBy("venue", "quote_policy").agg(
        F.count("*").alias("months"),
        F.max(gap).alias("largest_gap"),
        F.count_if(F.col("power_band") == "too-thin").alias("months_too_thin"),
        F.count_if(F.col("power_band") == "low-power").alias("months_low_power"),
        F.count_if(F.col("power_band") == "ok").alias("months_ok"),
        F.max("research_size").alias("peak_research"),
        F.max_by(ts.month_label(F.col("as_of")), earliest_peak).alias("peak_month"),
        F.max_by("executable_size", earliest_peak).alias("executable_at_peak"),
    )
