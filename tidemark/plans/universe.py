"""The point-in-time universe as one declarative plan for all venues and policies."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import instants as ts
from tidemark.operators import history, listing, policy, rules
from tidemark.operators.quality import require_exact
from tidemark.parameters import Thresholds, VenueProfile, announced_delistings, profile_table
from tidemark.session import small, staging_path


@dataclass(frozen=True)
class Market:
    """The inputs of a run.  ``bars`` are unique per key; closed daily ones are used.

    ``facts`` holds one row per instrument and refresh.  Everything after it is
    small next to the bars, and several parts of a plan read it, so a job over
    large data stages it once (:meth:`staged`) instead of scanning bars again.
    """

    bars: DataFrame
    metadata: DataFrame
    spreads: DataFrame
    profiles: tuple[VenueProfile, ...]
    thresholds: Thresholds
    facts: DataFrame
    extents: DataFrame
    given_calendar: DataFrame | None = None
    staged_windows: DataFrame | None = None

    @classmethod
    def of(cls, bars, metadata, spreads, profiles, thresholds) -> Market:
        require_exact(bars, "close", "quote_volume")
        require_exact(metadata, "lot_size", "min_notional")
        require_exact(spreads, "spread_bps")
        # A bar that is still forming is not knowable yet, whatever it says.
        bars = bars.where("timeframe = '1d' AND is_closed")
        facts = history.refresh_facts(bars, thresholds.lookback_days)
        extents = history.extents_of_facts(facts)
        return cls(bars, metadata, spreads, tuple(profiles), thresholds, facts, extents)

    def staged(self, with_bars: bool = False) -> Market:
        """The same market with its facts, windows and calendar in written tables.

        The bars are read once, and what every part of a plan asks for is made once.  A written table cuts the lineage and survives
        the loss of executors, which a cached one does not.  ``with_bars`` also
        writes the bars, for jobs that derive them and then need them again.
        """
        bars, facts = self.bars, self.facts
        if with_bars:
            bars = self._written(bars, "bars")
            facts = history.refresh_facts(bars, self.thresholds.lookback_days)
        facts = self._written(facts, "facts")
        extents = self._written(history.extents_of_facts(facts), "extents")
        market = replace(self, bars=bars, facts=facts, extents=extents)
        market = replace(market, staged_windows=market._written(market.windows, "windows"))
        return replace(market, given_calendar=market._written(market.calendar, "calendar"))

    def _written(self, frame: DataFrame, label: str) -> DataFrame:
        path = staging_path(self.spark, label)
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    @property
    def spark(self):
        return self.bars.sparkSession

    @property
    def venue_count(self) -> int:
        return len(self.profiles)

    @property
    def windows(self) -> DataFrame:
        """Observed windows of the profiled venues: never more rows than profiles."""
        if self.staged_windows is not None:
            return self.staged_windows
        profiled = profile_table(self.spark, self.profiles).select("venue")
        return history.observed_windows(
            self.extents.join(small(profiled, self.venue_count), "venue", "left_semi")
        )

    @property
    def calendar(self) -> DataFrame:
        """The given listing calendar, or the one rebuilt from the bars."""
        if self.given_calendar is not None:
            return self.given_calendar
        return listing.calendar(
            self.extents,
            self.windows,
            self.metadata,
            profile_table(self.spark, self.profiles),
            announced_delistings(self.spark, self.profiles),
            self.venue_count,
            sum(len(p.announced_delistings) for p in self.profiles),
        )

    @property
    def candidates(self) -> DataFrame:
        return listing.candidates(self.metadata, self.calendar)

    @property
    def refreshes(self) -> DataFrame:
        return listing.refreshes(self.windows)

    @property
    def listed(self) -> DataFrame:
        """Calendar entries at each of their venue's refreshes."""
        return listing.listed_at_instants(self.calendar, self.windows, self.venue_count)

    def grid(self) -> DataFrame:
        """Candidates at every refresh of their venue, with what was knowable then.

        The refreshes of a venue travel as one array joined by venue and are
        exploded in place.  Turnover and price come from the facts by an equality
        on (venue, symbol, as_of); what is absent stays NULL.
        """
        spans = self.windows.select(
            "venue",
            ts.refreshes_between(F.col("observed_from"), F.col("observed_to")).alias("asked"),
        )
        cells = (
            self.candidates.join(small(spans, self.venue_count), "venue")
            .withColumn("last_refresh", F.element_at("asked", -1))
            .withColumn("as_of", F.explode("asked"))
            .drop("asked")
        )
        facts = self.facts.drop("first_open", "last_open")
        filled = history.carry_close(cells.join(facts, ["venue", "symbol", "as_of"], "left"))
        return filled.join(
            latest_only(self.spreads), ["venue", "symbol"], "left"
        ).withColumn(
            "spread_bps", F.when(F.col("as_of") == F.col("last_refresh"), F.col("spread_bps"))
        )

    def verdicts(self, *extra_rules: rules.Rule) -> DataFrame:
        """The grid under every quote policy, with one verdict column per rule.

        Only the quote rule depends on the policy; everything costly is computed
        once, before the rows are fanned out to the policies.
        """
        fanned = self.grid().select("*", F.inline(policy.named_quotes(self.thresholds.quote_policies)))
        return policy.judge(fanned, (*rules.standard_rules(self.thresholds), *extra_rules))

    def known_missing(self) -> DataFrame:
        """Per venue and refresh, how many known symbols cannot be rebuilt."""
        return (
            listing.missing_at(self.listed)
            .groupBy("venue", "as_of")
            .agg(F.count("*").alias("known_missing"))
        )

    def monthly(self) -> DataFrame:
        """The monthly table: sizes, tallies, band and known-missing count."""
        return (
            policy.monthly_table(self.verdicts())
            .join(self.known_missing(), ["venue", "as_of"], "left")
            .withColumn("known_missing", F.coalesce("known_missing", F.lit(0)))
            .withColumn("month", ts.month_label(F.col("as_of")))
        )


def latest_only(spreads: DataFrame) -> DataFrame:
    """Newest snapshot per instrument; one that cannot be dated is not evidence."""
    return (
        spreads.where(F.col("observed_at").isNotNull())
        .groupBy("venue", "symbol")
        .agg(F.max(F.struct("observed_at", "spread_bps")).alias("newest"))
        .select("venue", "symbol", "newest.spread_bps")
    )


def instruments_at(
    metadata: DataFrame, calendar: DataFrame, venues: list[str], moments: list[str]
) -> DataFrame:
    """Instruments listed at explicit instants, from a calendar someone supplies.

    A venue the calendar does not cover is refused: today's survivors are not an
    answer about the past.
    """
    have = {row["venue"] for row in calendar.select("venue").distinct().collect()}
    listing.require_calendar(have, set(venues))
    entries = calendar.where(F.col("venue").isin(*venues))
    return listing.listed_on(listing.candidates(metadata, entries), moments)


def universe_at(market: Market, quote_policy: str, chosen: str, moments: list[str]) -> DataFrame:
    """Point lookup: members of a policy at explicit instants.

    Refuses a venue without a calendar instead of answering with nothing.  A spread
    counts if it was measured at exactly the asked instant.  The bars read are
    bounded by the instants.
    """
    have = {row["venue"] for row in market.windows.select("venue").collect()}
    listing.require_calendar(have, {p.venue for p in market.profiles})
    bars, spark = market.bars, market.spark
    asked = F.array(*[F.to_timestamp(F.lit(moment)) for moment in moments])
    cells = market.candidates.withColumn("as_of", F.explode(asked))
    venues = profile_table(spark, market.profiles).select("venue")
    instants = venues.select("venue", F.explode(asked).alias("as_of"))
    moment = lambda text: F.to_timestamp(F.lit(text))
    # A daily bar is visible a day after it opened, so later ones cannot matter.
    visible = bars.where(F.col("open_time") <= F.greatest(*map(moment, moments)) - ts.days(1)) if len(moments) > 1 else bars.where(
        F.col("open_time") <= moment(moments[0]) - ts.days(1)
    )
    first = F.least(*map(moment, moments)) if len(moments) > 1 else moment(moments[0])
    recent = visible.where(F.col("open_time") >= first - ts.days(market.thresholds.lookback_days))
    windowed = history.window_at(recent, instants, market.thresholds.lookback_days)
    measured = (
        market.spreads.where(F.col("observed_at").isNotNull())
        .groupBy("venue", "symbol", F.col("observed_at").alias("as_of"))
        .agg(F.max("spread_bps").alias("spread_bps"))
    )
    grid = (
        cells.join(history.window_statistics(windowed), ["venue", "symbol", "as_of"], "left")
        .join(history.close_as_of(visible, cells), ["venue", "symbol", "as_of"], "left")
        .join(measured, ["venue", "symbol", "as_of"], "left")
        .withColumn("quote_policy", F.lit(quote_policy))
        .withColumn(
            "policy_quotes",
            F.array(*[F.lit(q) for q in market.thresholds.quote_policies[quote_policy]]),
        )
    )
    judged = policy.judge(grid, rules.standard_rules(market.thresholds))
    return policy.with_memberships(judged).where(F.col(f"`in_{chosen}`")).select(
        "venue", "as_of", "symbol"
    )
