"""Listing calendars rebuilt from observed bars, venue status and announcements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import instants as ts
from tidemark.operators import history, intervals
from tidemark.session import small

METHOD = (
    "listed_at is the first daily bar served, a lower bound. A first bar on the edge of a "
    "truncated window dates the truncation, so its window is unverified. delisted_at is the "
    "close of the last bar and is set only when the venue says the symbol is no longer live. "
    "Announced delistings without metadata are kept as not rebuildable."
)

CALENDAR_COLUMNS = (
    "venue",
    "symbol",
    "listed_at",
    "delisted_at",
    "provenance",
    "note",
    "metadata_available",
)


def calendar(
    extent: DataFrame,
    windows: DataFrame,
    metadata: DataFrame,
    profiles: DataFrame,
    announced: DataFrame,
    venue_count: int,
    announced_count: int,
) -> DataFrame:
    """One window per symbol, with the evidence grade it rests on.

    ``extent`` and ``windows`` cover every series of a venue, before any quote
    filter: the truncation edge is a property of the venue.  Symbols without bars get no
    entry.  An announced delisting replaces a rebuilt entry for the same symbol.
    """
    edges = windows.select("venue", F.col("observed_from").alias("edge"))
    venues = edges.join(small(profiles, venue_count), "venue")
    truncated = F.col("truncates_history") & (F.col("first_open") <= F.col("edge") + ts.days(1))
    live = F.array_contains("live_statuses", F.coalesce("status", F.lit("")))
    status_text = F.concat(F.lit("venue status '"), F.coalesce("status", F.lit("")), F.lit("'; "))
    rebuilt = (
        extent.join(metadata.select("venue", "symbol", "status"), ["venue", "symbol"])
        .join(small(venues, venue_count), "venue")
        .join(
            small(announced.select("venue", "symbol"), announced_count),
            ["venue", "symbol"],
            "left_anti",
        )
        .select(
            "venue",
            "symbol",
            F.col("first_open").alias("listed_at"),
            F.when(~live, F.col("last_open") + ts.days(1)).alias("delisted_at"),
            F.when(truncated, F.lit("unverified"))
            .otherwise(F.lit("reconstructed"))
            .alias("provenance"),
            F.concat(
                status_text,
                F.when(truncated, F.lit("first bar is on the edge of the servable window"))
                .otherwise(F.lit("listing instant is a lower bound")),
            ).alias("note"),
            F.lit(True).alias("metadata_available"),
        )
    )
    missing = announced.join(small(venues, venue_count), "venue", "left_semi").select(
        "venue",
        "symbol",
        F.to_timestamp(F.lit(fv.ANNOUNCED_LISTING_FLOOR)).alias("listed_at"),
        "delisted_at",
        F.lit("venue_announcement").alias("provenance"),
        F.lit("announced delisting; listing instant unknown, membership is an upper bound").alias(
            "note"
        ),
        F.lit(False).alias("metadata_available"),
    )
    return rebuilt.unionByName(missing).select(*CALENDAR_COLUMNS)


def directly_verified(provenance: Column) -> Column:
    return provenance.isin(*fv.DIRECTLY_VERIFIED)


def invalid_window(listed_at: Column, delisted_at: Column) -> Column:
    """A delisting must come after the listing."""
    return F.coalesce(delisted_at <= listed_at, F.lit(False))


def refreshes(windows: DataFrame) -> DataFrame:
    """(venue, as_of): month starts inside each venue's observed window."""
    return windows.select(
        "venue",
        F.explode(ts.refreshes_between(F.col("observed_from"), F.col("observed_to"))).alias(
            "as_of"
        ),
    )


def listed_at_instants(entries: DataFrame, windows: DataFrame, venue_count: int) -> DataFrame:
    """Interval containment: every entry with every refresh at which it was listed.

    The refreshes of a venue form one array, joined by venue; only the contained
    ones are exploded, so non-matching pairs are never rows.
    """
    spans = windows.select(
        "venue",
        ts.refreshes_between(F.col("observed_from"), F.col("observed_to")).alias("asked"),
    )
    contained = F.filter(
        "asked", lambda as_of: ts.is_listed(F.col("listed_at"), F.col("delisted_at"), as_of)
    )
    return (
        entries.join(small(spans, venue_count), "venue")
        .withColumn("as_of", F.explode(contained))
        .drop("asked")
    )


def listed_on(entries: DataFrame, moments: list[str]) -> DataFrame:
    """The same for a short list of explicit UTC instants."""
    asked = F.array(*[F.to_timestamp(F.lit(moment)) for moment in moments])
    contained = F.filter(
        asked, lambda as_of: ts.is_listed(F.col("listed_at"), F.col("delisted_at"), as_of)
    )
    return entries.withColumn("as_of", F.explode(contained))


def listed_when(facts: DataFrame, entries: DataFrame, moment: str, name: str = "listed") -> DataFrame:
    """Every row of ``facts`` with whether its instrument was listed at the row's own instant.

    Only rebuildable windows count.  A row whose instrument has none is not listed;
    a row without an instant has no answer.
    """
    windows = entries.where("metadata_available").select(*history.INSTRUMENT, "listed_at", "delisted_at")
    return intervals.label(facts, windows, list(history.INSTRUMENT), moment, "listed_at", "delisted_at", name)


def symbols_at(listed: DataFrame) -> DataFrame:
    """Listed and rebuildable."""
    return listed.where("metadata_available").select("venue", "as_of", "symbol")


def missing_at(listed: DataFrame) -> DataFrame:
    """Known to have traded, but not rebuildable."""
    return listed.where("NOT metadata_available").select("venue", "as_of", "symbol")


def candidates(metadata: DataFrame, entries: DataFrame) -> DataFrame:
    """Instruments that can be constructed: metadata with a rebuildable window."""
    windows = entries.where("metadata_available").select(
        "venue", "symbol", "listed_at", "delisted_at", "provenance"
    )
    return metadata.join(windows, ["venue", "symbol"])


def provenance_counts(entries: DataFrame, venues: DataFrame) -> DataFrame:
    """Entries per evidence grade, with zero for a grade nothing rests on."""
    grades = F.array(*[F.lit(grade) for grade in fv.PROVENANCE_GRADES])
    counted = entries.groupBy("venue", "provenance").agg(F.count("*").alias("entries"))
    return (
        venues.select("venue", F.explode(grades).alias("provenance"))
        .join(counted, ["venue", "provenance"], "left")
        .select("venue", "provenance", F.coalesce("entries", F.lit(0)).alias("entries"))
    )


def survivorship(listed: DataFrame) -> DataFrame:
    """Per venue and instant: listed then, still listed, later delisted, loss."""
    return (
        listed.where("metadata_available")
        .groupBy("venue", "as_of")
        .agg(
            F.count("*").alias("listed_then"),
            F.count_if(F.col("delisted_at").isNull()).alias("still_listed"),
            F.count_if(F.col("delisted_at").isNotNull()).alias("later_delisted"),
        )
        .withColumn(
            "loss_pct",
            F.round(100 * F.col("later_delisted") / F.col("listed_then"), 2),
        )
    )


def answerability(venues: DataFrame, listed: DataFrame, moments: list[str]) -> DataFrame:
    """Whether each (venue, as_of) question can be answered, and what is lacking.

    A venue without a calendar is a row that says so, never an empty answer.
    """
    asked = F.array(*[F.to_timestamp(F.lit(moment)) for moment in moments])
    known = listed.groupBy("venue", "as_of").agg(
        F.count_if("metadata_available").alias("listed"),
        F.count_if(~F.col("metadata_available")).alias("known_missing"),
        F.count_if(F.col("metadata_available") & (F.col("provenance") == "unverified")).alias(
            "unverified"
        ),
    )
    return (
        venues.select("venue", "has_calendar", F.explode(asked).alias("as_of"))
        .join(known, ["venue", "as_of"], "left")
        .select(
            "venue",
            "as_of",
            F.col("has_calendar").alias("answerable"),
            F.when(
                ~F.col("has_calendar"),
                F.lit("no listing calendar: supply one from first and last observed bars"),
            ).alias("missing"),
            F.when(F.col("has_calendar"), F.coalesce("listed", F.lit(0))).alias("listed"),
            F.when(F.col("has_calendar"), F.coalesce("known_missing", F.lit(0))).alias(
                "known_missing"
            ),
            F.when(F.col("has_calendar"), F.coalesce("unverified", F.lit(0))).alias("unverified"),
        )
        .withColumn("unverified_share", F.round(F.expr("try_divide(unverified, listed)"), 6))
    )


def require_calendar(calendar_venues: set[str], asked: set[str]) -> None:
    """Refuse a historical question about a venue nobody has dated."""
    lacking = sorted(asked - calendar_venues)
    if lacking:
        raise LookupError(
            f"no listing calendar for {', '.join(lacking)}: supply one from first and last bars"
        )
