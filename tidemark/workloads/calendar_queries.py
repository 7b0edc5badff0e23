"""CAL: listing calendars, refreshes, coverage and survivorship."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.operators import listing
from tidemark.session import dimension
from tidemark.workloads import fixtures as fx
from tidemark.workloads.edge import month, stamp
from tidemark.workloads.registry import query

_ISO = "'%Y-%m-%dT%H:%M:%S'"
ASKED = ["1996-06-01 00:00:00", "1998-01-01 00:00:00", "1999-09-15 12:00:00", "2001-01-01 00:00:00"]
_ASKED_SQL = ", ".join(f"(TIMESTAMP '{moment}')" for moment in ASKED)


@query(
    "cal_1_reconstruct",
    f"""
    SELECT venue, symbol, strftime(listed_at, {_ISO}) AS listed_at, strftime(delisted_at, {_ISO}) AS delisted_at,
           metadata_available FROM fx_calendar""",
)
def reconstruct(spark, sf_dir):
    return fx.market(spark, sf_dir).calendar.select(
        "venue", "symbol", stamp("listed_at"), stamp("delisted_at"), "metadata_available"
    )


@query(
    "cal_2_truncation",
    f"""
    SELECT c.venue, c.symbol, c.provenance, strftime(w.observed_from, {_ISO}) AS edge,
           date_diff('day', w.observed_from, c.listed_at) AS days_after_edge
    FROM fx_calendar c JOIN fx_window w USING (venue) WHERE c.metadata_available""",
)
def truncation(spark, sf_dir):
    """How far each first bar lies from the edge of its venue's window."""
    market = fx.market(spark, sf_dir)
    edges = market.windows.select("venue", F.col("observed_from").alias("edge"))
    return (
        market.calendar.where("metadata_available")
        .join(edges, "venue")
        .select(
            "venue",
            "symbol",
            "provenance",
            stamp("edge"),
            F.datediff("listed_at", "edge").cast("bigint").alias("days_after_edge"),
        )
    )


@query(
    "cal_3_known_missing",
    f"""
    SELECT venue, symbol, strftime(listed_at, {_ISO}) AS listed_at, strftime(delisted_at, {_ISO}) AS delisted_at,
           provenance, (SELECT count(*) FROM fx_calendar) AS entries
    FROM fx_calendar WHERE NOT metadata_available""",
)
def known_missing(spark, sf_dir):
    calendar = fx.market(spark, sf_dir).calendar
    total = calendar.agg(F.count("*").alias("entries"))
    return calendar.where("NOT metadata_available").select(
        "venue", "symbol", stamp("listed_at"), stamp("delisted_at"), "provenance",
        total.scalar().alias("entries"),
    )


@query(
    "cal_4_symbols_at",
    "SELECT venue, strftime(as_of, '%Y-%m') AS month, symbol FROM fx_listed WHERE metadata_available",
)
def symbols_at(spark, sf_dir):
    return listing.symbols_at(fx.market(spark, sf_dir).listed).select("venue", month(), "symbol")


@query(
    "cal_5_missing_at",
    "SELECT venue, strftime(as_of, '%Y-%m') AS month, known_missing FROM fx_missing",
)
def missing_at(spark, sf_dir):
    market = fx.market(spark, sf_dir)
    return market.refreshes.join(market.known_missing(), ["venue", "as_of"], "left").select(
        "venue", month(), F.coalesce("known_missing", F.lit(0)).alias("known_missing")
    )


@query(
    "cal_6_answerability",
    f"""
    SELECT v.venue, strftime(a.as_of, {_ISO}) AS as_of, v.venue <> 'delta' AS answerable,
           CASE WHEN v.venue = 'delta'
                THEN 'no listing calendar: supply one from first and last observed bars' END AS missing,
           CASE WHEN v.venue <> 'delta' THEN coalesce(k.listed, 0)::VARCHAR END AS listed,
           CASE WHEN v.venue <> 'delta' THEN coalesce(k.known_missing, 0)::VARCHAR END AS known_missing,
           CASE WHEN v.venue <> 'delta' THEN coalesce(k.unverified, 0)::VARCHAR END AS unverified,
           CASE WHEN v.venue <> 'delta' THEN round(k.unverified::DOUBLE / nullif(k.listed, 0), 6) END AS unverified_share
    FROM (VALUES ('alpha'), ('beta'), ('delta')) v(venue)
    CROSS JOIN (VALUES {_ASKED_SQL}) a(as_of)
    LEFT JOIN (
      SELECT c.venue, t.as_of, count(*) FILTER (metadata_available) AS listed,
             count(*) FILTER (NOT metadata_available) AS known_missing,
             count(*) FILTER (metadata_available AND provenance = 'unverified') AS unverified
      FROM fx_calendar c JOIN (VALUES {_ASKED_SQL}) t(as_of)
        ON c.listed_at <= t.as_of AND (c.delisted_at IS NULL OR t.as_of < c.delisted_at)
      GROUP BY ALL) k ON k.venue = v.venue AND k.as_of = a.as_of""",
)
def answerability(spark, sf_dir):
    """Two venues that can be answered for and one that nobody has dated."""
    calendar = fx.market(spark, sf_dir).calendar
    schema = pa.schema([("venue", pa.string())])
    asked = dimension(spark, [{"venue": name} for name in ("alpha", "beta", "delta")], schema)
    dated = calendar.select("venue", F.lit(True).alias("dated")).distinct()
    venues = asked.join(dated, "venue", "left").select(
        "venue", F.coalesce("dated", F.lit(False)).alias("has_calendar")
    )
    listed = listing.listed_on(calendar, ASKED)
    return listing.answerability(venues, listed, ASKED).select(
        "venue",
        stamp("as_of"),
        "answerable",
        "missing",
        *[F.col(name).cast("string").alias(name) for name in ("listed", "known_missing", "unverified")],
        "unverified_share",
    )


@query(
    "cal_7_survivorship_loss",
    f"""
    SELECT venue, strftime(as_of, {_ISO}) AS as_of, count(*) AS listed_then,
           count(*) FILTER (delisted_at IS NULL) AS still_listed,
           count(*) FILTER (delisted_at IS NOT NULL) AS later_delisted,
           round(100 * count(*) FILTER (delisted_at IS NOT NULL) / count(*), 2) AS loss_pct
    FROM fx_listed WHERE metadata_available AND month(as_of) = 1 GROUP BY ALL""",
)
def survivorship_loss(spark, sf_dir):
    market = fx.market(spark, sf_dir)
    yearly = market.listed.where(F.month("as_of") == 1)
    return listing.survivorship(yearly).select(
        "venue", stamp("as_of"), "listed_then", "still_listed", "later_delisted", "loss_pct"
    )


@query(
    "cal_8_refresh_instants",
    f"SELECT venue, strftime(as_of, {_ISO}) AS as_of FROM fx_refresh",
)
def refresh_instants(spark, sf_dir):
    return fx.market(spark, sf_dir).refreshes.select("venue", stamp("as_of"))


@query(
    "cal_9_methodology",
    f"SELECT venue, symbol, provenance, note, '{listing.METHOD}' AS methodology FROM fx_calendar",
)
def methodology(spark, sf_dir):
    return fx.market(spark, sf_dir).calendar.select(
        "venue", "symbol", "provenance", "note", F.lit(listing.METHOD).alias("methodology")
    )
