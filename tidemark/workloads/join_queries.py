"""JN and WIN: range, as-of and set joins, and ordered histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import instants as ts
from tidemark.operators import coverage, cross_section, history, intervals, listing, order_statistics, policy, rules
from tidemark.plans.universe import latest_only
from tidemark.session import staging_path
from tidemark.sources import bars as bar_source
from tidemark.workloads import fixtures as fx
from tidemark.workloads.edge import exact, month, stamp
from tidemark.workloads.registry import query

_ISO = "'%Y-%m-%dT%H:%M:%S'"


@query(
    "jn_1_window_join",
    f"""
    SELECT b.venue, b.symbol, strftime(r.as_of, '%Y-%m') AS month, count(*) AS bars,
           strftime(min(b.open_time), {_ISO}) AS first_open, strftime(max(b.open_time), {_ISO}) AS last_open
    FROM fx_bars b JOIN (
      SELECT DISTINCT unnest(range(TIMESTAMP '1990-01-01', TIMESTAMP '2010-01-01', INTERVAL 1 MONTH)) AS as_of) r
      ON b.open_time >= r.as_of - INTERVAL 30 DAY AND b.open_time <= r.as_of - INTERVAL 1 DAY
    GROUP BY b.venue, b.symbol, r.as_of""",
)
def window_join(spark, sf_dir):
    """Bars to the month starts whose trailing window holds them, without a join."""
    attached = history.to_refreshes(fx.daily_bars(spark, sf_dir), 30).where("in_window")
    return attached.groupBy("venue", "symbol", "as_of").agg(
        F.count("*").alias("bars"),
        F.min("open_time").alias("first_open"),
        F.max("open_time").alias("last_open"),
    ).select("venue", "symbol", month(), "bars", stamp("first_open"), stamp("last_open"))


def _probes(spark, sf_dir: str):
    """Every order asks for one brand's price at midnight of its date."""
    n = F.col("o_orderkey") % 25 + 1
    return fx.table(spark, sf_dir, "orders").select(
        F.when(n <= 15, "alpha").otherwise("beta").alias("venue"),
        F.concat(F.lit("Brand#"), n.cast("string")).alias("symbol"),
        F.col("o_orderdate").cast("timestamp").alias("as_of"),
    )


@query(
    "jn_2_asof_join",
    f"""
    SELECT p.venue, p.symbol, strftime(p.as_of, {_ISO}) AS as_of,
           b.close::DECIMAL(34,2)::VARCHAR AS close_as_of
    FROM (SELECT DISTINCT CASE WHEN o_orderkey % 25 + 1 <= 15 THEN 'alpha' ELSE 'beta' END AS venue,
                 'Brand#' || (o_orderkey % 25 + 1) AS symbol, o_orderdate AS as_of FROM orders) p
    ASOF LEFT JOIN (SELECT venue, symbol, open_time + INTERVAL 1 DAY AS closed, close FROM fx_bars) b
      ON b.venue = p.venue AND b.symbol = p.symbol AND p.as_of >= b.closed""",
)
def asof_join(spark, sf_dir):
    found = history.close_as_of(fx.daily_bars(spark, sf_dir), _probes(spark, sf_dir))
    return found.select("venue", "symbol", stamp("as_of"), exact("close_as_of", 2))


@query(
    "jn_3_interval_containment",
    "SELECT venue, strftime(as_of, '%Y-%m') AS month, symbol, metadata_available FROM fx_listed",
)
def interval_containment(spark, sf_dir):
    return fx.market(spark, sf_dir).listed.select("venue", month(), "symbol", "metadata_available")


@query(
    "jn_3_listed_per_print",
    """
    SELECT venue, symbol, listed, count(*) AS prints, sum(quote_qty)::DECIMAL(34,2)::VARCHAR AS turnover,
           strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS first_print, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_print
    FROM (SELECT p.*, EXISTS (SELECT 1 FROM fx_calendar c WHERE c.venue = p.venue AND c.symbol = p.symbol AND c.metadata_available
                              AND c.listed_at <= p.ts AND (c.delisted_at IS NULL OR p.ts < c.delisted_at)) AS listed
          FROM fx_every_print p)
    GROUP BY ALL""",
)
def listed_per_print(spark, sf_dir):
    """Every print against the calendar at its own instant, those outside all windows included."""
    labelled = listing.listed_when(fx.all_prints(spark, sf_dir), fx.market(spark, sf_dir).calendar, "ts")
    return labelled.groupBy("venue", "symbol", "listed").agg(
        F.count("*").alias("prints"),
        exact(F.sum("quote_qty"), 2, "turnover"),
        stamp(F.min("ts"), "first_print"),
        stamp(F.max("ts"), "last_print"),
    )


@query(
    "jn_3_trading_phase_per_print",
    """
    SELECT venue, symbol, busy, count(*) AS prints
    FROM (SELECT p.*, EXISTS (
            SELECT 1 FROM fx_bars c WHERE c.volume > 60 AND c.venue = p.venue AND c.symbol = p.symbol AND c.open_time <= p.ts
            AND p.ts < c.open_time + CASE WHEN volume > 250 THEN INTERVAL 400 DAY WHEN volume > 100 THEN INTERVAL 20 DAY
                                          ELSE INTERVAL 36 HOUR END) AS busy
          FROM fx_every_print p)
    GROUP BY ALL""",
)
def trading_phase_per_print(spark, sf_dir):
    """Very many overlapping phases per instrument, from 36 hours to 400 days, against every print.

    A phase begins with a busy day and lasts the longer, the busier the day was.
    """
    long, middle, short = (F.expr(f"INTERVAL {span}") for span in ("400 DAY", "20 DAY", "36 HOUR"))
    volume = F.col("volume")
    phases = fx.daily_bars(spark, sf_dir).where(volume > 60).select(
        "venue", "symbol", F.col("open_time").alias("opened"),
        (F.when(volume > 250, F.col("open_time") + long).when(volume > 100, F.col("open_time") + middle)
         .otherwise(F.col("open_time") + short)).alias("ended"),
    )
    labelled = intervals.label(fx.all_prints(spark, sf_dir), phases, ["venue", "symbol"], "ts", "opened", "ended", "busy")
    return labelled.groupBy("venue", "symbol", "busy").agg(F.count("*").alias("prints"))


@query(
    "jn_4_candidates",
    f"""
    SELECT venue, symbol, base, quote, lot_size::DECIMAL(34,3)::VARCHAR AS lot_size,
           min_notional::DECIMAL(34,2)::VARCHAR AS min_notional,
           strftime(listed_at, {_ISO}) AS listed_at, strftime(delisted_at, {_ISO}) AS delisted_at, provenance,
           '2001-11-05T12:00:00' AS constraints_as_of
    FROM fx_candidates""",
)
def candidates(spark, sf_dir):
    return fx.market(spark, sf_dir).candidates.select(
        "venue",
        "symbol",
        "base",
        "quote",
        exact("lot_size", 3),
        exact("min_notional", 2),
        stamp("listed_at"),
        stamp("delisted_at"),
        "provenance",
        stamp("constraints_as_of"),
    )


@query(
    "jn_5_absent_is_not_zero",
    """
    SELECT venue, symbol, strftime(as_of, '%Y-%m') AS month, coalesce(observations, 0) AS observations,
           median_quote_volume::DECIMAL(34,4)::VARCHAR AS median_quote_volume
    FROM fx_grid""",
)
def absent_is_not_zero(spark, sf_dir):
    return fx.market(spark, sf_dir).grid().select(
        "venue",
        "symbol",
        month(),
        F.coalesce("observations", F.lit(0)).alias("observations"),
        exact("median_quote_volume", 4),
    )


@query(
    "jn_6_evaluation_cells",
    """
    SELECT venue, strftime(as_of, '%Y-%m') AS month, rule, count(*) AS cells
    FROM fx_candidates JOIN fx_refresh USING (venue)
    CROSS JOIN (VALUES ('quote_currency'), ('listing_age'), ('median_quote_volume'), ('median_spread'),
                       ('min_notional_feasible'), ('lot_size_feasible'), ('asset_class')) t(rule)
    GROUP BY venue, as_of, rule""",
)
def evaluation_cells(spark, sf_dir):
    """Every candidate meets every rule at every refresh of its venue.

    The three-way product is never built: cells are counted per refresh and the
    counts are fanned out to the rules.
    """
    rules = F.array(*[F.lit(name) for name in fv.RULE_NAMES])
    per_refresh = fx.market(spark, sf_dir).grid().groupBy("venue", "as_of").agg(
        F.count("*").alias("cells")
    )
    return per_refresh.select("venue", month(), F.explode(rules).alias("rule"), "cells")


@query(
    "jn_7_not_yet_stored",
    """
    SELECT venue, symbol, CAST(year AS INT) AS year FROM fx_listing, range(1995, 2002) t(year)
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = key AND year(l_shipdate) = year)""",
)
def not_yet_stored(spark, sf_dir):
    """Resume a collection of yearly series: a part's year counts as stored with its first line."""
    stored = (
        fx.table(spark, sf_dir, "lineitem")
        .select(F.col("l_partkey").alias("key"), F.year("l_shipdate").alias("year"))
        .distinct()
        .join(fx.listings(spark, sf_dir), "key")
    )
    wanted = fx.listings(spark, sf_dir).select("venue", "symbol", F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("year"))
    return coverage.not_yet_stored(wanted, stored, also=["year"])


@query(
    "jn_8_wanted_only",
    """
    SELECT venue, symbol, count(*) AS prints, sum(quote_qty)::DECIMAL(34,2)::VARCHAR AS turnover
    FROM fx_every_print WHERE symbol IN (SELECT symbol FROM fx_meta WHERE quote <> 'USDT') GROUP BY ALL""",
)
def wanted_only(spark, sf_dir):
    wanted = fx.metadata(spark, sf_dir).where("quote <> 'USDT'")
    kept = bar_source.for_instruments(fx.all_prints(spark, sf_dir), wanted)
    return kept.groupBy("venue", "symbol").agg(
        F.count("*").alias("prints"), exact(F.sum("quote_qty"), 2, "turnover")
    )


@query(
    "jn_9_snapshot_on_last_refresh",
    """
    SELECT venue, symbol, strftime(as_of, '%Y-%m') AS month, spread_bps::DECIMAL(34,2)::VARCHAR AS spread_bps
    FROM fx_grid WHERE spread_bps IS NOT NULL""",
)
def snapshot_on_last_refresh(spark, sf_dir):
    """The newest dated snapshot counts at the venue's last refresh only."""
    market = fx.market(spark, sf_dir)
    last = market.refreshes.groupBy("venue").agg(F.max("as_of").alias("as_of"))
    attached = market.candidates.join(last, "venue").join(
        latest_only(market.spreads), ["venue", "symbol"]
    )
    return attached.select("venue", "symbol", month(), exact("spread_bps", 2))


_MID_MONTHS = """
    SELECT venue, as_of + INTERVAL 14 DAY + INTERVAL 12 HOUR AS as_of FROM fx_refresh"""


@query(
    "win_1_trailing_window",
    f"""
    SELECT b.venue, b.symbol, strftime(r.as_of, {_ISO}) AS as_of, count(*) AS observations,
           median(b.quote_volume::DECIMAL(28,4))::DECIMAL(34,4)::VARCHAR AS median_quote_volume
    FROM fx_bars b JOIN ({_MID_MONTHS}) r ON b.venue = r.venue
     AND b.open_time >= r.as_of - INTERVAL 30 DAY AND b.open_time <= r.as_of - INTERVAL 1 DAY
    GROUP BY b.venue, b.symbol, r.as_of""",
)
def trailing_window(spark, sf_dir):
    """Thirty days at arbitrary instants: noon in the middle of each month."""
    market = fx.market(spark, sf_dir, with_bars=True)
    asked = market.refreshes.select(
        "venue", (F.col("as_of") + F.expr("INTERVAL '14 12' DAY TO HOUR")).alias("as_of")
    )
    windowed = history.window_at(market.bars, asked, 30)
    return history.window_statistics(windowed).select(
        "venue", "symbol", stamp("as_of"), "observations", exact("median_quote_volume", 4)
    )


_WEEKS = ("2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29", "2024-02-01")
_MINUTE_SQL = f"""
    SELECT b.venue, b.symbol, r.as_of, count(*) AS observations,
           median(b.quote_volume::DECIMAL(28,4)) AS median_quote_volume
    FROM fx_intraday_bars b JOIN (SELECT unnest([{", ".join(f"TIMESTAMP '{w}'" for w in _WEEKS)}]) AS as_of) r
      ON b.open_time >= r.as_of - INTERVAL 30 DAY AND b.open_time <= r.as_of - INTERVAL 1 MINUTE
    WHERE b.timeframe = '1m' GROUP BY b.venue, b.symbol, r.as_of"""


def minute_windows(spark, sf_dir: str):
    """One-minute bars of the thirty days before each of five instants, as a table."""
    bars = bar_source.from_prints(fx.intraday_prints(spark, sf_dir), "1m", ["ts", "event_id"])
    asked = spark.range(1).select(
        F.lit("gamma").alias("venue"), F.explode(F.array(*[F.to_timestamp(F.lit(w)) for w in _WEEKS])).alias("as_of")
    )
    windowed = history.window_at(bars, asked, 30, fv.TIMEFRAME_SECONDS["1m"])
    path = staging_path(spark, "minute-windows")
    windowed.select("venue", "symbol", "as_of", "open_time", "quote_volume").write.parquet(path)
    return spark.read.parquet(path)


@query(
    "agg_1_median_of_minute_bars",
    f"""
    SELECT venue, symbol, strftime(as_of, {_ISO}) AS as_of, observations,
           median_quote_volume::DECIMAL(34,4)::VARCHAR AS median_quote_volume FROM ({_MINUTE_SQL})""",
)
def median_of_minute_bars(spark, sf_dir):
    """Exact medians of windows with tens of thousands of bars: counted, never gathered."""
    return history.window_medians(minute_windows(spark, sf_dir)).select(
        "venue", "symbol", stamp("as_of"), "observations", exact("median_quote_volume", 4)
    )


@query(
    "rul_3_minute_bars",
    f"""
    SELECT venue, symbol, strftime(as_of, {_ISO}) AS as_of,
           CASE WHEN observations < 667 THEN 'not_evaluable' WHEN median_quote_volume >= 450 THEN 'admit' ELSE 'reject' END AS outcome
    FROM ({_MINUTE_SQL})""",
)
def minute_bar_rule(spark, sf_dir):
    """The turnover rule on minute bars, with a floor and a count that fit them."""
    rule = rules.median_quote_volume("450", 667)
    facts = history.window_medians(minute_windows(spark, sf_dir))
    return facts.select("venue", "symbol", stamp("as_of"), rule.verdict().alias("outcome"))


@query(
    "agg_1_median_of_prints",
    """
    SELECT venue, count(*) AS observations, median(quote_qty::DECIMAL(28,4))::DECIMAL(34,4)::VARCHAR AS median_quote_volume
    FROM fx_every_print GROUP BY ALL""",
)
def median_of_prints(spark, sf_dir):
    """The median trade of a venue over all its prints: two groups that hold everything."""
    found = order_statistics.exact_medians(fx.all_prints(spark, sf_dir), ["venue"], "quote_qty")
    return found.select("venue", "observations", exact("median", 4, "median_quote_volume"))


@query(
    "win_2_ordered_history",
    f"""
    SELECT venue, symbol, strftime(open_time, {_ISO}) AS open_time,
           row_number() OVER (PARTITION BY venue, symbol ORDER BY open_time) AS ordinal,
           close::DECIMAL(34,2)::VARCHAR AS close
    FROM fx_bars""",
)
def ordered_history(spark, sf_dir):
    """Duplicates are removed first: every bar is given twice, the older copy wrong."""
    good = fx.staged_bars(spark, sf_dir)
    stale = good.withColumn("close", F.lit(0).cast("decimal(20,10)")).withColumn(
        "observed_at", F.col("observed_at") - ts.days(1)
    )
    clean = bar_source.newest_observation(good.unionByName(stale))
    return history.ordinals(clean).select(
        "venue", "symbol", stamp("open_time"), "ordinal", exact("close", 2)
    )


@query(
    "win_3_known_at",
    f"""
    SELECT b.venue, b.symbol, strftime(r.as_of, '%Y-%m') AS month,
           strftime(max(b.open_time), {_ISO}) AS last_open,
           arg_max(b.close, b.open_time)::DECIMAL(34,2)::VARCHAR AS close
    FROM fx_bars b JOIN fx_refresh r ON b.venue = r.venue AND b.open_time <= r.as_of - INTERVAL 1 DAY
    GROUP BY b.venue, b.symbol, r.as_of""",
)
def known_at(spark, sf_dir):
    """The last visible bar of every history at every refresh of its venue."""
    grid = fx.market(spark, sf_dir)
    cells = grid.candidates.join(grid.refreshes, "venue").select("venue", "symbol", "as_of")
    facts = cells.join(grid.facts, ["venue", "symbol", "as_of"], "left")
    filled = history.carry_close(facts).withColumn(
        "seen", F.max("last_open").over(history.so_far())
    )
    return filled.where(F.col("seen").isNotNull()).select(
        "venue", "symbol", month(), stamp("seen", "last_open"), exact("close_as_of", 2, "close")
    )


@query(
    "win_4_rank_and_score",
    """
    SELECT venue, quote_policy, strftime(as_of, '%Y-%m') AS month, symbol,
           rank() OVER (PARTITION BY venue, quote_policy, as_of ORDER BY median_quote_volume DESC) AS rank,
           round((median_quote_volume::DOUBLE - avg(median_quote_volume::DOUBLE) OVER w)
             / nullif(stddev_samp(median_quote_volume::DOUBLE) OVER w, 0), 6) AS z_score
    FROM fx_verdicts WHERE in_liquidity
    WINDOW w AS (PARTITION BY venue, quote_policy, as_of)""",
)
def rank_and_score(spark, sf_dir):
    """Members only: a name entering or leaving changes everybody's rank and score."""
    verdicts = policy.with_memberships(fx.market(spark, sf_dir).verdicts())
    scored = cross_section.rank_and_score(verdicts.where("in_liquidity"), "median_quote_volume")
    return scored.select(
        "venue",
        "quote_policy",
        month(),
        "symbol",
        F.col("rank").cast("bigint").alias("rank"),
        F.round("z_score", 6).alias("z_score"),
    )
