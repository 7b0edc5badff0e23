"""POL and SNK-5..7: policies, monthly tables and their report forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.operators import costs, listing, policy
from tidemark.plans import report, universe
from tidemark.session import staging_path
from tidemark.sinks import states
from tidemark.workloads import fixtures as fx
from tidemark.workloads.edge import exact, month, stamp
from tidemark.workloads.registry import query

_MONTHLY = """
    venue, quote_policy, month, candidates, liquidity_size, research_size, research_with_spread_size,
    executable_size, power_band, known_missing,
    rejected_quote_currency, rejected_listing_age, rejected_median_quote_volume, rejected_median_spread,
    rejected_min_notional_feasible, rejected_lot_size_feasible, rejected_asset_class,
    unknown_listing_age, unknown_median_quote_volume, unknown_median_spread, unknown_lot_size_feasible"""
_MONTHLY_COLUMNS = [name.strip() for name in _MONTHLY.split(",")]


@query(
    "pol_1_evaluate",
    """
    SELECT venue, quote_policy, strftime(as_of, '%Y-%m') AS month, symbol, rule, outcome, listed
    FROM (UNPIVOT (SELECT venue, quote_policy, as_of, symbol, listed, v_quote_currency, v_listing_age,
              v_median_quote_volume, v_median_spread, v_min_notional_feasible, v_lot_size_feasible,
              v_asset_class FROM fx_verdicts)
          ON v_quote_currency AS 'quote_currency', v_listing_age AS 'listing_age',
             v_median_quote_volume AS 'median_quote_volume', v_median_spread AS 'median_spread',
             v_min_notional_feasible AS 'min_notional_feasible',
             v_lot_size_feasible AS 'lot_size_feasible', v_asset_class AS 'asset_class'
          INTO NAME rule VALUE outcome)""",
)
def evaluate(spark, sf_dir):
    verdicts = fx.market(spark, sf_dir).verdicts()
    return policy.to_long(verdicts, fv.RULE_NAMES).select(
        "venue", "quote_policy", month(), "symbol", "rule", "outcome", "listed"
    )


@query(
    "pol_2_members",
    """
    SELECT venue, quote_policy, strftime(as_of, '%Y-%m') AS month,
           coalesce(string_agg(venue || ':' || symbol, ',' ORDER BY venue || ':' || symbol)
                    FILTER (in_liquidity), '') AS members
    FROM fx_verdicts GROUP BY venue, quote_policy, as_of""",
)
def members(spark, sf_dir):
    verdicts = policy.with_memberships(fx.market(spark, sf_dir).verdicts())
    return policy.member_lists(verdicts, "liquidity").select(
        "venue", "quote_policy", month(), F.array_join("members", ",").alias("members")
    )


@query(
    "pol_3_rule_tallies",
    """
    SELECT venue, quote_policy, strftime(as_of, '%Y-%m') AS month, rule,
           count(*) AS candidates, count(*) FILTER (outcome = 'reject') AS rejected,
           count(*) FILTER (outcome = 'not_evaluable') AS not_evaluable
    FROM (UNPIVOT (SELECT venue, quote_policy, as_of, v_quote_currency, v_listing_age,
              v_median_quote_volume, v_median_spread, v_min_notional_feasible, v_lot_size_feasible,
              v_asset_class FROM fx_verdicts)
          ON v_quote_currency AS 'quote_currency', v_listing_age AS 'listing_age',
             v_median_quote_volume AS 'median_quote_volume', v_median_spread AS 'median_spread',
             v_min_notional_feasible AS 'min_notional_feasible',
             v_lot_size_feasible AS 'lot_size_feasible', v_asset_class AS 'asset_class'
          INTO NAME rule VALUE outcome)
    GROUP BY venue, quote_policy, as_of, rule""",
)
def rule_tallies(spark, sf_dir):
    """Counted wide, one row per slice, and only then turned into rows per rule."""
    counted = policy.tallies(fx.market(spark, sf_dir).verdicts(), fv.RULE_NAMES)
    per_rule = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                F.col(f"rejected_{name}").alias("rejected"),
                F.col(f"unknown_{name}").alias("not_evaluable"),
            )
            for name in fv.RULE_NAMES
        ]
    )
    return counted.select("venue", "quote_policy", month(), "candidates", F.inline(per_rule))


@query(
    "pol_4_named_policies",
    """
    SELECT venue, quote_policy, strftime(as_of, '%Y-%m') AS month, symbol, policy
    FROM (
      SELECT *, 'liquidity' AS policy FROM fx_verdicts WHERE in_liquidity
      UNION ALL SELECT *, 'research' FROM fx_verdicts WHERE in_research
      UNION ALL SELECT *, 'research+spread' FROM fx_verdicts WHERE in_spread
      UNION ALL SELECT *, 'research+executable' FROM fx_verdicts WHERE in_executable)""",
)
def named_policies(spark, sf_dir):
    verdicts = policy.with_memberships(fx.market(spark, sf_dir).verdicts())
    joined = F.filter(
        F.array(
            *[F.when(F.col(f"`in_{name}`"), F.lit(name)) for name in fv.POLICY_RULES]
        ),
        lambda name: name.isNotNull(),
    )
    return verdicts.select(
        "venue", "quote_policy", month(), "symbol", F.explode(joined).alias("policy")
    )


@query(
    "pol_5_power_band",
    """
    SELECT strftime(as_of, '%Y-%m') AS month, count(*) AS listed_candidates,
           CASE WHEN count(*) < 15 THEN 'too-thin' WHEN count(*) <= 25 THEN 'low-power' ELSE 'ok' END AS band
    FROM fx_listed WHERE metadata_available GROUP BY as_of""",
)
def power_band(spark, sf_dir):
    """Bands of the listed candidates of both venues together."""
    return (
        listing.symbols_at(fx.market(spark, sf_dir).listed)
        .groupBy("as_of")
        .agg(F.count("*").alias("listed_candidates"))
        .select(month(), "listed_candidates", policy.band(F.col("listed_candidates")).alias("band"))
    )


@query(
    "pol_6_boolean_universe",
    """
    SELECT venue, strftime(as_of, '%Y-%m') AS month, symbol FROM fx_verdicts
    WHERE quote_policy = 'EUR+USD' AND listed AND v_quote_currency = 'admit'
      AND v_min_notional_feasible = 'admit'""",
)
def boolean_universe(spark, sf_dir):
    """Listed and every user rule admits; a filter, so rows are dropped early."""
    verdicts = fx.market(spark, sf_dir).verdicts().where("quote_policy = 'EUR+USD'")
    chosen = (fv.QUOTE_CURRENCY, fv.MIN_NOTIONAL_FEASIBLE)
    return verdicts.where(policy.is_member(chosen)).select("venue", month(), "symbol")


@query("pol_7_monthly_table", f"SELECT {_MONTHLY} FROM fx_monthly")
def monthly_table(spark, sf_dir):
    return fx.market(spark, sf_dir).monthly().select(*_MONTHLY_COLUMNS)


@query(
    "pol_8_policy_rules",
    """
    SELECT policy, rule, position, n.candidates FROM (VALUES
      ('liquidity', 'quote_currency', 1), ('liquidity', 'median_quote_volume', 2), ('liquidity', 'asset_class', 3),
      ('research', 'quote_currency', 1), ('research', 'listing_age', 2), ('research', 'median_quote_volume', 3),
      ('research', 'asset_class', 4),
      ('research+spread', 'quote_currency', 1), ('research+spread', 'listing_age', 2),
      ('research+spread', 'median_quote_volume', 3), ('research+spread', 'asset_class', 4),
      ('research+spread', 'median_spread', 5),
      ('research+executable', 'quote_currency', 1), ('research+executable', 'listing_age', 2),
      ('research+executable', 'median_quote_volume', 3), ('research+executable', 'asset_class', 4),
      ('research+executable', 'min_notional_feasible', 5), ('research+executable', 'lot_size_feasible', 6)
    ) t(policy, rule, position), (SELECT count(*) AS candidates FROM fx_candidates) n""",
)
def policy_rules(spark, sf_dir):
    """The rule names recorded with the run, next to the candidates they judged."""
    judged = fx.market(spark, sf_dir).candidates.agg(F.count("*").alias("candidates"))
    return report.run_record(judged)


@query(
    "pol_9_two_refresh_buffer",
    """
    SELECT venue, quote_policy, symbol, strftime(as_of, '%Y-%m') AS month, in_liquidity AS passing,
           coalesce(last_value(event IGNORE NULLS) OVER (
             PARTITION BY venue, quote_policy, symbol ORDER BY as_of
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), FALSE) AS buffered_member
    FROM (SELECT *, CASE WHEN NOT listed THEN FALSE
             WHEN in_liquidity AND coalesce(lag(in_liquidity) OVER w, FALSE) THEN TRUE
             WHEN NOT in_liquidity AND NOT coalesce(lag(in_liquidity) OVER w, FALSE) THEN FALSE END AS event
          FROM fx_verdicts
          WINDOW w AS (PARTITION BY venue, quote_policy, symbol ORDER BY as_of))""",
)
def two_refresh_buffer(spark, sf_dir):
    verdicts = policy.with_memberships(fx.market(spark, sf_dir).verdicts())
    return policy.buffered(verdicts, "liquidity").select(
        "venue", "quote_policy", "symbol", month(), "passing", "buffered_member"
    )


_BUFFERED_SQL = """
    SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (
             PARTITION BY venue, quote_policy, symbol ORDER BY as_of
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), FALSE) AS buffered_member
    FROM (SELECT *, CASE WHEN NOT listed THEN FALSE
             WHEN in_liquidity AND coalesce(lag(in_liquidity) OVER w, FALSE) THEN TRUE
             WHEN NOT in_liquidity AND NOT coalesce(lag(in_liquidity) OVER w, FALSE) THEN FALSE END AS event
          FROM fx_verdicts
          WINDOW w AS (PARTITION BY venue, quote_policy, symbol ORDER BY as_of))"""


@query(
    "pol_9_carried_state",
    f"""
    SELECT venue, quote_policy, symbol, strftime(as_of, '%Y-%m') AS month, in_liquidity AS passing, buffered_member
    FROM ({_BUFFERED_SQL}) WHERE as_of IN (SELECT as_of FROM fx_refresh GROUP BY as_of ORDER BY as_of DESC LIMIT 3)""",
)
def carried_state(spark, sf_dir):
    """The last three months, each from the state of the month before; the last is taken in twice."""
    path = staging_path(spark, "verdicts")
    policy.with_memberships(fx.market(spark, sf_dir).verdicts()).select(
        "venue", "quote_policy", "symbol", "as_of", "listed", "in_liquidity"
    ).write.parquet(path)
    verdicts = spark.read.parquet(path)
    # One name per month.
    months = sorted(r["day"] for r in verdicts.select(F.date_format("as_of", "yyyy-MM-dd").alias("day")).distinct().collect())
    day = F.date_format("as_of", "yyyy-MM-dd")
    kept = states.BufferStates(spark, staging_path(spark, "buffer"), "liquidity")
    kept.begin(months[-4], policy.buffered(verdicts.where(day <= months[-4]), "liquidity"))
    for name in (*months[-3:], months[-1]):
        kept.take(name, verdicts.where(day == name))
    found = [kept.at(name).where(day == name) for name in months[-3:]]
    return found[0].unionByName(found[1]).unionByName(found[2]).select(
        "venue", "quote_policy", "symbol", month(), "passing", "buffered_member"
    )


@query(
    "pol_10_policy_gap",
    """
    SELECT venue, quote_policy, count(*) AS months, max(research_size - executable_size) AS largest_gap,
           count(*) FILTER (power_band = 'too-thin') AS months_too_thin,
           count(*) FILTER (power_band = 'low-power') AS months_low_power,
           count(*) FILTER (power_band = 'ok') AS months_ok, max(research_size) AS peak_research,
           first(month ORDER BY research_size DESC, as_of) AS peak_month,
           first(executable_size ORDER BY research_size DESC, as_of) AS executable_at_peak
    FROM fx_monthly GROUP BY ALL""",
)
def policy_gap(spark, sf_dir):
    return policy.policy_gap(fx.market(spark, sf_dir).monthly())


@query(
    "pol_11_delisting_markout",
    """
    SELECT c.venue, c.symbol, strftime(c.delisted_at, '%Y-%m-%dT%H:%M:%S') AS delisted_at,
           strftime(max(b.open_time), '%Y-%m-%dT%H:%M:%S') AS last_traded,
           arg_max(b.close, b.open_time)::DECIMAL(34,2)::VARCHAR AS exit_price
    FROM fx_calendar c JOIN fx_bars b USING (venue, symbol)
    WHERE c.delisted_at IS NOT NULL GROUP BY ALL""",
)
def delisting_markout(spark, sf_dir):
    market = fx.market(spark, sf_dir, with_bars=True)
    return costs.delisting_markout(market.calendar, market.bars).select(
        "venue", "symbol", stamp("delisted_at"), stamp("last_traded"), exact("exit_price", 2)
    )


@query(
    "snk_5_month_rows_json",
    """
    SELECT venue, quote_policy, month, json_object(
        'month', month, 'liquidity_size', liquidity_size, 'research_size', research_size,
        'research_with_spread_size', research_with_spread_size, 'executable_size', executable_size,
        'known_missing', known_missing, 'power_band', power_band, 'candidates', candidates,
        'research_rejected', json_object('asset_class', rejected_asset_class,
            'listing_age', rejected_listing_age, 'median_quote_volume', rejected_median_quote_volume,
            'quote_currency', rejected_quote_currency),
        'research_not_evaluable', json_object('asset_class', unknown_asset_class,
            'listing_age', unknown_listing_age, 'median_quote_volume', unknown_median_quote_volume,
            'quote_currency', unknown_quote_currency),
        'executable_rejected', json_object('asset_class', rejected_asset_class,
            'listing_age', rejected_listing_age, 'lot_size_feasible', rejected_lot_size_feasible,
            'median_quote_volume', rejected_median_quote_volume,
            'min_notional_feasible', rejected_min_notional_feasible, 'quote_currency', rejected_quote_currency),
        'executable_not_evaluable', json_object('asset_class', unknown_asset_class,
            'listing_age', unknown_listing_age, 'lot_size_feasible', unknown_lot_size_feasible,
            'median_quote_volume', unknown_median_quote_volume,
            'min_notional_feasible', unknown_min_notional_feasible, 'quote_currency', unknown_quote_currency),
        'research_members', coalesce(members, [])
      )::VARCHAR AS payload
    FROM fx_monthly LEFT JOIN (
      SELECT venue, quote_policy, as_of, list(venue || ':' || symbol ORDER BY venue || ':' || symbol) AS members
      FROM fx_verdicts WHERE in_research GROUP BY ALL) USING (venue, quote_policy, as_of)""",
)
def month_rows_json(spark, sf_dir):
    return report.month_rows(fx.market(spark, sf_dir)).select(
        "venue", "quote_policy", "month", "payload"
    )


@query(
    "snk_6_monthly_report",
    """
    SELECT venue, quote_policy, month, liquidity_size AS liquidity, research_size AS research,
           research_with_spread_size AS with_spread, executable_size AS executable, power_band AS band,
           known_missing AS missing, rejected_quote_currency AS rej_quote, rejected_listing_age AS rej_age,
           unknown_listing_age AS ne_age, rejected_median_quote_volume AS rej_volume,
           unknown_median_quote_volume AS ne_volume, unknown_median_spread AS ne_spread,
           rejected_asset_class AS rej_class, rejected_min_notional_feasible AS rej_min_notional,
           rejected_lot_size_feasible AS rej_lot_size
    FROM fx_monthly""",
)
def monthly_report(spark, sf_dir):
    return report.monthly_report(fx.market(spark, sf_dir).monthly())


@query(
    "snk_7_venue_summary",
    """
    SELECT w.venue, strftime(observed_from, '%Y-%m-%dT%H:%M:%S') AS observed_from,
           strftime(observed_to, '%Y-%m-%dT%H:%M:%S') AS observed_to, series, m.candidates,
           p.provenance, r.peaks
    FROM fx_window w
    JOIN (SELECT venue, count(*) AS candidates FROM fx_meta GROUP BY ALL) m USING (venue)
    JOIN (SELECT venue, string_agg(provenance || '=' || n, ',' ORDER BY provenance) AS provenance
          FROM (SELECT venue, provenance, count(*) AS n FROM fx_calendar GROUP BY ALL) GROUP BY ALL) p USING (venue)
    JOIN (SELECT venue, string_agg(quote_policy || '=' || n, ',' ORDER BY quote_policy) AS peaks
          FROM (SELECT venue, quote_policy, max(research_size) AS n FROM fx_monthly GROUP BY ALL) GROUP BY ALL) r
      USING (venue)""",
)
def venue_summary(spark, sf_dir):
    return report.venue_summary(fx.market(spark, sf_dir)).select(
        "venue",
        stamp("observed_from"),
        stamp("observed_to"),
        "series",
        "candidates",
        F.array_join("provenance", ",").alias("provenance"),
        F.array_join("peaks", ",").alias("peaks"),
    )


@query(
    "win_5_peak_month",
    """
    SELECT venue, quote_policy, policy, first(month ORDER BY size DESC, month) AS peak_month, max(size) AS peak
    FROM (SELECT venue, quote_policy, month, 'liquidity' AS policy, liquidity_size AS size FROM fx_monthly
          UNION ALL SELECT venue, quote_policy, month, 'research', research_size FROM fx_monthly
          UNION ALL SELECT venue, quote_policy, month, 'research+executable', executable_size FROM fx_monthly)
    GROUP BY ALL""",
)
def peak_month(spark, sf_dir):
    """First month of the largest size: ties go to the earlier month."""
    sizes = F.array(
        *[
            F.struct(F.lit(name).alias("policy"), F.col(column).alias("size"))
            for name, column in (
                ("liquidity", "liquidity_size"),
                ("research", "research_size"),
                ("research+executable", "executable_size"),
            )
        ]
    )
    long = fx.market(spark, sf_dir).monthly().select(
        "venue", "quote_policy", "month", "as_of", F.inline(sizes)
    )
    return long.groupBy("venue", "quote_policy", "policy").agg(
        F.max_by("month", F.struct("size", -F.unix_seconds("as_of"))).alias("peak_month"),
        F.max("size").alias("peak"),
    )


@query(
    "win_6_total_ordering",
    """
    SELECT venue, quote_policy, strftime(as_of, '%Y-%m') AS month, symbol FROM fx_verdicts
    WHERE in_research ORDER BY venue, quote_policy, as_of, symbol""",
)
def total_ordering(spark, sf_dir):
    """Ordered at the sink only; the global sort range-partitions, so it scales."""
    verdicts = policy.with_memberships(fx.market(spark, sf_dir).verdicts())
    return (
        verdicts.where("in_research")
        .select("venue", "quote_policy", month(), "symbol")
        .orderBy("venue", "quote_policy", "month", "symbol")
    )


#: First of some months, so that the monthly table answers the same question.
ASKED = ("1996-03-01 00:00:00", "1998-06-01 00:00:00", "2000-01-01 00:00:00")
_ASKED = ", ".join(f"TIMESTAMP '{moment}'" for moment in ASKED)


@query(
    "point_1_universe_at",
    f"""
    SELECT venue, quote_policy, strftime(as_of, '%Y-%m') AS month, symbol FROM fx_verdicts
    WHERE quote_policy IN ('EUR', 'EUR+USD+USDT') AND in_research AND as_of IN ({_ASKED})""",
)
def universe_lookup(spark, sf_dir):
    """Members at three explicit instants under the narrowest and the widest quote policy."""
    market = fx.market(spark, sf_dir, with_bars=True)
    found = [
        universe.universe_at(market, quotes, "research", list(ASKED)).withColumn("quote_policy", F.lit(quotes))
        for quotes in ("EUR", "EUR+USD+USDT")
    ]
    return found[0].unionByName(found[1]).select("venue", "quote_policy", month(), "symbol")


@query(
    "point_2_instruments_at",
    f"""
    SELECT c.venue, strftime(t.as_of, '%Y-%m') AS month, c.symbol
    FROM fx_candidates c, (SELECT unnest([{_ASKED}]) AS as_of) t
    WHERE c.listed_at <= t.as_of AND (c.delisted_at IS NULL OR t.as_of < c.delisted_at)""",
)
def instruments_lookup(spark, sf_dir):
    """Instruments listed at three explicit instants, from the rebuilt calendar."""
    market = fx.market(spark, sf_dir)
    found = universe.instruments_at(market.metadata, market.calendar, ["alpha", "beta"], list(ASKED))
    return found.select("venue", month(), "symbol")
