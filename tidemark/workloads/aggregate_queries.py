"""AGG, SET and UDX: statistics, journals, entitlements and costs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.operators import costs, coverage, depth, entitlements, history, journal, listing, policy
from tidemark.operators import decisions as audit
from tidemark.parameters import profile_table
from tidemark.session import dimension, lookup, small, staging_path
from tidemark.sinks import records
from tidemark.sources import envelopes
from tidemark.sources import metadata as metadata_source
from tidemark.workloads import fixtures as fx
from tidemark.workloads import payloads
from tidemark.workloads.edge import exact, month, stamp
from tidemark.workloads.registry import query

_ISO = "'%Y-%m-%dT%H:%M:%S'"


@query(
    "agg_1_median_quote_volume",
    """
    SELECT venue, symbol, strftime(as_of, '%Y-%m') AS month,
           median_quote_volume::DECIMAL(34,4)::VARCHAR AS median_quote_volume FROM fx_wstats""",
)
def median_quote_volume(spark, sf_dir):
    """Exact medians over the trailing thirty days, at the venue's refreshes."""
    market = fx.market(spark, sf_dir)
    facts = market.facts.where("observations > 0")
    return facts.join(market.refreshes, ["venue", "as_of"]).select(
        "venue", "symbol", month(), exact("median_quote_volume", 4)
    )


@query(
    "agg_2_observation_count",
    """
    SELECT b.venue, b.symbol, strftime(r.as_of, '%Y-%m') AS month, count(*) AS observations,
           count(*) FILTER (b.quote_volume % 100 <> 0) AS with_turnover
    FROM fx_bars b JOIN fx_refresh r ON b.venue = r.venue
     AND b.open_time >= r.as_of - INTERVAL 30 DAY AND b.open_time <= r.as_of - INTERVAL 1 DAY
    GROUP BY b.venue, b.symbol, r.as_of""",
)
def observation_count(spark, sf_dir):
    """Bars without a turnover still count as observations."""
    market = fx.market(spark, sf_dir, with_bars=True)
    gaps = market.bars.withColumn(
        "quote_volume", F.when(F.col("quote_volume") % 100 != 0, F.col("quote_volume"))
    )
    windowed = history.window_at(gaps, market.refreshes, 30)
    return (
        windowed.groupBy("venue", "symbol", "as_of")
        .agg(F.count("*").alias("observations"), F.count("quote_volume").alias("with_turnover"))
        .select("venue", "symbol", month(), "observations", "with_turnover")
    )


@query(
    "agg_3_first_and_last",
    f"""
    SELECT venue, symbol, strftime(first_open, {_ISO}) AS first_open, strftime(last_open, {_ISO}) AS last_open, bars
    FROM fx_extent""",
)
def first_and_last(spark, sf_dir):
    return history.extents(fx.daily_bars(spark, sf_dir)).select(
        "venue", "symbol", stamp("first_open"), stamp("last_open"), "bars"
    )


@query(
    "agg_4_observed_window",
    f"""
    SELECT venue, strftime(observed_from, {_ISO}) AS observed_from, strftime(observed_to, {_ISO}) AS observed_to,
           series FROM fx_window""",
)
def observed_window(spark, sf_dir):
    windows = history.observed_windows(history.extents(fx.daily_bars(spark, sf_dir)))
    return windows.select("venue", stamp("observed_from"), stamp("observed_to"), "series")


@query(
    "agg_5_span_days",
    """
    SELECT venue, symbol, (epoch(last_open)::BIGINT - epoch(first_open)::BIGINT) // 86400 AS span_days
    FROM fx_extent""",
)
def span_days(spark, sf_dir):
    extents = history.extents(fx.daily_bars(spark, sf_dir))
    span = history.span_days(F.col("first_open"), F.col("last_open"))
    return extents.select("venue", "symbol", span.alias("span_days"))


@query(
    "agg_6_provenance_counts",
    """
    SELECT v.venue, g.provenance, count(c.symbol) AS entries
    FROM (VALUES ('alpha'), ('beta')) v(venue)
    CROSS JOIN (VALUES ('venue_api'), ('venue_archive'), ('venue_announcement'), ('reconstructed'),
                       ('secondary'), ('unverified')) g(provenance)
    LEFT JOIN fx_calendar c ON c.venue = v.venue AND c.provenance = g.provenance GROUP BY ALL""",
)
def provenance_counts(spark, sf_dir):
    market = fx.market(spark, sf_dir)
    return listing.provenance_counts(market.calendar, profile_table(spark, market.profiles))


@query(
    "agg_7_journal_summary",
    """
    SELECT venue, url, count(*) AS attempts, count(*) FILTER (outcome = 'ok') AS ok,
           sum(payload_bytes)::BIGINT AS bytes FROM fx_journal GROUP BY ALL""",
)
def journal_summary(spark, sf_dir):
    return journal.endpoint_summary(fx.journal(spark, sf_dir))


@query(
    "agg_8_final_outcome",
    "SELECT venue, url, params, attempts::BIGINT AS attempts, final_outcome FROM fx_finals",
)
def final_outcome(spark, sf_dir):
    return journal.final_outcomes(fx.journal(spark, sf_dir)).select(
        "venue", "url", "params", F.col("attempts").cast("bigint").alias("attempts"), "final_outcome"
    )


_RUNS_SQL = """
    SELECT venue, url, params, run, attempt, CASE WHEN status IS NULL THEN 'transport_error' WHEN status BETWEEN 200 AND 299 THEN 'ok'
             WHEN status IN (429, 500, 502, 503) THEN 'retryable' ELSE 'rejected' END AS outcome
    FROM (SELECT venue, url, params, attempt, status, 'first' AS run FROM fx_journal
          UNION ALL
          SELECT venue, url, params, attempt, CASE WHEN attempt % 2 = 0 THEN 503 WHEN request % 4 = 0 THEN 404 WHEN request % 4 = 1 THEN 200
                   WHEN request % 4 = 2 THEN NULL ELSE 429 END, 'second' FROM fx_journal)"""


@query(
    "agg_8_outcome_per_run",
    f"""
    SELECT venue, url, params, run, max(attempt)::BIGINT AS attempts,
           CASE WHEN bool_or(outcome = 'ok') THEN 'ok' WHEN bool_or(outcome = 'rejected') THEN 'rejected'
                WHEN max(attempt) >= 5 THEN 'unavailable' ELSE 'pending' END AS final_outcome
    FROM ({_RUNS_SQL}) GROUP BY ALL""",
)
def outcome_per_run(spark, sf_dir):
    """The same requests made by two runs, written as a journal and read back: two answers each."""
    first = fx.journal(spark, sf_dir).withColumn("run", F.lit("first"))
    request = F.regexp_extract("params", "start=([0-9]+)", 1).cast("bigint") % 4
    status = (
        F.when(F.col("attempt") % 2 == 0, 503).when(request == 0, 404).when(request == 1, 200)
        .when(request == 2, F.lit(None).cast("int")).otherwise(429)
    )
    second = first.withColumns({"run": F.lit("second"), "status": status}).withColumn("outcome", envelopes.response_outcome(F.col("status")))
    path = staging_path(spark, "runs")
    records.write_journal(first.unionByName(second), path)
    lines = records.read_journal(spark, path)
    # Parameters come back as an object; as text they identify the request again.
    text = F.concat_ws("&", F.transform(F.array_sort(F.map_keys("params")), lambda k: F.concat(k, F.lit("="), F.col("params")[k])))
    return journal.final_outcomes(lines.withColumn("params", text)).select(
        "venue", "url", "params", "run", F.col("attempts").cast("bigint").alias("attempts"), "final_outcome"
    )


def _finals_with_symbol(spark, sf_dir: str):
    return journal.final_outcomes(fx.journal(spark, sf_dir)).withColumn(
        "symbol", F.regexp_extract("params", "symbol=([^&]+)", 1)
    )


@query(
    "agg_9_delisted_probe",
    f"""
    SELECT p.venue, p.symbol,
           CASE WHEN f.final_outcome IS NULL THEN 'not_requested' WHEN f.final_outcome <> 'ok' THEN f.final_outcome
                WHEN e.bars > 0 THEN 'found' ELSE 'empty' END AS outcome,
           CASE WHEN f.final_outcome = 'ok' THEN coalesce(e.bars, 0)::VARCHAR END AS bar_count,
           CASE WHEN f.final_outcome = 'ok' THEN strftime(e.first_open, {_ISO}) END AS first_bar,
           CASE WHEN f.final_outcome = 'ok' THEN strftime(e.last_open, {_ISO}) END AS last_bar
    FROM (SELECT v.venue, 'Brand#' || n AS symbol FROM range(1, 41) t(n), (VALUES ('alpha'), ('beta')) v(venue)) p
    LEFT JOIN (SELECT venue, symbol, arg_max(final_outcome, request) AS final_outcome FROM fx_finals GROUP BY ALL) f
      USING (venue, symbol)
    LEFT JOIN fx_extent e USING (venue, symbol)""",
)
def delisted_probe(spark, sf_dir):
    """Forty named symbols per venue, some never requested and some without bars."""
    schema = pa.schema([("venue", pa.string()), ("symbol", pa.string())])
    probe = dimension(
        spark,
        [
            {"venue": venue, "symbol": f"Brand#{n}"}
            for venue in ("alpha", "beta")
            for n in range(1, 41)
        ],
        schema,
    )
    request = F.regexp_extract("params", "start=([0-9]+)", 1).cast("bigint")
    newest = (
        _finals_with_symbol(spark, sf_dir)
        .groupBy("venue", "symbol")
        .agg(
            F.max_by("final_outcome", request).alias("final_outcome"),
            F.max_by("detail", request).alias("detail"),
        )
    )
    stats = history.extents(fx.daily_bars(spark, sf_dir))
    return journal.delisted_probe(probe, newest, stats).select(
        "venue",
        "symbol",
        "outcome",
        F.col("bar_count").cast("string").alias("bar_count"),
        stamp("first_bar"),
        stamp("last_bar"),
    )


@query(
    "agg_10_fetch_failures",
    """
    SELECT venue, symbol, params, final_outcome || ': ' || detail AS reason FROM fx_finals
    WHERE final_outcome IN ('rejected', 'unavailable')""",
)
def fetch_failures(spark, sf_dir):
    finals = _finals_with_symbol(spark, sf_dir)
    keyed = finals.withColumn("key", F.struct("symbol", "params"))
    return journal.fetch_failures(keyed, "key").select("venue", "key.symbol", "key.params", "reason")


# -- costs --------------------------------------------------------------------

FEES = [
    {"model": "alpha", "role": "maker", "fee": "8.00"},
    {"model": "alpha", "role": "taker", "fee": "10.00"},
    {"model": "beta", "role": "maker", "fee": "16.00"},
    {"model": "beta", "role": "taker", "fee": "26.00"},
]
_FEES_SQL = """(VALUES ('alpha', 'maker', 8.00), ('alpha', 'taker', 10.00), ('beta', 'maker', 16.00),
    ('beta', 'taker', 26.00)) f(model, role, fee)"""
_TRADES_SQL = """SELECT *, quote_qty AS gross,
    CASE WHEN l_linenumber % 2 = 0 THEN 'maker' ELSE 'taker' END AS role FROM fx_every_print"""


def fees(spark):
    schema = pa.schema([("model", pa.string()), ("role", pa.string()), ("fee", pa.string())])
    return dimension(spark, FEES, schema).withColumn("fee", F.col("fee").cast("decimal(10,2)"))


def trades(spark, sf_dir: str):
    """Every print is a trade of ours; odd line numbers take liquidity."""
    return fx.all_prints(spark, sf_dir).select(
        "venue",
        "symbol",
        F.to_date("ts").alias("day"),
        F.col("quote_qty").alias("gross"),
        "qty",
        F.when(F.col("l_linenumber") % 2 == 0, "maker").otherwise("taker").alias("role"),
    )


def _itemised(spark, sf_dir: str):
    """Fees by venue and role, half the measured spread, slippage by size."""
    schedule = fees(spark).withColumnRenamed("model", "venue")
    spreads = fx.spreads(spark, sf_dir).select("venue", "symbol", "spread_bps")
    priced = lookup(
        trades(spark, sf_dir).join(small(schedule, len(FEES)), ["venue", "role"]),
        spreads.withColumnRenamed("spread_bps", "quoted"),
        ["venue", "symbol"],
    )
    half = F.lit("0.5").cast("decimal(2,1)")
    model = lambda: {
        "fee_bps": F.col("fee"),
        # Without a measurement the assumption is deliberately wide.
        "spread_bps": F.coalesce(F.col("quoted").cast("decimal(10,2)"), F.lit("50").cast("decimal(10,2)")) * half,
        "slippage_bps": F.when(F.col("qty") > 25, F.lit("2.5")).otherwise("1").cast("decimal(10,2)"),
        "funding_bps": F.lit("0").cast("decimal(10,2)"),
    }
    return costs.estimate(priced, model)


_ITEMISED_SQL = f"""
    SELECT t.*, f.fee AS fee_bps, coalesce(m.spread_bps, 50) * 0.5 AS spread_bps,
           CASE WHEN qty > 25 THEN 2.5 ELSE 1.0 END AS slippage_bps
    FROM ({_TRADES_SQL}) t JOIN {_FEES_SQL} ON f.model = t.venue AND f.role = t.role
    JOIN fx_meta m ON m.symbol = t.symbol"""


@query(
    "agg_11_total_cost",
    f"""
    SELECT venue, symbol, role, count(*) AS trades,
           sum(fee_bps + spread_bps + slippage_bps)::DECIMAL(34,2)::VARCHAR AS sum_of_totals,
           (sum(fee_bps) + sum(spread_bps) + sum(slippage_bps))::DECIMAL(34,2)::VARCHAR AS total_of_sums
    FROM ({_ITEMISED_SQL}) GROUP BY ALL""",
)
def total_cost(spark, sf_dir):
    """All-in basis points: adding up per trade or per component is the same."""
    parts = [F.sum(name) for name in costs.COMPONENTS]
    return _itemised(spark, sf_dir).groupBy("venue", "symbol", "role").agg(
        F.count("*").alias("trades"),
        exact(F.sum("total_bps"), 2, "sum_of_totals"),
        exact(parts[0] + parts[1] + parts[2] + parts[3], 2, "total_of_sums"),
    )


@query(
    "agg_12_equity_identity",
    f"""
    SELECT venue, symbol, strftime(day, '%Y-%m-%d') AS day,
           sum(gross) OVER w ::DECIMAL(34,8)::VARCHAR AS gross_equity,
           sum(cost) OVER w ::DECIMAL(34,8)::VARCHAR AS cost_equity,
           (sum(gross) OVER w - sum(cost) OVER w)::DECIMAL(34,8)::VARCHAR AS net_equity, TRUE AS reconciles
    FROM (SELECT venue, symbol, ts::DATE AS day, sum(gross)::DECIMAL(34,8) AS gross,
                 sum((gross * (fee_bps + spread_bps + slippage_bps)::DECIMAL(12,4) * 0.0001)::DECIMAL(28,8))::DECIMAL(34,8) AS cost
          FROM ({_ITEMISED_SQL}) GROUP BY ALL)
    WINDOW w AS (PARTITION BY venue, symbol ORDER BY day ROWS UNBOUNDED PRECEDING)""",
)
def equity_identity(spark, sf_dir):
    charged = _itemised(spark, sf_dir).withColumn(
        "cost", costs.cost_amount(F.col("gross"), F.col("total_bps"))
    )
    return costs.equity_curve(charged).select(
        "venue",
        "symbol",
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        *[exact(f"{name}_equity", 8) for name in ("gross", "cost", "net")],
        "reconciles",
    )


@query(
    "agg_13_verdict_contingency",
    """
    SELECT CASE event_type WHEN 'click' THEN 'long' WHEN 'view' THEN 'flat' WHEN 'purchase' THEN 'short'
             WHEN 'error' THEN NULL ELSE 'no_action' END AS llm_decision,
           CASE WHEN value::DECIMAL(18,2) < 20 THEN 'approve' WHEN value::DECIMAL(18,2) < 60 THEN 'reduce'
             ELSE 'reject' END AS risk_verdict, count(*) AS decisions
    FROM events GROUP BY ALL""",
)
def verdict_contingency(spark, sf_dir):
    """Where the model and the risk layer agree and where they do not."""
    kind = F.col("event_type")
    amount = F.col("value").cast("decimal(18,2)")
    decisions = fx.table(spark, sf_dir, "events").select(
        F.when(kind == "click", "long")
        .when(kind == "view", "flat")
        .when(kind == "purchase", "short")
        .when(kind != "error", "no_action")
        .alias("llm_decision"),
        F.when(amount < 20, "approve").when(amount < 60, "reduce").otherwise("reject").alias(
            "risk_verdict"
        ),
    )
    return audit.contingency(decisions)


@query(
    "udx_1_cost_model",
    f"""
    SELECT venue, symbol, role, count(*) AS trades, sum(fee_bps)::DECIMAL(34,2)::VARCHAR AS fee_bps,
           sum(spread_bps)::DECIMAL(34,2)::VARCHAR AS spread_bps,
           sum(slippage_bps)::DECIMAL(34,2)::VARCHAR AS slippage_bps, '0.00' AS funding_bps
    FROM ({_ITEMISED_SQL}) GROUP BY ALL""",
)
def cost_model(spark, sf_dir):
    return _itemised(spark, sf_dir).groupBy("venue", "symbol", "role").agg(
        F.count("*").alias("trades"),
        *[exact(F.sum(name), 2, name) for name in costs.COMPONENTS],
    )


_LEVELS_SQL = """
    SELECT *, coalesce(sum(quantity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead, first(price) OVER w AS best
    FROM (SELECT symbol, side, CASE side WHEN 'buy' THEN cents ELSE 180000 - cents END AS price, cents AS rank, sum(p_size)::BIGINT AS quantity
          FROM (SELECT p_brand AS symbol, p_size, (p_retailprice::DECIMAL(18,2) * 100)::BIGINT AS cents, unnest(['buy', 'sell']) AS side FROM part)
          WHERE cents < 180000 GROUP BY ALL)
    WINDOW w AS (PARTITION BY symbol, side ORDER BY rank)"""
_FILLED_SQL = f"""
    SELECT *, (2 * spent * 100000000 + filled) // (2 * filled) AS average, best::HUGEINT * 100000000 AS b
    FROM (SELECT id, venue, symbol, side, wanted, sum(take)::HUGEINT AS filled, sum(price * take)::HUGEINT AS spent,
                 count(*) FILTER (take > 0) AS levels, any_value(best) AS best
          FROM (SELECT t.*, price, best, greatest(0, least(quantity, wanted - ahead)) AS take
                FROM (SELECT row_number() OVER () AS id, venue, symbol, qty::BIGINT * 60 AS wanted,
                             CASE WHEN l_linenumber % 2 = 1 THEN 'buy' ELSE 'sell' END AS side FROM fx_every_print) t
                JOIN ({_LEVELS_SQL}) USING (symbol, side))
          GROUP BY id, venue, symbol, side, wanted)"""


def order_book(spark, sf_dir: str):
    """Parts as levels: each offers its size at its price, and as much is bid below 900."""
    parts = fx.table(spark, sf_dir, "part").select(
        fx.brand_number().alias("n"), F.col("p_brand").alias("symbol"), F.col("p_retailprice").cast("decimal(18,2)").alias("ask"),
        F.col("p_size").alias("quantity"),
    ).where("ask < 1800")
    sides = F.array(
        F.struct(F.lit("ask").alias("side"), F.col("ask").alias("price")),
        F.struct(F.lit("bid").alias("side"), (F.lit("1800").cast("decimal(18,2)") - F.col("ask")).cast("decimal(18,2)").alias("price")),
    )
    return parts.select(fx.venue_of_brand().alias("venue"), "symbol", "quantity", F.inline(sides))


@query(
    "udx_1_depth_slippage",
    f"""
    SELECT venue, symbol, side, filled >= wanted AS complete, count(*) AS trades, sum(levels)::BIGINT AS levels,
           sum(filled)::DECIMAL(34,2)::VARCHAR AS filled, (sum(spent)::DECIMAL(34,0) * 0.01)::DECIMAL(34,4)::VARCHAR AS notional,
           sum(average)::DECIMAL(38,0)::VARCHAR AS average_e10,
           sum((2 * (CASE side WHEN 'buy' THEN average - b ELSE b - average END) * 100000000000000 + b) // (2 * b))::DECIMAL(38,0)::VARCHAR AS slippage_e10
    FROM ({_FILLED_SQL}) GROUP BY ALL""",
)
def depth_slippage(spark, sf_dir):
    """Every print sixty times over against its instrument's book, bought or sold.

    Some orders fit into a few levels, some empty the side; sums are exact to the
    tenth decimal.  Equal orders are filled equally, so a book is walked once for each
    different one.
    """
    odd = F.col("l_linenumber") % 2 == 1
    asked = fx.all_prints(spark, sf_dir).select(
        "venue", "symbol", F.when(odd, depth.BUY).otherwise(depth.SELL).alias("side"), (F.col("qty") * 60).alias("quantity")
    )
    orders = asked.groupBy("venue", "symbol", "side", "quantity").agg(F.count("*").alias("equal"))
    book = depth.books(order_book(spark, sf_dir))
    found = depth.filled(lookup(orders, book, ["venue", "symbol"]))
    # Beside twelve digits of count there is room for the digits that each amount has.
    total = lambda name, kind: F.sum(F.col(name).cast(kind) * F.col("equal").cast("decimal(12,0)"))
    e10 = lambda name: (total(name, "decimal(20,10)").cast("decimal(28,10)") * 10_000_000_000).cast("decimal(38,0)").cast("string").alias(f"{name.split('_')[0]}_e10")
    return found.groupBy("venue", "symbol", "side", "complete").agg(
        F.sum("equal").alias("trades"), F.sum(F.col("levels") * F.col("equal")).alias("levels"),
        exact(total("filled", "decimal(24,2)"), 2, "filled"), exact(total("notional", "decimal(26,4)"), 4, "notional"),
        e10("average"), e10("slippage_bps"),
    )


@query(
    "udx_2_two_venue_models",
    f"""
    SELECT symbol, sum(gross)::DECIMAL(34,2)::VARCHAR AS gross,
           sum(gross - (gross * a.fee::DECIMAL(12,4) * 0.0001)::DECIMAL(28,8))::DECIMAL(34,8)::VARCHAR AS net_alpha,
           sum(gross - (gross * b.fee::DECIMAL(12,4) * 0.0001)::DECIMAL(28,8))::DECIMAL(34,8)::VARCHAR AS net_beta
    FROM ({_TRADES_SQL}) t
    JOIN (SELECT * FROM {_FEES_SQL} WHERE model = 'alpha') a ON a.role = t.role
    JOIN (SELECT * FROM {_FEES_SQL} WHERE model = 'beta') b ON b.role = t.role GROUP BY ALL""",
)
def two_venue_models(spark, sf_dir):
    """Gross is the same under both schedules; net is not."""
    schedule = fees(spark).withColumnRenamed("fee", "total_bps")
    return costs.by_venue_model(trades(spark, sf_dir), schedule, ["alpha", "beta"]).select(
        "symbol", exact("gross", 2), exact("net_alpha", 8), exact("net_beta", 8)
    )


# -- sets ---------------------------------------------------------------------

VENUE_LAYER = {
    "alpha": ["public_market_data", "historical_ohlcv", "order_book", "spot_trading", "margin_trading"],
    "beta": ["public_market_data", "historical_ohlcv", "account_data", "spot_trading"],
}
ACCOUNT_LAYER = {
    "AUTOMOBILE": ["public_market_data", "historical_ohlcv"],
    "BUILDING": ["public_market_data", "historical_ohlcv", "order_book", "spot_trading"],
    "FURNITURE": ["public_market_data", "order_book", "account_data", "margin_trading"],
    "HOUSEHOLD": ["public_market_data", "spot_trading", "margin_trading"],
    "MACHINERY": ["historical_ohlcv", "order_book", "account_data", "spot_trading"],
}
LEGAL_LAYER = {
    0: ["public_market_data", "historical_ohlcv", "order_book", "account_data", "spot_trading"],
    1: ["public_market_data", "historical_ohlcv", "order_book", "spot_trading", "margin_trading"],
    2: ["public_market_data", "spot_trading"],
    3: ["public_market_data", "historical_ohlcv", "order_book", "account_data"],
    4: ["PUBLIC_MARKET_DATA ", "Historical_OHLCV", "spot_trading"],
}
_CAPABILITY_OF_PRIORITY = {
    "1-URGENT": "spot_trading",
    "2-HIGH": "margin_trading",
    "3-MEDIUM": "order_book",
    "4-NOT SPECIFIED": "historical_ohlcv",
    "5-LOW": "account_data",
}


def layers(spark):
    """The three permission tables, spelled as configuration spells them."""

    def rows(layer: dict, key: str, kind):
        listed = [{key: owner, "capability": c} for owner, cs in layer.items() for c in cs]
        table = dimension(spark, listed, pa.schema([(key, kind), ("capability", pa.string())]))
        return table.withColumn("capability", entitlements.normalise(F.col("capability")))

    venues = rows(VENUE_LAYER, "venue", pa.string())
    tiers = rows(ACCOUNT_LAYER, "tier", pa.string()).withColumn(
        "venue", F.explode(F.array(F.lit("alpha"), F.lit("beta")))
    )
    return venues, tiers, rows(LEGAL_LAYER, "jurisdiction", pa.int32())


def _accounts(spark, sf_dir: str):
    regions = fx.table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return fx.table(spark, sf_dir, "customer").join(
        regions, F.col("c_nationkey") == F.col("n_nationkey")
    ).select(
        F.col("c_custkey").alias("account"),
        F.col("c_mktsegment").alias("tier"),
        F.col("n_regionkey").alias("jurisdiction"),
    )


def activity(spark, sf_dir: str):
    """Orders as things accounts tried to do."""
    asked = F.create_map(*[F.lit(x) for pair in _CAPABILITY_OF_PRIORITY.items() for x in pair])
    return fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request"),
        F.col("o_custkey").alias("account"),
        F.when(F.col("o_orderkey") % 2 == 0, "alpha").otherwise("beta").alias("venue"),
        F.try_element_at(asked, F.col("o_orderpriority")).alias("capability"),
    )


def _values(layer: dict) -> str:
    return ", ".join(
        f"({owner!r}, '{capability.strip().lower()}')" for owner, cs in layer.items() for capability in cs
    )


_ACTIVITY_SQL = f"""
    SELECT o_orderkey AS request, o_custkey AS account, c_mktsegment AS tier, n_regionkey AS jurisdiction,
           CASE WHEN o_orderkey % 2 = 0 THEN 'alpha' ELSE 'beta' END AS venue, p.capability
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    JOIN (VALUES {', '.join(str(pair) for pair in _CAPABILITY_OF_PRIORITY.items())}) p(priority, capability)
      ON p.priority = o_orderpriority"""


@query(
    "set_1_entitlements",
    f"""
    SELECT request, account, venue, capability FROM ({_ACTIVITY_SQL}) x
    WHERE (venue, capability) IN (VALUES {_values(VENUE_LAYER)})
      AND (tier, capability) IN (VALUES {_values(ACCOUNT_LAYER)})
      AND (jurisdiction, capability) IN (VALUES {_values(LEGAL_LAYER)})""",
)
def entitled_activity(spark, sf_dir):
    """Activity that venue, account and jurisdiction all allow."""
    venue_layer, account_layer, legal_layer = layers(spark)
    accounts = _accounts(spark, sf_dir).withColumn(
        "venue", F.explode(F.array(F.lit("alpha"), F.lit("beta")))
    )
    allowed = entitlements.effective(accounts, venue_layer, account_layer, legal_layer)
    return activity(spark, sf_dir).join(allowed, ["account", "venue", "capability"], "left_semi")


@query(
    "set_2_denying_layer",
    f"""
    SELECT request, account, venue, capability,
           CASE WHEN (venue, capability) NOT IN (VALUES {_values(VENUE_LAYER)}) THEN 'venue'
                WHEN (tier, capability) NOT IN (VALUES {_values(ACCOUNT_LAYER)}) THEN 'account'
                WHEN (jurisdiction, capability) NOT IN (VALUES {_values(LEGAL_LAYER)}) THEN 'jurisdiction' END AS denied_by
    FROM ({_ACTIVITY_SQL}) x""",
)
def denying_layer(spark, sf_dir):
    known = activity(spark, sf_dir).join(_accounts(spark, sf_dir), "account")
    return entitlements.label_denials(known, *layers(spark)).select(
        "request", "account", "venue", "capability", "denied_by"
    )


@query(
    "set_3_archive_against_metadata",
    """
    SELECT venue, symbol, 'archive_only' AS side FROM fx_listing WHERE key % 11 <> 3 AND size % 5 = 4
    UNION ALL SELECT venue, 'Q' || key, 'archive_only' FROM fx_listing WHERE key % 13 = 0
    UNION ALL SELECT venue, symbol, 'current_only' FROM fx_listing
      WHERE key % 11 = 3 AND size % 5 <> 4 AND quote IN ('EUR', 'USD', 'USDT')
    UNION ALL SELECT venue, symbol, 'archive_only' FROM fx_listing
      WHERE key % 11 <> 3 AND size % 5 <> 4 AND quote = 'BTC'""",
)
def archive_against_metadata(spark, sf_dir):
    """The archive against the metadata in scope: each knows symbols the other lacks."""
    archive = metadata_source.archive_symbols(payloads.archive_pages(spark, sf_dir))
    described = metadata_source.good_metadata(
        metadata_source.parse_symbols(payloads.symbol_descriptions(spark, sf_dir))
    )
    in_scope = described.where(F.col("quote").isin("EUR", "USD", "USDT"))
    return coverage.disagreement(archive, in_scope)


@query(
    "set_4_jurisdiction_visibility",
    """
    SELECT venue, count(*) AS pairs, count(*) FILTER (size % 6 > 1) AS visible FROM fx_listing GROUP BY ALL""",
)
def jurisdiction_visibility(spark, sf_dir):
    """All symbols against the pairs a jurisdiction's own listing shows."""
    visible = metadata_source.parse_pairs(payloads.pair_descriptions(spark, sf_dir))
    return coverage.visibility(fx.listings(spark, sf_dir), visible)


@query(
    "set_5_policy_by_extension",
    """
    SELECT venue, quote_policy, strftime(as_of, '%Y-%m') AS month, symbol FROM fx_verdicts
    WHERE in_liquidity AND v_min_notional_feasible = 'admit' AND v_lot_size_feasible = 'admit'""",
)
def policy_by_extension(spark, sf_dir):
    """The liquidity policy extended by the account's two constraints."""
    wallet = ("min_notional_feasible", "lot_size_feasible")
    extended = policy.extend(fv.POLICY_RULES["liquidity"], wallet)
    verdicts = fx.market(spark, sf_dir).verdicts()
    return verdicts.where(policy.is_member(extended)).select(
        "venue", "quote_policy", month(), "symbol"
    )
