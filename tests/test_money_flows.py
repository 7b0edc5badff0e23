"""Costs, entitlements, journals, cross-sections and streams."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import costs, coverage, cross_section, decisions, entitlements, journal
from tidemark.session import lookup, sized_for
from tidemark.sources import bars as bar_source
from tidemark.streaming import live_bars


def test_cost_components_add_up_and_none_may_be_missing(spark):
    trade = spark.createDataFrame([(Decimal("100.00"),)], "gross decimal(18,2)")
    full = {"fee_bps": "8", "spread_bps": "4.5", "slippage_bps": "2", "funding_bps": "0"}
    model = lambda: {name: F.lit(value) for name, value in full.items()}
    assert costs.estimate(trade, model).first()["total_bps"] == Decimal("14.5")
    with pytest.raises(ValueError):
        costs.estimate(trade, lambda: {"fee_bps": F.lit("8")})


def test_equity_reconciles_exactly_for_random_trades(spark):
    rng = random.Random(3)
    rows = [
        (
            "v",
            rng.choice("AB"),
            dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(40)),
            Decimal(rng.randrange(-10**9, 10**9)).scaleb(-2),
            Decimal(rng.randrange(0, 10**9)).scaleb(-8),
        )
        for _ in range(2000)
    ]
    frame = spark.createDataFrame(
        rows, "venue string, symbol string, day date, gross decimal(18,2), cost decimal(28,8)"
    )
    curve = costs.equity_curve(frame)
    assert curve.where("NOT reconciles").count() == 0
    last = {
        row["symbol"]: row["net_equity"]
        for row in curve.groupBy("symbol").agg(F.max_by("net_equity", "day").alias("net_equity")).collect()
    }
    for symbol in "AB":
        assert last[symbol] == sum(r[3] - r[4] for r in rows if r[1] == symbol)


def test_two_models_share_gross_and_differ_in_net(spark):
    trades = spark.createDataFrame(
        [("A", "maker", Decimal("1000.00")), ("A", "taker", Decimal("500.00"))],
        "symbol string, role string, gross decimal(18,2)",
    )
    fees = spark.createDataFrame(
        [("x", "maker", Decimal(10)), ("x", "taker", Decimal(20)), ("y", "maker", Decimal(0)), ("y", "taker", Decimal(40))],
        "model string, role string, total_bps decimal(10,2)",
    )
    row = costs.by_venue_model(trades, fees, ["x", "y"]).first()
    assert (row["gross"], row["net_x"], row["net_y"]) == (Decimal(1500), Decimal(1498), Decimal(1498))
    fees = fees.withColumn("total_bps", F.when(F.col("model") == "y", 50).otherwise(F.col("total_bps")))
    row = costs.by_venue_model(trades, fees, ["x", "y"]).first()
    assert row["gross"] == Decimal(1500) and row["net_x"] != row["net_y"]


def test_denials_name_the_first_layer_and_all_layers_are_needed(spark):
    layer = lambda rows, schema: spark.createDataFrame(rows, schema)
    venue = layer([("v", "a"), ("v", "b"), ("v", "c")], "venue string, capability string")
    account = layer([("t", "v", "a"), ("t", "v", "b")], "tier string, venue string, capability string")
    legal = layer([("PT", "a"), ("PT", "d")], "jurisdiction string, capability string")
    asked = spark.createDataFrame(
        [(c, "v", "t", "PT") for c in "abcd"], "capability string, venue string, tier string, jurisdiction string"
    )
    found = {
        row["capability"]: row["denied_by"]
        for row in entitlements.label_denials(asked, venue, account, legal).collect()
    }
    assert found == {"a": None, "b": "jurisdiction", "c": "account", "d": "venue"}
    accounts = spark.createDataFrame([(1, "v", "t", "PT")], "account int, venue string, tier string, jurisdiction string")
    assert [r["capability"] for r in entitlements.effective(accounts, venue, account, legal).collect()] == ["a"]
    spelled = spark.createDataFrame([(" Order_Book ",)], "c string")
    assert spelled.select(entitlements.normalise(F.col("c"))).first()[0] == "order_book"


def test_final_outcomes_and_probe_keep_empty_and_failed_apart(spark):
    attempt = lambda symbol, n, outcome: ("v", "/u", f"symbol={symbol}", n, outcome, outcome)
    rows = [
        *[attempt("RETRY", n, "ok" if n == 3 else "retryable") for n in (1, 2, 3)],
        attempt("NO", 1, "rejected"),
        *[attempt("DOWN", n, "transport_error") for n in range(1, 6)],
        attempt("BUSY", 1, "retryable"),
        attempt("VOID", 1, "ok"),
    ]
    frame = spark.createDataFrame(
        rows, "venue string, url string, params string, attempt int, outcome string, detail string"
    )
    finals = journal.final_outcomes(frame).withColumn("symbol", F.substring("params", 8, 20))
    assert {r["symbol"]: r["final_outcome"] for r in finals.collect()} == {
        "RETRY": "ok", "NO": "rejected", "DOWN": "unavailable", "BUSY": "pending", "VOID": "ok"
    }
    assert {r["symbol"] for r in journal.fetch_failures(finals).collect()} == {"NO", "DOWN"}
    probe = spark.createDataFrame([("v", s) for s in ("RETRY", "NO", "VOID", "NEVER")], "venue string, symbol string")
    stats = spark.createDataFrame(
        [("v", "RETRY", 5, dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 5))],
        "venue string, symbol string, bars bigint, first_open timestamp, last_open timestamp",
    )
    outcome = {r["symbol"]: (r["outcome"], r["bar_count"]) for r in journal.delisted_probe(probe, finals, stats).collect()}
    assert outcome == {
        "RETRY": ("found", 5), "NO": ("rejected", None), "VOID": ("empty", 0), "NEVER": ("not_requested", None)
    }


def test_ranks_and_scores_follow_the_membership(spark):
    rows = [("v", "q", dt.datetime(2024, 1, 1), s, x) for s, x in zip("ABC", (1.0, 2.0, 6.0))]
    frame = spark.createDataFrame(rows, "venue string, quote_policy string, as_of timestamp, symbol string, x double")
    score = lambda f: {r["symbol"]: (r["rank"], r["z_score"]) for r in cross_section.rank_and_score(f, "x").collect()}
    whole, fewer = score(frame), score(frame.where("symbol <> 'C'"))
    assert whole["C"][0] == 1 and whole["A"][0] == 3
    assert whole["B"] != fewer["B"]


def test_sources_that_disagree_are_listed_in_both_directions(spark):
    left = spark.createDataFrame([("v", "A"), ("v", "B"), ("v", "B")], "venue string, symbol string")
    right = spark.createDataFrame([("v", "B"), ("v", "C")], "venue string, symbol string")
    found = {tuple(r) for r in coverage.disagreement(left, right).collect()}
    assert found == {("v", "A", "archive_only"), ("v", "C", "current_only")}


def test_decision_records_keep_both_verdicts(spark):
    frame = spark.createDataFrame([], decisions.DECISION_SCHEMA)
    assert len(frame.columns) == 19
    assert decisions.contingency(frame).columns == ["llm_decision", "risk_verdict", "decisions"]


def _prints(spark, rows):
    frame = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, price int, id bigint")
    return frame.select(
        F.lit("v").alias("venue"),
        "symbol",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("price").cast("decimal(18,2)").alias("price"),
        F.lit(1).cast("decimal(18,2)").alias("qty"),
        F.col("price").cast("decimal(18,2)").alias("quote_qty"),
        "id",
    )


def test_bars_from_prints_order_ties_and_roll_up(spark):
    """One symbol holds most prints; the roll-up agrees with bars built directly."""
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    rows = [
        (rng.choice(["HOT"] * 9 + ["COLD"]), start + dt.timedelta(seconds=rng.randrange(0, 90_000)), rng.randrange(1, 99), n)
        for n in range(4000)
    ]
    prints = _prints(spark, rows)
    order = ["ts", "id"]
    fine = bar_source.from_prints(prints, "1m", order)
    columns = ["symbol", "timeframe", "open_time", "open", "high", "low", "close", "volume", "quote_volume"]
    for timeframe in ("5m", "1h", "1d"):
        direct = bar_source.from_prints(prints, timeframe, order).select(*columns)
        rolled = bar_source.roll_up(fine, [timeframe]).select(*columns)
        assert sorted(map(str, direct.collect())) == sorted(map(str, rolled.collect()))
    hour = [r for r in rows if r[0] == "HOT" and r[1] < start + dt.timedelta(hours=1)]
    first = bar_source.from_prints(prints, "1h", order).where("symbol = 'HOT'").orderBy("open_time").first()
    assert first["open"] == min(hour, key=lambda r: (r[1], r[3]))[2]
    assert first["close"] == max(hour, key=lambda r: (r[1], r[3]))[2]
    assert first["volume"] == len(hour)


def test_one_order_column_aggregates_in_hash_tables(spark):
    prints = _prints(spark, [("A", dt.datetime(2024, 1, 1), 1, 1)])
    plan = bar_source.from_prints(prints, "1h", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_streamed_bars_appear_only_once_closed(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    landing, out, checkpoint = (str(tmp_path / name) for name in ("landing", "out", "checkpoint"))

    def run(rows):
        _prints(spark, rows).write.mode("append").parquet(landing)
        schema = spark.read.parquet(landing).schema
        stream = spark.readStream.schema(schema).parquet(landing)
        bars = live_bars.closed_bars(stream, "1h", "10 minutes", ["ts", "id"])
        live_bars.append_available(bars, out, checkpoint)
        return {
            r["open_time"].hour: r["volume"] for r in spark.read.parquet(out).collect()
        }

    at = lambda minutes: start + dt.timedelta(minutes=minutes)
    assert run([("A", at(5), 1, 1), ("A", at(50), 2, 2), ("A", at(65), 3, 3)]) == {}
    # 01:11 moves the watermark past 01:00: the first hour closes, the second stays open.
    assert run([("A", at(58), 4, 4), ("A", at(71), 5, 5)]) == {0: 3}
    # A print for the closed hour is too late and changes nothing.
    assert run([("A", at(10), 9, 6), ("A", at(135), 6, 7)]) == {0: 3, 1: 2}


def test_lookup_broadcasts_inside_the_limit_and_shuffles_beyond(spark, monkeypatch):
    facts = spark.range(1000).select((F.col("id") % 3).alias("k"))
    names = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, name string")
    joined = lookup(facts, names, ["k"])
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr("tidemark.session.BROADCAST_ROW_LIMIT", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        beyond = lookup(facts, names, ["k"])
        assert "BroadcastHashJoin" not in beyond._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, beyond.collect())) == sorted(map(str, joined.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shuffle_settings_follow_the_input():
    small_job, large_job = sized_for(10**9), sized_for(100 * 10**12)
    assert small_job["spark.sql.shuffle.partitions"] == "200"
    assert 100_000 < int(large_job["spark.sql.shuffle.partitions"]) <= 200_000


def test_small_costs_are_not_rounded_away(spark):
    kinds = "notional decimal(24,8), bps decimal(20,10)"
    rows = [(Decimal("0.00123400"), Decimal(10)), (Decimal(1_000_000), Decimal("0.00004")), (Decimal("-12.5"), Decimal("26"))]
    frame = spark.createDataFrame(rows, kinds).select(costs.cost_amount(F.col("notional"), F.col("bps")).alias("c"))
    assert [r["c"] for r in frame.collect()] == [Decimal("0.00000123"), Decimal("0.004"), Decimal("-0.0325")]


def test_lots_beyond_eight_decimals_and_far_above_one(spark):
    from tidemark.operators import rules

    rows = [(Decimal(10**9), Decimal("4E-9")), (Decimal(10**11), Decimal(10)), (Decimal("1E-10"), Decimal(10**9)), (Decimal(0), Decimal(5))]
    frame = spark.createDataFrame(rows, "lot_size decimal(28,12), close_as_of decimal(20,10)")
    verdicts = frame.select(rules.lot_size_feasible(Decimal("1.875")).verdict().alias("v")).collect()
    assert [r["v"] for r in verdicts] == ["reject", "reject", "admit", "admit"]


def test_failure_details_stay_whole_and_runs_stay_apart(spark):
    long = "x" * 500
    kinds = "venue string, url string, params string, run string, attempt int, outcome string, detail string"
    rows = [("v", "/u", "p", "r1", 1, "ok", "fine"), ("v", "/u", "p", "r2", 1, "retryable", "busy"), ("v", "/u", "p", "r2", 2, "rejected", long), ("v", "/u", "p", "r2", 3, "retryable", "busy")]
    finals = journal.final_outcomes(spark.createDataFrame(rows, kinds))
    found = {r["run"]: (r["final_outcome"], r["detail"]) for r in finals.collect()}
    assert found == {"r1": ("ok", "fine"), "r2": ("rejected", long)}
    failures = journal.fetch_failures(finals.withColumn("symbol", F.lit("S"))).collect()
    assert [r["reason"] for r in failures] == [f"rejected: {long}"]
