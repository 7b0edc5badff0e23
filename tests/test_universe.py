"""The behaviour the universe must show, on histories small enough to check by eye."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests import small_market as sm
from tidemark import fixed_values as fv
from tidemark.operators import history, policy, rules
from tidemark.parameters import Account
from tidemark.plans.universe import universe_at

# One bar on the decision day itself puts a refresh inside the observed window.
TODAY = [("AAA", sm.DECISION, "100", "1000")]


def judged(market):
    return sm.at_decision(policy.with_memberships(market.verdicts()))


def test_future_bars_do_not_move_the_median(spark):
    poisoned = sm.history("AAA") + [
        ("AAA", sm.DECISION + dt.timedelta(days=n), "100", "10000000") for n in range(30)
    ]
    row = judged(sm.market(spark, poisoned, ["AAA"]))["AAA"]
    assert row["median_quote_volume"] == Decimal(1000)
    assert row["observations"] == 30


def test_poisoned_future_leaves_every_earlier_month_unchanged(spark):
    rows = sm.history("AAA", days=400) + TODAY
    cut = dt.datetime(2024, 2, 1)
    poisoned = [
        row if row[1] + dt.timedelta(days=1) <= cut else (row[0], row[1], "7", "999999999")
        for row in rows
    ]

    def until_cut(data):
        verdicts = policy.with_memberships(sm.market(spark, data, ["AAA"]).verdicts())
        kept = verdicts.where(F.col("as_of") <= F.lit(cut.isoformat()).cast("timestamp"))
        return sorted(map(str, kept.drop("last_refresh", "delisted_at").collect()))

    assert until_cut(rows) == until_cut(poisoned)


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([], fv.NOT_EVALUABLE),
        (sm.history("BBB", days=19), fv.NOT_EVALUABLE),
        (sm.history("BBB", days=20), fv.ADMIT),
        (sm.history("BBB", volume="499.99"), fv.REJECT),
        (sm.history("BBB", volume="500"), fv.ADMIT),
        (sm.history("BBB", volume=None), fv.NOT_EVALUABLE),
    ],
)
def test_volume_rule_keeps_missing_thin_and_low_apart(spark, rows, expected):
    old = [("BBB", dt.datetime(2020, 1, 1), "100", "1000")]
    row = judged(sm.market(spark, old + rows + sm.history("AAA") + TODAY, ["AAA", "BBB"]))["BBB"]
    assert row["v_median_quote_volume"] == expected


def test_observations_without_turnover_count_but_do_not_move_the_median(spark):
    rows = sm.history("AAA", days=200, volume="800")
    gaps = [(s, t, c, None if n % 2 else v) for n, (s, t, c, v) in enumerate(rows)]
    row = judged(sm.market(spark, gaps + TODAY, ["AAA"]))["AAA"]
    assert row["observations"] == 30
    assert row["median_quote_volume"] == Decimal(800)
    assert row["v_median_quote_volume"] == fv.ADMIT


def test_unverified_window_is_not_evaluable_however_old(spark):
    rows = sm.history("OLD", days=900) + sm.history("NEW", days=300) + TODAY
    verdicts = judged(sm.market(spark, rows, ["OLD", "NEW", "AAA"], truncates=True))
    assert verdicts["OLD"]["v_listing_age"] == fv.NOT_EVALUABLE
    assert verdicts["NEW"]["v_listing_age"] == fv.ADMIT


def test_listing_age_boundary_is_inclusive(spark):
    rows = sm.history("D180", days=180) + sm.history("D179", days=179) + TODAY
    verdicts = judged(sm.market(spark, rows, ["D180", "D179", "AAA"]))
    assert verdicts["D180"]["v_listing_age"] == fv.ADMIT
    assert verdicts["D179"]["v_listing_age"] == fv.REJECT


def test_unsizable_name_stays_in_research_and_leaves_executable(spark):
    rows = sm.history("BIG") + sm.history("AAA") + TODAY
    found = sm.market(spark, rows, ["BIG", "AAA"], BIG={"lot_size": "1", "min_notional": "50"})
    row = judged(found)["BIG"]
    assert row["in_research"]
    assert not row["in_research+executable"]
    assert row["v_lot_size_feasible"] == fv.REJECT
    assert row["v_min_notional_feasible"] == fv.REJECT


def test_account_allowances():
    account = Account()
    assert account.target == Decimal("187.5")
    assert account.largest_min_notional == Decimal("46.875")
    assert account.largest_lot_value == Decimal("1.875")
    with pytest.raises(ValueError):
        Account(positions=0)


def test_delisted_name_is_a_member_before_and_not_after(spark):
    gone = sm.history("GONE", days=300, until=dt.datetime(2024, 4, 15))
    found = sm.market(
        spark, gone + sm.history("AAA", days=300) + TODAY, ["GONE", "AAA"], GONE={"status": "BREAK"}
    )
    verdicts = policy.with_memberships(found.verdicts())
    before = sm.at_decision(verdicts, dt.datetime(2024, 4, 1))
    after = sm.at_decision(verdicts, dt.datetime(2024, 5, 1))
    assert before["GONE"]["in_research"]
    assert not after["GONE"]["in_research"]
    assert "GONE" in after, "delisted names stay candidates"


def test_excluding_delisted_names_changes_the_answer(spark):
    gone = sm.history("GONE", days=300, until=dt.datetime(2024, 4, 15))
    rows = gone + sm.history("AAA", days=300) + TODAY
    sizes = lambda market: {
        row["month"]: row["research_size"] for row in market.monthly().collect()
    }
    whole = sizes(sm.market(spark, rows, ["GONE", "AAA"], GONE={"status": "BREAK"}))
    survivors = sizes(sm.market(spark, rows, ["AAA"]))
    assert whole["2024-03"] == 2 and survivors["2024-03"] == 1


def test_input_order_does_not_matter(spark):
    rows = sm.history("AAA", days=250) + sm.history("BBB", days=250) + TODAY
    shuffled = rows[:]
    random.Random(7).shuffle(shuffled)
    table = lambda data: sorted(
        map(str, sm.market(spark, data, ["AAA", "BBB"]).monthly().collect())
    )
    assert table(rows) == table(shuffled)


def test_band_edges(spark):
    sizes = spark.createDataFrame([(n,) for n in (0, 14, 15, 25, 26)], "size int")
    bands = [row[0] for row in sizes.select(policy.band(F.col("size"))).collect()]
    assert bands == ["too-thin", "too-thin", "low-power", "low-power", "ok"]


def test_no_rule_readmits_an_unlisted_name(spark):
    gone = sm.history("GONE", days=300, until=dt.datetime(2024, 4, 15))
    found = sm.market(spark, gone + sm.history("AAA") + TODAY, ["GONE", "AAA"], GONE={"status": "BREAK"})
    always = rules.Rule("always", lambda: F.lit(fv.ADMIT))
    row = sm.at_decision(found.verdicts(always).withColumn("in_x", policy.is_member(["always"])))["GONE"]
    assert row["v_always"] == fv.ADMIT and not row["in_x"]


def test_rejections_count_unlisted_candidates_and_sum_to_all(spark):
    rows = sm.history("AAA", days=400) + sm.history("LATE", days=10) + TODAY
    for row in sm.market(spark, rows, ["AAA", "LATE"]).monthly().collect():
        assert row["candidates"] == 2
    verdicts = sm.market(spark, rows, ["AAA", "LATE"]).verdicts()
    for name in fv.RULE_NAMES:
        outcomes = {r[0] for r in verdicts.select(f"v_{name}").distinct().collect()}
        assert outcomes <= set(fv.OUTCOMES)


def test_announced_but_unrebuildable_symbol_is_reported_missing(spark):
    found = sm.market(
        spark,
        sm.history("AAA", days=200) + TODAY,
        ["AAA"],
        announced=[("LOST", "2024-03-10 12:00:00"), ("AAA2", "2010-01-01 00:00:00")],
    )
    missing = {row["month"]: row["known_missing"] for row in found.monthly().collect()}
    assert missing["2024-03"] == 1 and missing["2024-04"] == 0
    assert {r["symbol"] for r in found.candidates.collect()} == {"AAA"}


def test_announcement_replaces_a_rebuilt_entry(spark):
    found = sm.market(
        spark,
        sm.history("AAA") + sm.history("BBB") + TODAY,
        ["AAA", "BBB"],
        announced=[("BBB", "2024-03-10 12:00:00")],
    )
    entries = {row["symbol"]: row for row in found.calendar.collect()}
    assert not entries["BBB"]["metadata_available"]
    assert {r["symbol"] for r in found.candidates.collect()} == {"AAA"}


def test_symbols_without_bars_get_no_entry(spark):
    found = sm.market(spark, sm.history("AAA") + TODAY, ["AAA", "SILENT"])
    assert {row["symbol"] for row in found.calendar.collect()} == {"AAA"}


def test_spread_counts_at_the_last_refresh_only(spark):
    spreads = spark.createDataFrame(
        [(sm.VENUE, "AAA", Decimal(20), dt.datetime(2024, 6, 9)), (sm.VENUE, "BBB", Decimal(30), None)],
        "venue string, symbol string, spread_bps decimal(20,10), observed_at timestamp",
    )
    rows = sm.history("AAA", days=300) + sm.history("BBB", days=300) + TODAY
    verdicts = sm.market(spark, rows, ["AAA", "BBB"], spreads=spreads).verdicts()
    last = sm.at_decision(verdicts)
    earlier = sm.at_decision(verdicts, dt.datetime(2024, 5, 1))
    assert last["AAA"]["v_median_spread"] == fv.ADMIT
    assert last["BBB"]["v_median_spread"] == fv.NOT_EVALUABLE, "an undated snapshot is no evidence"
    assert earlier["AAA"]["v_median_spread"] == fv.NOT_EVALUABLE


def test_buffer_needs_two_refreshes_each_way(spark):
    pattern = [0, 1, 0, 1, 1, 0, 1, 0, 0, 1, 1, 1]
    rows = [
        (sm.VENUE, "EUR", "AAA", dt.datetime(2024, n + 1, 1), bool(passes), True)
        for n, passes in enumerate(pattern)
    ]
    frame = spark.createDataFrame(
        rows,
        "venue string, quote_policy string, symbol string, as_of timestamp, in_p boolean, listed boolean",
    )
    state = [r["buffered_member"] for r in policy.buffered(frame, "p").orderBy("as_of").collect()]
    assert [int(s) for s in state] == [0, 0, 0, 0, 1, 1, 1, 1, 0, 0, 1, 1]


def test_delisting_leaves_the_buffer_at_once(spark):
    rows = [
        (sm.VENUE, "EUR", "AAA", dt.datetime(2024, month, 1), month <= 3, month <= 3)
        for month in range(1, 6)
    ]
    frame = spark.createDataFrame(
        rows,
        "venue string, quote_policy string, symbol string, as_of timestamp, in_p boolean, listed boolean",
    )
    state = [r["buffered_member"] for r in policy.buffered(frame, "p").orderBy("as_of").collect()]
    assert state == [False, True, True, False, False]


def test_point_lookup_agrees_with_the_monthly_plan(spark):
    gone = sm.history("GONE", days=300, until=dt.datetime(2024, 4, 15))
    found = sm.market(
        spark, gone + sm.history("AAA", days=300) + TODAY, ["GONE", "AAA"], GONE={"status": "BREAK"}
    )
    moments = ["2024-04-01 00:00:00", "2024-05-01 00:00:00"]
    looked_up = {
        (row["as_of"].strftime("%Y-%m"), row["symbol"])
        for row in universe_at(found, "EUR", "research", moments).collect()
    }
    assert looked_up == {("2024-04", "GONE"), ("2024-04", "AAA"), ("2024-05", "AAA")}


def test_point_lookup_counts_a_spread_measured_at_that_instant(spark):
    kinds = "venue string, symbol string, spread_bps decimal(20,10), observed_at timestamp"
    measured = [(sm.VENUE, "AAA", Decimal(1), dt.datetime(2024, 4, 1)), (sm.VENUE, "AAA", Decimal(1), dt.datetime(2024, 4, 30))]
    found = sm.market(spark, sm.history("AAA", days=300) + TODAY, ["AAA"], spreads=spark.createDataFrame(measured, kinds))
    moments = ["2024-04-01 00:00:00", "2024-05-01 00:00:00"]
    rows = universe_at(found, "EUR", "research+spread", moments).collect()
    assert [(r["as_of"], r["symbol"]) for r in rows] == [(dt.datetime(2024, 4, 1), "AAA")]


def test_point_lookup_refuses_a_venue_without_a_calendar(spark):
    from dataclasses import replace

    from tidemark.parameters import VenueProfile

    found = sm.market(spark, sm.history("AAA") + TODAY, ["AAA"])
    wider = replace(found, profiles=(*found.profiles, VenueProfile("undated", ("online",), False)))
    with pytest.raises(LookupError, match="undated"):
        universe_at(wider, "EUR", "research", ["2024-04-01 00:00:00"])


def test_staged_market_gives_the_same_table(spark):
    rows = sm.history("AAA", days=300) + sm.history("BBB", days=90) + TODAY
    lazy = sm.market(spark, rows, ["AAA", "BBB"])
    assert sorted(map(str, lazy.monthly().collect())) == sorted(
        map(str, lazy.staged().monthly().collect())
    )


def _brute_window(rows, moment, days):
    low, high = moment - dt.timedelta(days=days), moment - dt.timedelta(days=1)
    return [row for row in rows if low <= row[1] <= high]


def test_window_and_asof_match_brute_force(spark):
    """Random irregular bars, arbitrary instants, and exact boundaries."""
    rng = random.Random(11)
    start = dt.datetime(2023, 1, 1)
    rows = sorted(
        {
            (symbol, start + dt.timedelta(hours=rng.randrange(0, 24 * 300)))
            for symbol in ("AAA", "BBB", "CCC")
            for _ in range(250)
        }
    )
    rows = [(s, t, str(100 + n % 37), None if n % 5 == 0 else str(n)) for n, (s, t) in enumerate(rows)]
    moments = [start + dt.timedelta(hours=rng.randrange(0, 24 * 330)) for _ in range(25)]
    moments += [rows[10][1] + dt.timedelta(days=1), rows[20][1] + dt.timedelta(days=30)]
    frame = sm.bars(spark, rows)
    asked = spark.createDataFrame(
        [(sm.VENUE, m) for m in moments], "venue string, as_of timestamp_ntz"
    ).withColumn("as_of", F.col("as_of").cast("timestamp"))
    stats = {
        (r["symbol"], r["as_of"].replace(tzinfo=None)): r
        for r in history.window_statistics(history.window_at(frame, asked, 30)).collect()
    }
    probes = asked.select("venue", F.explode(F.array(*map(F.lit, ("AAA", "BBB", "CCC")))).alias("symbol"), "as_of")
    closes = {
        (r["symbol"], r["as_of"].replace(tzinfo=None)): r["close_as_of"]
        for r in history.close_as_of(frame, probes).collect()
    }
    for symbol in ("AAA", "BBB", "CCC"):
        mine = [row for row in rows if row[0] == symbol]
        for moment in moments:
            window = _brute_window(mine, moment, 30)
            volumes = sorted(Decimal(row[3]) for row in window if row[3] is not None)
            found = stats.get((symbol, moment))
            assert (found["observations"] if found else 0) == len(window)
            if volumes:
                middle = len(volumes) // 2
                exact = volumes[middle] if len(volumes) % 2 else (volumes[middle - 1] + volumes[middle]) / 2
                assert found["median_quote_volume"] == exact
            visible = [row for row in mine if row[1] + dt.timedelta(days=1) <= moment]
            expected = Decimal(visible[-1][2]) if visible else None
            assert closes[(symbol, moment)] == expected


def test_month_windows_match_brute_force(spark):
    rng = random.Random(5)
    start = dt.datetime(2023, 1, 1)
    rows = [("AAA", start + dt.timedelta(days=d), str(50 + d % 9), str(rng.randrange(1000))) for d in range(0, 420) if rng.random() < 0.8]
    facts = {
        r["as_of"].replace(tzinfo=None): r for r in history.refresh_facts(sm.bars(spark, rows), 45).collect()
    }
    for year, month in [(2023, m) for m in range(2, 13)] + [(2024, m) for m in range(1, 3)]:
        moment = dt.datetime(year, month, 1)
        window = _brute_window(rows, moment, 45)
        assert facts[moment]["observations"] == len(window)
    assert len(rows) == history.extents(sm.bars(spark, rows)).first()["bars"]


def test_money_in_floating_point_is_refused(spark):
    found = sm.market(spark, sm.history("AAA") + TODAY, ["AAA"])
    from tidemark.plans.universe import Market

    rough = found.bars.withColumn("close", F.col("close").cast("double"))
    with pytest.raises(TypeError, match="close"):
        Market.of(rough, found.metadata, found.spreads, found.profiles, found.thresholds)


def test_instruments_at_uses_the_given_calendar_and_refuses_others(spark):
    from tidemark.plans.universe import instruments_at

    metadata = sm.metadata(spark, ["ALIVE", "DEAD", "LOST"])
    calendar = spark.createDataFrame(
        [
            (sm.VENUE, "ALIVE", dt.datetime(2020, 1, 1), None, True),
            (sm.VENUE, "DEAD", dt.datetime(2020, 1, 1), dt.datetime(2022, 1, 1), True),
            (sm.VENUE, "LOST", dt.datetime(2020, 1, 1), dt.datetime(2022, 1, 1), False),
        ],
        "venue string, symbol string, listed_at timestamp_ntz, delisted_at timestamp_ntz, metadata_available boolean",
    ).select(
        "venue",
        "symbol",
        F.col("listed_at").cast("timestamp").alias("listed_at"),
        F.col("delisted_at").cast("timestamp").alias("delisted_at"),
        F.lit("reconstructed").alias("provenance"),
        "metadata_available",
    )
    moments = ["2021-06-01 00:00:00", "2022-01-01 00:00:00"]
    found = instruments_at(metadata, calendar, [sm.VENUE], moments).collect()
    assert {(r["as_of"].year, r["symbol"]) for r in found} == {(2021, "ALIVE"), (2021, "DEAD"), (2022, "ALIVE")}
    with pytest.raises(LookupError, match="elsewhere"):
        instruments_at(metadata, calendar, ["elsewhere"], moments)


def test_given_calendar_replaces_the_rebuilt_one(spark):
    from dataclasses import replace

    found = sm.market(spark, sm.history("AAA", days=300) + TODAY, ["AAA"])
    dated = found.calendar.withColumn("listed_at", F.to_timestamp(F.lit("2024-05-01"))).withColumn(
        "provenance", F.lit("venue_announcement")
    )
    given = replace(found, given_calendar=dated)
    assert judged(found)["AAA"]["v_listing_age"] == fv.ADMIT
    assert judged(given)["AAA"]["v_listing_age"] == fv.REJECT


def test_last_close_survives_months_without_bars(spark):
    rows = sm.history("GAP", days=20, until=dt.datetime(2023, 11, 10), close="42") + sm.history("AAA", days=400) + TODAY
    row = judged(sm.market(spark, rows, ["GAP", "AAA"]))["GAP"]
    assert row["close_as_of"] == Decimal(42)
    assert row["v_lot_size_feasible"] == fv.ADMIT
    assert row["v_median_quote_volume"] == fv.NOT_EVALUABLE


def test_a_bar_still_forming_is_not_consumed(spark):
    from tidemark.plans.universe import Market

    found = sm.market(spark, sm.history("AAA", days=300) + TODAY, ["AAA"])
    forming = sm.bars(spark, [("AAA", dt.datetime(2024, 6, 20), "9", "999999999")])
    hourly = sm.bars(spark, [("AAA", dt.datetime(2024, 5, 20, 7), "9", "999999999")])
    noisy = found.bars.unionByName(forming.withColumn("is_closed", F.lit(False))).unionByName(
        hourly.withColumn("timeframe", F.lit("1h"))
    )
    again = Market.of(noisy, found.metadata, found.spreads, found.profiles, found.thresholds)
    rows = lambda market: sorted(map(str, market.monthly().collect()))
    assert rows(found) == rows(again)
    assert again.windows.first()["observed_to"] == found.windows.first()["observed_to"]
