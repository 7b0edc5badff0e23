"""Interval joins, exact medians, book depth, bucketed bars, carried state, archive chains, many secrets."""

from __future__ import annotations

import random
import statistics
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tests import sidebyside
from tidemark.functions import text
from tidemark.operators import costs, coverage, depth, history, intervals, order_statistics, policy
from tidemark.sinks import bucketed, states
from tidemark.sources import bars as bar_source
from tidemark.sources import metadata

START = datetime(2020, 1, 1)


def random_intervals(draw, n):
    out = []
    for _ in range(n):
        begin = START + timedelta(seconds=draw.randrange(10**8))
        length = timedelta(microseconds=int(10 ** draw.uniform(3, 15.2)))
        out.append((draw.choice("abc"), begin, draw.choice([begin + length, begin + length, begin - length, begin, None] if n > 5 else [begin + length])))
    return out


@pytest.mark.parametrize(("seed", "n"), [(1, 4), (2, 60), (3, 300)])
def test_every_instant_is_labelled_once(spark, seed, n):
    draw = random.Random(seed)
    given = random_intervals(draw, n)
    if n == 4:
        given = [("a", START, START + timedelta(days=9000)), ("b", START, None), ("a", START + timedelta(days=9000), START + timedelta(days=9001)), (None, START, None)]
    edges = [m for _, a, b in given for m in (a, b) if m is not None]
    facts = [(i, draw.choice(["a", "b", "c", "d", None]), draw.choice([*edges, None, START + timedelta(seconds=draw.randrange(2 * 10**8))])) for i in range(400)]
    facts += facts[:5]
    rows = spark.createDataFrame(facts, "i int, key string, at timestamp")
    windows = spark.createDataFrame(given, "key string, opened timestamp, ended timestamp")
    labelled = intervals.label(rows, windows, ["key"], "at", "opened", "ended", "inside")
    expected = sorted(
        (i, None if at is None else any(k == key and a <= at and (b is None or at < b) for k, a, b in given if k is not None)) for i, key, at in facts
    )
    assert sorted((r["i"], r["inside"]) for r in labelled.collect()) == expected
    assert labelled.columns == ["i", "key", "at", "inside"]
    assert not sidebyside.unscalable_operators("", labelled)
    disjoint = intervals.merged(windows, ["key"], "opened", "ended").withColumn("_level", intervals._level((F.col("_until") - F.col("_from")) / 1_000_000))
    for level in range(intervals.ALL_TIME + 1):
        most = intervals.binned(disjoint, level).groupBy("key", "_from").count().agg(F.max("count")).first()[0]
        assert most is None or most <= intervals.FAN + 2


def test_no_intervals_and_no_rows(spark):
    rows = spark.createDataFrame([("a", START)], "key string, at timestamp")
    windows = spark.createDataFrame([("a", START, None)], "key string, opened timestamp, ended timestamp")
    assert [r["x"] for r in intervals.label(rows, windows.where("false"), ["key"], "at", "opened", "ended", "x").collect()] == [False]
    assert not intervals.label(rows.where("false"), windows, ["key"], "at", "opened", "ended", "x").collect()


def test_medians_by_counting_are_exact(spark, monkeypatch):
    draw = random.Random(7)
    groups = {
        "one": [Decimal("3.5")], "two": [Decimal("1.0000000000001"), Decimal("2")], "equal": [Decimal(5)] * 40, "none": [None, None],
        "wide": [Decimal(10) ** draw.randint(-9, 20) for _ in range(101)], "signs": [Decimal(draw.randint(-50, 50)) for _ in range(200)],
        "close": [Decimal("100000000000000000000") + Decimal(i) / 10**13 for i in range(64)], None: [Decimal(1), Decimal(4), None],
    }
    rows = [(k, v) for k, values in groups.items() for v in values]
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, v decimal(34,13)")
    for ranges in (1024, 3):
        monkeypatch.setattr(order_statistics, "RANGES", ranges)
        found = {r["g"]: (r["observations"], r["median"]) for r in order_statistics.exact_medians(frame, ["g"], "v").collect()}
        for key, values in groups.items():
            there = [v for v in values if v is not None]
            assert found[key] == (len(values), statistics.median(there) if there else None)
    assert not order_statistics.exact_medians(frame.where("false"), ["g"], "v").collect()


def test_minute_windows_end_a_minute_before_the_instant(spark):
    bars = spark.createDataFrame(
        [("v", "s", START + timedelta(minutes=m), Decimal(m)) for m in range(5)], "venue string, symbol string, open_time timestamp, quote_volume decimal(34,13)"
    )
    asked = spark.createDataFrame([("v", START + timedelta(minutes=3, seconds=30))], "venue string, as_of timestamp")
    found = history.window_medians(history.window_at(bars, asked, 30, 60)).collect()
    assert [(r["observations"], r["median_quote_volume"]) for r in found] == [(3, 1)]


LEVELS = [("ask", "101", "2"), ("ask", "100.5", "1"), ("ask", "100.5", "1"), ("ask", "150", "0.00000003"), ("ask", "99", "0"), ("bid", "100", "3"), ("bid", "90.25", "1.5")]


def by_hand(side, wanted):
    book = sorted(((Decimal(p), Decimal(q)) for s, p, q in LEVELS if s == ("ask" if side == "buy" else "bid") and Decimal(q)), reverse=side == "sell")
    filled, paid = Decimal(0), Decimal(0)
    for price, quantity in book:
        take = min(quantity, wanted - filled)
        filled, paid = filled + take, paid + take * price
    if not filled:
        return filled, paid, None, None
    tenth = Decimal("0.0000000001")
    average = (paid / filled).quantize(tenth, ROUND_HALF_UP)
    worse = average - book[0][0] if side == "buy" else book[0][0] - average
    return filled, paid, average, (worse * 10_000 / book[0][0]).quantize(tenth, ROUND_HALF_UP)


def test_walking_a_book(spark):
    book = depth.books(spark.createDataFrame([("v", "s", s, Decimal(p), Decimal(q)) for s, p, q in LEVELS], "venue string, symbol string, side string, price decimal(20,10), quantity decimal(24,8)"))
    asked = [(side, Decimal(q)) for side in ("buy", "sell") for q in ("0.5", "2", "2.00000001", "3.7", "4.00000003", "1000", "0")]
    trades = spark.createDataFrame([("v", "s", *a) for a in asked] + [("v", "t", "buy", Decimal(1))], "venue string, symbol string, side string, quantity decimal(24,8)")
    rows = depth.filled(trades.join(book, ["venue", "symbol"], "left")).collect()
    found = {(r["symbol"], r["side"], r["quantity"]): r for r in rows}
    for side, wanted in asked:
        r = found["s", side, wanted]
        filled, paid, average, slippage = by_hand(side, wanted)
        assert (r["filled"], r["notional"], r["average"], r["slippage_bps"]) == (filled, paid, average, slippage)
        assert r["complete"] == (filled >= wanted)
    assert found["s", "buy", Decimal("1000")]["levels"] == 3 and not found["s", "buy", Decimal("1000")]["complete"]
    assert (found["t", "buy", Decimal(1)]["filled"], found["t", "buy", Decimal(1)]["slippage_bps"]) == (0, None)
    # As one component of a cost model.
    whole = depth.filled(trades.join(book, ["venue", "symbol"], "left")).where("slippage_bps IS NOT NULL")
    zero = F.lit(0)
    priced = costs.estimate(whole, lambda: {"fee_bps": F.lit(8), "spread_bps": zero, "slippage_bps": F.col("slippage_bps"), "funding_bps": zero})
    assert all(r["total_bps"] == r["slippage_bps"] + 8 for r in priced.collect())


def test_a_long_book_is_searched_by_halves(spark):
    n = 3_000
    levels = [("v", "s", "ask", Decimal(i), Decimal(2)) for i in range(1, n + 1)]
    book = depth.books(spark.createDataFrame(levels, "venue string, symbol string, side string, price decimal(20,10), quantity decimal(24,8)"))
    asked = [0, 1, 2, 3, 1023, 1024, 1025, 2048, 2 * n - 1, 2 * n, 2 * n + 1]
    trades = spark.createDataFrame([("v", "s", "buy", Decimal(q)) for q in asked], "venue string, symbol string, side string, quantity decimal(24,8)")
    found = depth.filled(trades.join(book, ["venue", "symbol"], "left"))
    # No order looks at every level.
    assert "filter(" not in found._jdf.queryExecution().optimizedPlan().toString()
    for r in found.collect():
        had = min(int(r["quantity"]), 2 * n)
        whole, rest = divmod(had, 2)
        assert (r["levels"], r["filled"], r["notional"]) == (whole + rest, had, whole * (whole + 1) + rest * (whole + 1))


def test_bucketed_bars_are_read_without_an_exchange(spark, tmp_path):
    store = bucketed.BucketedBars(spark, f"bars_{abs(hash(str(tmp_path)))}", str(tmp_path / "bars"), 4)
    store.create()
    rows = [("v", f"s{i % 5}", "1d", START + timedelta(days=i), *[Decimal(1)] * 6, True, START + timedelta(days=i + 1)) for i in range(800)]
    bars = spark.createDataFrame(rows, bar_source.BAR_SCHEMA)
    store.write(bars)
    store.write(bars.where("open_time < '2020-06-01'").withColumns({"close": F.lit(2).cast("decimal(20,10)"), "observed_at": F.lit(START).cast("timestamp")}))
    store.write(bars.where("open_time >= '2021-01-01'").withColumns({"close": F.lit(3).cast("decimal(20,10)"), "observed_at": F.lit(datetime(2030, 1, 1)).cast("timestamp")}))
    found = {r["open_time"]: r["close"] for r in store.table().collect()}
    assert len(found) == store.table().count() == 800
    assert all(close == (3 if t >= datetime(2021, 1, 1) else 1) for t, close in found.items())
    again = bucketed.BucketedBars(spark, f"{store.name}_again", store.path, 4)
    again.create()
    assert again.table().count() == store.table(by_instrument=False).count() == 800
    for plan in (history.extents, history.ordinals_in_place, lambda b: history.refresh_facts(b, 30)):
        frame = plan(store.table())
        frame.collect()
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    spark.sql(f"DROP TABLE {store.name}")
    spark.sql(f"DROP TABLE {again.name}")


def test_carried_state_equals_the_whole_history(spark, tmp_path):
    draw = random.Random(4)
    months = [datetime(2021 + m // 12, m % 12 + 1, 1) for m in range(9)]
    rows = [
        ("v", "EUR", f"s{i}", month, draw.random() < 0.9, draw.random() < 0.5) for i in range(12) for month in months if draw.random() < 0.85
    ]
    verdicts = spark.createDataFrame(rows, "venue string, quote_policy string, symbol string, as_of timestamp, listed boolean, in_p boolean").cache()
    full = {(r["symbol"], r["as_of"]): (r["passing"], r["buffered_member"]) for r in policy.buffered(verdicts, "p").collect()}
    kept = states.BufferStates(spark, str(tmp_path / "state"), "p")
    for month in months:
        for _ in range(1 + (month.month % 3 == 0)):
            state = kept.take(month.date().isoformat(), verdicts.where(F.col("as_of") == F.lit(month)))
        for r in state.where(F.col("as_of") == F.lit(month)).collect():
            assert (r["passing"], r["buffered_member"]) == full[r["symbol"], month]
    assert {(r["symbol"], r["as_of"]) for r in state.collect()} == {(s, max(m for x, m in full if x == s)) for s in {s for s, _ in full}}
    # A refresh that has been counted changes nothing.
    same = policy.advance_buffer(state, verdicts.where(F.col("as_of") == F.lit(months[3])), "p")
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, state.collect()))


def listing_page(marker, following, truncated="true"):
    then = f"<NextMarker>{following}</NextMarker>" if following else ""
    return f"<ListBucketResult xmlns='x'><Marker>{marker}</Marker>{then}<IsTruncated>{truncated}</IsTruncated></ListBucketResult>"


def test_gaps_of_landed_pages(spark):
    pages = [
        ("whole", listing_page("", "b")), ("whole", listing_page("b", "c")), ("whole", listing_page("c", "", "false")), ("whole", listing_page("b", "c")),
        ("hole", listing_page("", "b")), ("hole", listing_page("c", "", "false")),
        ("headless", listing_page("b", "", "false")), ("open", listing_page("", "")), ("error", "<Error/>"), ("error", None),
    ]
    found = metadata.archive_gaps(spark.createDataFrame(pages, "venue string, payload string")).collect()
    assert sorted((r["venue"], r["after"], r["marker"], r["reason"]) for r in found if r["venue"] != "error") == [
        ("headless", None, "", "first page not landed"), ("hole", "", "b", "page not landed"), ("open", "", None, "truncated without a next marker"),
    ]
    assert sorted(r["reason"] for r in found if r["venue"] == "error") == ["first page not landed", "not a listing page", "not a listing page"]


def test_many_secrets_in_one_pass(spark):
    draw = random.Random(5)
    secrets = ["".join(draw.choices("abc", k=draw.randint(6, 9))) for _ in range(5000)] + ["short", "", None, "ünïcödé"]
    texts = ["".join(draw.choices("abcd ", k=400)) for _ in range(50)] + [None, "", "xünïcödéy short", "aaaaaa" * 50]
    frame = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "i int, body string, other string")
    many = text.redact_many(frame, secrets, ["body"])

    def fold(body):
        for secret in sorted({s for s in secrets if s and len(s) >= 6}, key=lambda s: (-len(s), s)):
            body = body.replace(secret, "***REDACTED***")
        return body

    found = {r["i"]: (r["body"], r["other"]) for r in many.collect()}
    assert found == {i: (None if t is None else fold(t), t) for i, t in enumerate(texts)}
    one = text.redact_many(frame, secrets[:1], ["body"])
    size = lambda f: len(f._jdf.queryExecution().analyzed().toString().splitlines())
    assert size(many) == size(one)
    few = secrets[:30]
    folded = {r["i"]: r["body"] for r in frame.select("i", text.redact(F.col("body"), few).alias("body")).collect()}
    assert folded == {r["i"]: r["body"] for r in text.redact_many(frame, few, ["body"]).collect()}
    assert text.redact_many(frame, ["abc"], ["body"]) is frame


def test_yearly_series_not_yet_stored(spark):
    wanted = spark.createDataFrame([("v", "a", 1), ("v", "a", 2), ("v", "b", 1)], "venue string, symbol string, year int")
    stored = spark.createDataFrame([("v", "a", 1), ("v", "a", 1)], "venue string, symbol string, year int")
    assert sorted(tuple(r) for r in coverage.not_yet_stored(wanted, stored, also=["year"]).select("symbol", "year").collect()) == [("a", 2), ("b", 1)]
    assert sorted(r["symbol"] for r in coverage.not_yet_stored(wanted, stored).collect()) == ["b"]
