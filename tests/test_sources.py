"""Readers on small payloads: good rows, named faults, and nothing silently empty."""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests import small_market as sm
from tidemark.functions import instants, money, text
from tidemark.sinks.bars import BarStore
from tidemark.sinks.records import calendar_documents, read_calendar_json
from tidemark.sources import bars, books, datasets, envelopes, metadata

JAN_1 = 1_704_067_200_000


def page(spark, payload, observed="2024-01-03 00:00:00"):
    frame = spark.createDataFrame([(json.dumps(payload) if not isinstance(payload, str) else payload,)], "payload string")
    return frame.select(
        F.lit("test_venue").alias("venue"),
        F.lit("BTCEUR").alias("symbol"),
        F.lit("1d").alias("timeframe"),
        F.to_timestamp(F.lit(observed)).alias("observed_at"),
        "payload",
    )


def kline(day, close="42000.5", **changes):
    row = [JAN_1 + day * 86_400_000, "41000", "43000", "40000", close, "12.5", 0, "525006.25", 9, "1", "2", "0"]
    for at, value in changes.items():
        row[int(at[1:])] = value
    return row


def test_klines_are_typed_and_closed_against_the_observation(spark):
    rows = bars.parse_klines(page(spark, [kline(0), kline(1), kline(2)])).orderBy("open_time").collect()
    assert [row["is_closed"] for row in rows] == [True, True, False]
    assert rows[0]["close"] == Decimal("42000.5") and rows[0]["quote_volume"] == Decimal("525006.25")


def test_malformed_klines_are_rows_with_a_reason(spark):
    payload = [kline(0)[:7], kline(1, c4="NaN"), kline(2, c0="soon"), kline(3, c1="-1"), kline(4)]
    parsed = bars.parse_klines(page(spark, payload))
    reasons = {row["reason"] for row in bars.quarantine(parsed).collect()}
    assert reasons == {
        "too few fields",
        "expected a decimal",
        "open_time: expected an integer",
        "price below zero",
    }
    assert bars.good_bars(parsed).count() == 1


def test_open_bars_are_read_only_on_request_and_raise_in_strict_use(spark):
    good = bars.good_bars(bars.parse_klines(page(spark, [kline(0), kline(1), kline(2)])))
    start, end = F.to_timestamp(F.lit("2024-01-01")), F.to_timestamp(F.lit("2024-01-04"))
    assert bars.within(good, start, end).count() == 2
    assert bars.within(good, start, end, include_open=True).count() == 3
    assert bars.within(good, start, F.to_timestamp(F.lit("2024-01-02"))).count() == 1
    with pytest.raises(PySparkException, match="bar still open"):
        bars.require_closed(good).collect()


def test_ohlc_turnover_is_weighted_price_times_volume(spark):
    body = {"error": [], "result": {"last": 5, "XXBTZEUR": [[JAN_1 // 1000, "1", "2", "1", "2", "1.5", "3.25", 7]]}}
    row = bars.parse_ohlc(page(spark, body)).first()
    assert row["quote_volume"] == Decimal("4.875")
    assert row["volume"] == Decimal("3.25")
    assert row["reason"] is None


def test_an_empty_series_has_no_rows_and_no_faults(spark):
    body = {"error": [], "result": {"XXBTZEUR": [], "last": 5}}
    assert bars.parse_ohlc(page(spark, body)).count() == 0
    assert bars.parse_klines(page(spark, [])).count() == 0


def test_envelopes_keep_failure_refusal_and_emptiness_apart(spark):
    bodies = {
        '{"error":[],"result":{}}': "ok",
        '{"error":["EService:Unavailable"]}': "unavailable",
        '{"error":["EQuery:Invalid asset pair"],"result":{}}': "rejected",
        '{"error":[]}': "malformed",
        '{"result":{"a":1}}': "malformed",
    }
    frame = spark.createDataFrame([(body,) for body in bodies], "body string")
    found = {
        row["body"]: row["outcome"]
        for row in frame.select("body", envelopes.envelope_outcome(F.col("body")).alias("outcome")).collect()
    }
    assert found == bodies


def test_response_outcomes(spark):
    frame = spark.createDataFrame([(s,) for s in (200, 204, 429, 404, 503, None, 301)], "status int")
    found = [r[0] for r in frame.select(envelopes.response_outcome(F.col("status"))).collect()]
    assert found == ["ok", "ok", "retryable", "rejected", "retryable", "transport_error", "rejected"]


def test_recorded_responses(spark):
    cases = {
        '{"regime":"ranging","confidence":0.5}': None,
        '{"regime":"ranging","confidence":1.01}': "confidence: outside 0..1",
        '{"regime":"sideways","confidence":0.5}': "regime: unknown label",
        '{"regime":"ranging","confidence":0.5,"size":3}': "unexpected field",
        '{"confidence":0.5}': "regime: missing required key",
    }
    frame = spark.createDataFrame([(case,) for case in cases], "r string")
    found = {row[0]: row[1] for row in frame.select("r", envelopes.regime_response_fault(F.col("r"))).collect()}
    assert found == cases
    advice = spark.createDataFrame(
        [('{"action":"long","strategy":"x","confidence":1}',), ('{"action":"buy","strategy":"x","confidence":1}',)],
        "r string",
    )
    assert [r[0] for r in advice.select(envelopes.recommendation_fault(F.col("r"))).collect()] == [
        None,
        "action: unknown label",
    ]


def test_symbol_metadata_filters(spark):
    tick = {"filterType": "PRICE_FILTER", "tickSize": "0.01"}
    lot = {"filterType": "LOT_SIZE", "stepSize": "0.001"}
    symbol = lambda name, status, *filters: {
        "symbol": name, "baseAsset": name, "quoteAsset": "EUR", "status": status, "filters": list(filters)
    }
    body = {
        "symbols": [
            symbol("A", "BREAK", tick, lot, {"filterType": "MIN_NOTIONAL", "minNotional": "5"}, {"filterType": "NOTIONAL", "minNotional": "9"}),
            symbol("B", "TRADING", tick, lot),
            symbol("C", "TRADING", tick),
            symbol("B", "BREAK", tick, {"filterType": "LOT_SIZE", "stepSize": "7"}, lot),
        ]
    }
    pages = spark.createDataFrame([("v", 0, json.dumps(body))], "venue string, page bigint, payload string")
    rows = {row["symbol"]: row for row in metadata.parse_symbols(pages).collect()}
    assert rows["A"]["min_notional"] == 9 and rows["A"]["status"] == "BREAK"
    assert rows["B"]["min_notional"] == 0 and rows["B"]["status"] == "BREAK"
    assert rows["B"]["lot_size"] == Decimal("0.001")
    assert rows["C"]["reason"] == "missing LOT_SIZE.stepSize"


def test_pairs_without_a_display_name_are_skipped(spark):
    pair = {"altname": "XBTEUR", "wsname": "XBT/EUR", "status": "online", "tick_size": "0.1", "lot_decimals": 8, "costmin": "0.45"}
    nameless = {k: v for k, v in pair.items() if k != "wsname"}
    body = {"error": [], "result": {"XXBTZEUR": pair, "OLD": nameless, "ODD": {**pair, "wsname": "A/B/C", "altname": "ODD"}}}
    pages = spark.createDataFrame([("v", 0, json.dumps(body))], "venue string, page bigint, payload string")
    rows = metadata.good_metadata(metadata.parse_pairs(pages)).collect()
    assert [(r["symbol"], r["base"], r["quote"], r["lot_size"]) for r in rows] == [
        ("XBTEUR", "XBT", "EUR", Decimal("0.00000001"))
    ]


def test_spreads_ignore_empty_and_crossed_books(spark):
    books_json = [
        {"symbol": "A", "bidPrice": "100", "askPrice": "101"},
        {"symbol": "B", "bidPrice": "0", "askPrice": "101"},
        {"symbol": "C", "bidPrice": "102", "askPrice": "101"},
        {"symbol": "D", "bidPrice": "100", "askPrice": "100"},
    ]
    pages = spark.createDataFrame([("v", dt.datetime(2024, 1, 1), json.dumps(books_json))], "venue string, as_of timestamp, payload string")
    wanted = spark.createDataFrame([("v", s) for s in "ABC"], "venue string, symbol string")
    rows = books.ticker_spreads(pages, wanted).collect()
    assert [(r["symbol"], r["spread_bps"]) for r in rows] == [("A", Decimal("99.5024875622"))]


def test_exact_median(spark):
    frame = spark.createDataFrame(
        [([Decimal("1.10"), Decimal("2.25")],), ([Decimal(3), Decimal(1), Decimal(2)],), ([],)],
        "v array<decimal(34,13)>",
    )
    found = [r[0] for r in frame.select(money.exact_median(F.col("v"))).collect()]
    assert found == [Decimal("1.675"), Decimal(2), None]


def test_money_texts(spark):
    frame = spark.createDataFrame([(t,) for t in ("1.5", "NaN", "Infinity", "abc", "", None)], "t string")
    found = [r[0] for r in frame.select(money.parse_money(F.col("t"), money.PRICE)).collect()]
    assert found == [Decimal("1.5"), None, None, None, None, None]


def test_listing_is_inclusive_and_delisting_exclusive(spark):
    frame = spark.sql(
        "SELECT timestamp'2024-01-01' AS l, timestamp'2024-03-01' AS d, explode(array("
        "timestamp'2023-12-31', timestamp'2024-01-01', timestamp'2024-02-29', timestamp'2024-03-01')) AS a"
    )
    found = [r[0] for r in frame.select(instants.is_listed(F.col("l"), F.col("d"), F.col("a"))).collect()]
    assert found == [False, True, True, False]


def test_redaction_takes_the_longest_secret_first(spark):
    frame = spark.createDataFrame([("key=hunter2000 hunter2 ab", "x")], "note string, api_key string")
    row = text.redact_frame(frame, ["hunter2", "hunter2000", "ab", ""]).first()
    assert row["note"] == "key=***REDACTED*** ***REDACTED*** ab"
    assert row["api_key"] == "***REDACTED***"


def test_venue_folder_as_a_collector_leaves_it(spark, tmp_path):
    (tmp_path / "bars").mkdir()
    (tmp_path / "pair_metadata.json").write_text(
        json.dumps({"XBTEUR": {"canonical": "XXBTZEUR", "base": "XBT", "quote": "EUR", "status": "online", "tick_size": "0.1", "lot_size": "0.00000001", "min_notional": "0.45"}}, indent=1)
    )
    for name in ("XBTEUR", "ETHEUR"):
        (tmp_path / "bars" / f"{name}.json").write_text(
            json.dumps({"symbol": name, "timeframe": "1d", "rows": [[JAN_1, "42000.5", ""], [JAN_1 + 86_400_000, "1", "2.5"]]}, indent=1)
        )
    files = datasets.load(spark, "v", str(tmp_path))
    assert files.metadata.first()["min_notional"] == Decimal("0.45")
    rows = files.bars.orderBy("symbol", "open_time").collect()
    assert len(rows) == 4 and rows[0]["quote_volume"] is None and rows[1]["quote_volume"] == Decimal("2.5")
    assert files.spreads.count() == 0
    with pytest.raises(FileNotFoundError):
        datasets.load(spark, "v", str(tmp_path / "bars"))


def test_store_keeps_one_row_per_key_and_reads_a_pruned_range(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "store"))
    first = sm.bars(spark, sm.history("AAA", days=60))
    late = first.withColumn("close", F.lit(7).cast(money.PRICE)).withColumn(
        "observed_at", F.col("observed_at") + F.expr("INTERVAL 1 HOUR")
    )
    store.write(first)
    store.write(late.where(F.col("open_time") >= F.to_timestamp(F.lit("2024-05-20"))))
    store.write(first)
    assert store.table().count() == 60
    assert store.table().where("close = 7").count() == 12
    wanted = spark.createDataFrame([(sm.VENUE, "AAA")], "venue string, symbol string")
    found = store.read(wanted, F.to_timestamp(F.lit("2024-05-01")), F.to_timestamp(F.lit("2024-05-11")))
    assert found.count() == 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert "PushedFilters: [IsNotNull(open_time)" in plan or "GreaterThanOrEqual(open_time" in plan


def test_calendar_document_round_trip(spark, tmp_path):
    found = sm.market(spark, sm.history("AAA") + sm.history("GONE", days=90, until=dt.datetime(2024, 4, 1)), ["AAA", "GONE"], GONE={"status": "BREAK"})
    calendar_documents(found.calendar).write.json(str(tmp_path / "calendar"))
    again = read_calendar_json(spark, str(tmp_path / "calendar"), one_per_file=False)
    keys = ["symbol", "listed_at", "delisted_at", "provenance", "note", "metadata_available"]
    assert sorted(map(tuple, again.select(*keys).collect()), key=str) == sorted(
        map(tuple, found.calendar.select(*keys).collect()), key=str
    )


@pytest.mark.parametrize(
    ("field", "value"), [("listed_at", "2024-01-01T00:00:00"), ("listed_at", None), ("delisted_at", "2024-02-01"), ("delisted_at", "never")]
)
def test_calendar_instants_need_an_offset(spark, tmp_path, field, value):
    """An unreadable delisting must never read as "still listed"."""
    entry = {"symbol": "A", "listed_at": "2024-01-01T00:00:00Z", "delisted_at": "2024-02-01T00:00:00+01:00", "provenance": "reconstructed", "metadata_available": True}
    (tmp_path / "good.json").write_text(json.dumps({"venue": "v", "methodology": "m", "entries": [entry]}, indent=1))
    row = read_calendar_json(spark, str(tmp_path / "good.json")).first()
    assert row["delisted_at"] == dt.datetime(2024, 1, 31, 23) and row["note"] == ""
    (tmp_path / "bad.json").write_text(json.dumps({"venue": "v", "methodology": "m", "entries": [entry | {field: value}]}, indent=1))
    with pytest.raises(PySparkException, match=f"v A {field}"):
        read_calendar_json(spark, str(tmp_path / "bad.json")).collect()


def test_unreadable_payloads_are_never_empty_results(spark):
    """Each failure leaves a row that names it; only a true empty answer has none."""
    for payload in ('{"code":-1121,"msg":"Invalid symbol."}', "not json", "null"):
        rows = bars.parse_klines(page(spark, payload)).collect()
        assert [r["reason"] for r in rows] == ["payload: expected an array of rows"], payload
    found = {}
    for payload in (
        '{"error":["EQuery:Invalid asset pair"]}',
        '{"error":["EService:Busy"]}',
        '{"error":[]}',
        '{"error":[],"result":{"XXBTZEUR":7,"last":5}}',
        '{"error":[],"result":{"last":5}}',
    ):
        parsed = bars.parse_ohlc(page(spark, payload))
        found[payload] = [r["reason"] for r in bars.quarantine(parsed).collect()]
        assert bars.good_bars(parsed).count() == 0
    assert list(found.values()) == [
        ["envelope: rejected"],
        ["envelope: unavailable"],
        ["envelope: malformed"],
        ["result: expected an array of rows"],
        [],
    ]
    pages = spark.createDataFrame([("v", 0, "oops")], "venue string, page bigint, payload string")
    assert metadata.parse_symbols(pages).first()["reason"] == "page or symbol: not as described"
    assert metadata.parse_pairs(pages).first()["reason"] == "envelope: malformed"
    assert metadata.good_metadata(metadata.parse_symbols(pages)).count() == 0
    book = spark.createDataFrame([("v", dt.datetime(2024, 1, 1), "oops")], "venue string, as_of timestamp, payload string")
    wanted = spark.createDataFrame([("v", "A")], "venue string, symbol string")
    with pytest.raises(PySparkException, match="unreadable book page"):
        books.ticker_spreads(book, wanted).collect()


def test_broken_calendar_file_is_an_error(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"venue": "v", "entries": [{]}')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_calendar_json(spark, str(tmp_path / "c.json")).collect()


def test_asof_join_shuffles_its_timeline_once(spark):
    from tidemark.operators import history

    frame = sm.bars(spark, sm.history("AAA", days=90))
    probes = frame.select("venue", "symbol", F.col("open_time").alias("as_of"))
    found = history.close_as_of(frame, probes)
    found.collect()
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def _symbol(name, tick="0.1", lot="1", least=None):
    filters = [{"filterType": "PRICE_FILTER", "tickSize": tick}, {"filterType": "LOT_SIZE", "stepSize": lot}]
    return {"symbol": name, "baseAsset": "A", "quoteAsset": "B", "status": "TRADING", "filters": filters + ([{"filterType": "NOTIONAL", "minNotional": least}] if least else [])}


def test_junk_numbers_are_no_metadata(spark):
    symbols = [_symbol("T", tick="abc"), _symbol("L", lot="x"), _symbol("M", least="junk"), _symbol("OK")]
    pages = spark.createDataFrame([("v", 0, json.dumps({"symbols": symbols}))], "venue string, page bigint, payload string")
    found = {r["symbol"]: r["reason"] for r in metadata.parse_symbols(pages).collect()}
    assert found == {
        "T": "PRICE_FILTER.tickSize: expected a decimal", "L": "LOT_SIZE.stepSize: expected a decimal", "M": "minNotional: expected a decimal", "OK": None,
    }


def test_every_faulty_page_leaves_its_own_row(spark):
    pages = spark.createDataFrame([("v", n, "oops") for n in range(3)], "venue string, page bigint, payload string")
    assert metadata.parse_symbols(pages).count() == 3
    bodies = ['{"error":["EQuery:Unknown"]}', '{"error":["EService:Busy"]}', "oops"]
    pages = spark.createDataFrame([("v", n, b) for n, b in enumerate(bodies)], "venue string, page bigint, payload string")
    assert sorted(r["reason"] for r in metadata.parse_pairs(pages).collect()) == ["envelope: malformed", "envelope: rejected", "envelope: unavailable"]


def test_lot_decimals_beyond_eight(spark):
    pair = lambda n: {"altname": f"P{n}", "wsname": "A/B", "status": "online", "tick_size": "0.1", "lot_decimals": n, "costmin": "1"}
    body = {"error": [], "result": {f"k{n}": pair(n) for n in (10, 0, -2, 40)}}
    rows = {r["symbol"]: r for r in metadata.parse_pairs(spark.createDataFrame([("v", 0, json.dumps(body))], "venue string, page bigint, payload string")).collect()}
    assert rows["P10"]["lot_size"] == Decimal("1E-10") and rows["P0"]["lot_size"] == 1 and rows["P-2"]["lot_size"] == 100
    assert rows["P40"]["reason"] == "lot_decimals: outside what a lot can hold"


def test_wide_prices_and_volumes_are_bars(spark):
    rows = [[1_704_067_200, "200000000", "200000000", "200000000", "200000000", "200000000.5", "3.25", 1], [1_704_153_600, "1", "1", "1", "1", "0.5", "2000000000000.00000001", 1]]
    parsed = bars.parse_ohlc(page(spark, {"error": [], "result": {"X": rows, "last": 1}}, "2024-01-05 00:00:00"))
    assert not bars.quarantine(parsed).collect()
    assert sorted(r["quote_volume"] for r in bars.good_bars(parsed).collect()) == [Decimal("650000001.6250000000000"), Decimal("1000000000000.0000000050000")]


@pytest.mark.parametrize("fault", ["metadata", "close", "time", "turnover", "snapshot"])
def test_broken_venue_files_fail(spark, tmp_path, fault):
    described = {"X": {"canonical": "X", "base": "A", "quote": "B", "status": "online", "tick_size": "junk" if fault == "metadata" else "0.1", "lot_size": "1", "min_notional": None}}
    (tmp_path / "pair_metadata.json").write_text(json.dumps(described))
    row = [str(JAN_1) if fault != "time" else "noon", "1" if fault != "close" else "x", "junk" if fault == "turnover" else ""]
    (tmp_path / "bars").mkdir()
    (tmp_path / "bars" / "x.json").write_text(json.dumps({"symbol": "X", "timeframe": "1d", "rows": [row]}))
    (tmp_path / "spread_snapshot.json").write_text("not json" if fault == "snapshot" else json.dumps({"observed_at": "2024-01-01T00:00:00Z", "bps": {"X": "1"}}))
    files = datasets.load(spark, "v", str(tmp_path))
    with pytest.raises(PySparkException, match="not readable"):
        for frame in (files.metadata, files.bars, files.spreads):
            frame.collect()


def test_responses_have_typed_fields(spark):
    good = {"action": "long", "strategy": "s", "confidence": 0.5}
    bodies = [good, good | {"strategy": 5}, good | {"strategy": None}, good | {"rationale": None}, good | {"regime": "ranging"}]
    frame = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "i int, payload string")
    found = [r["f"] for r in frame.orderBy("i").select(envelopes.recommendation_fault(F.col("payload")).alias("f")).collect()]
    assert found == [None, "strategy: expected string", "strategy: expected string", "rationale: expected string", None]


def test_a_write_reads_only_the_touched_partitions(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "store"))
    rows = [("v", "A", "1d", dt.datetime(2024, m, 5), *[Decimal(1)] * 6, True, dt.datetime(2024, m, 6)) for m in range(1, 9)]
    frame = spark.createDataFrame(rows, bars.BAR_SCHEMA)
    store.write(frame)
    from tidemark.sinks.bars import with_month

    batch = with_month(frame.where("month(open_time) = 3"))
    kept = store.touched(batch)
    assert len(kept.collect()) == 1
    scan = kept._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert scan.metrics().apply("numPartitions").value() == 1
    assert store.write(frame.where("month(open_time) = 3")) == 1
    assert store.table().count() == 8


def test_staged_copies_are_deleted(spark, tmp_path, monkeypatch):
    from tidemark.sinks import bars as sink

    staged = []
    monkeypatch.setattr(sink, "staging_path", lambda _, label: staged.append(str(tmp_path / f"{label}{len(staged)}")) or staged[-1])
    store = BarStore(spark, str(tmp_path / "store"))
    rows = [("v", "A", "1d", dt.datetime(2024, 1, 5), *[Decimal(1)] * 6, True, dt.datetime(2024, 1, 6))]
    frame = spark.createDataFrame(rows, bars.BAR_SCHEMA)
    store.write(frame)
    store.write(frame)
    assert len(staged) == 3 and [p.name for p in tmp_path.iterdir()] == ["store"]
