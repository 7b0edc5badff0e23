"""Streams: closing by observation, late prints, silent requests, bounded batches."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.sinks.bars import BarStore
from tidemark.sources import bars as bar_source
from tidemark.streaming import corrected_bars, ingest, live_bars, requests

PRINTS = "venue string, symbol string, ts timestamp, price decimal(18,2), qty decimal(18,2), quote_qty decimal(36,4), place bigint"
START = datetime(2024, 1, 1)


def prints(seed=1, n=300, hours=30):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        price, qty = Decimal(draw.randint(100, 999)), Decimal(draw.randint(1, 9))
        moment = START + timedelta(seconds=draw.randrange(hours * 3600))
        rows.append(("v", draw.choice("AB"), moment, price, qty, price * qty, i))
    return sorted(rows, key=lambda r: r[2])


def bars_of(frame):
    names = ["symbol", "open_time", "open", "high", "low", "close", "volume", "quote_volume"]
    return sorted(tuple(r) for r in frame.select(*names).collect())


def expected(spark, rows):
    return bars_of(bar_source.from_prints(spark.createDataFrame(rows, PRINTS), "1h", ["ts", "place"]))


def at(moment):
    return F.lit(moment).cast("timestamp")


@pytest.mark.parametrize("files_per_batch", [None, 1])
def test_the_last_bar_closes_when_somebody_looks(spark, tmp_path, files_per_batch):
    rows = prints()
    cut = START + timedelta(hours=15, minutes=20)
    landing = str(tmp_path / "landing")

    def run():
        stream = live_bars.landed_prints(spark, spark.createDataFrame([], PRINTS).schema, landing, files_per_batch)
        live_bars.append_available(live_bars.closed_bars(stream, "1h", "0 seconds", ["ts", "place"]), str(tmp_path / "bars"), str(tmp_path / "check"))
        return bars_of(spark.read.parquet(str(tmp_path / "bars")))

    live_bars.land(spark.createDataFrame([r for r in rows if r[2] < cut], PRINTS).coalesce(1), at(cut), landing)
    whole = expected(spark, rows)
    # The hour that is half over stays open.
    assert run() == [b for b in whole if b[1] < datetime(2024, 1, 1, 15)]
    live_bars.land(spark.createDataFrame([r for r in rows if r[2] >= cut], PRINTS).coalesce(1), at(rows[-1][2]), landing)
    assert len(run()) < len(whole)
    # Nothing is printed any more; a poll after the hour closes what is left.
    live_bars.land(spark.createDataFrame([], PRINTS), at(START + timedelta(hours=40)), landing)
    assert run() == whole


def keeper(spark, path):
    return corrected_bars.CorrectedBars(BarStore(spark, f"{path}/store"), f"{path}/live", "1h", 600, ("ts", "place"))


def batch(spark, rows, poll):
    frame = spark.createDataFrame(rows, PRINTS)
    if poll is None:
        return frame
    return frame.unionByName(spark.range(1).select(at(poll).alias("ts")), allowMissingColumns=True)


def test_late_prints_correct_their_bars_and_only_those(spark, tmp_path):
    rows = prints(seed=2)
    cut = START + timedelta(hours=15)
    late = [r for r in rows if r[2] < START + timedelta(hours=10) and r[6] % 7 == 0]
    early = [r for r in rows if r[2] < cut and r not in late]
    kept = keeper(spark, tmp_path)
    kept.take(batch(spark, early, cut), 0)
    before = {b[:2]: b for b in bars_of(kept.store.table())}
    assert all(b[1] + timedelta(hours=1) <= cut - timedelta(minutes=10) for b in before.values())
    kept.take(batch(spark, late, None), 1)
    after = {b[:2]: b for b in bars_of(kept.store.table())}
    touched = {(r[1], r[2].replace(minute=0, second=0)) for r in late}
    assert touched and {k for k in after if before.get(k) != after[k]} <= touched
    # The same batch again, as after a failure.
    kept.take(batch(spark, late, None), 1)
    assert {b[:2]: b for b in bars_of(kept.store.table())} == after
    kept.take(batch(spark, [r for r in rows if r[2] >= cut], None), 2)
    # A batch without prints, and one without anything.
    kept.take(batch(spark, [], START + timedelta(hours=60)), 3)
    kept.take(batch(spark, [], None), 4)
    assert bars_of(kept.store.table()) == expected(spark, rows)
    counts = {r["batch"]: (r["prints"], r["late_prints"], r["corrected_bars"]) for r in kept.progress().collect()}
    assert counts[0] == (len(early), 0, 0) and counts[1] == (len(late), len(late), len(touched)) and counts[3] == (0, 0, 0)
    assert kept.late_prints().count() == len(late)


def test_nothing_has_come_late_yet(spark, tmp_path):
    kept = keeper(spark, tmp_path)
    kept.take(batch(spark, [], START), 0)
    assert kept.late_prints().count() == 0


ATTEMPTS = "venue string, url string, params string, run string, requested_at timestamp, attempt int, outcome string, detail string"


def test_silent_requests_end(spark, tmp_path):
    hour = lambda h: START + timedelta(hours=h)
    rows = [
        ("v", "/k", "answered", "r1", hour(0), 1, "retryable", "HTTP 503"), ("v", "/k", "answered", "r1", hour(1), 2, "ok", ""),
        ("v", "/k", "answered", "r2", hour(1), 1, "rejected", "HTTP 404"),
        ("v", "/k", "silent", "r1", hour(1), 1, "transport_error", "none"),
        *[("v", "/k", "used up", "r1", hour(i), i, "retryable", f"HTTP {i}") for i in range(1, 6)],
        ("v", "/k", "no run", None, hour(2), 1, "ok", ""),
    ]
    landing = str(tmp_path / "landing")

    def run(some, poll):
        live_bars.land(spark.createDataFrame(some, ATTEMPTS).coalesce(1), at(poll), landing, "requested_at")
        stream = live_bars.landed_prints(spark, spark.createDataFrame([], ATTEMPTS).schema, landing)
        live_bars.append_available(requests.final_outcomes(stream, "0 seconds", 6 * 3600), str(tmp_path / "finals"), str(tmp_path / "check"))
        found = spark.read.parquet(str(tmp_path / "finals")).collect()
        assert len(found) == len({(r["params"], r["run"]) for r in found})
        return {(r["params"], r["run"]): (r["attempts"], r["final_outcome"], r["detail"]) for r in found}

    # Attempts that are all used need no patience.
    assert run(rows, hour(5)) == {("used up", "r1"): (5, "unavailable", "HTTP 5")}
    # A copy of an attempt says nothing new.
    assert ("silent", "r1") in run(rows[3:4], hour(30))
    assert run([], hour(31)) == {
        ("used up", "r1"): (5, "unavailable", "HTTP 5"), ("answered", "r1"): (2, "ok", ""), ("answered", "r2"): (1, "rejected", "HTTP 404"),
        ("silent", "r1"): (1, "unavailable", "none"), ("no run", ""): (1, "ok", ""),
    }


def test_many_requests_are_few_states(spark, tmp_path):
    draw = random.Random(2)
    landing, rows = str(tmp_path / "landing"), []
    for i in range(400):
        for attempt in range(1, draw.randint(1, 5) + 1):
            outcome = draw.choice(["ok", "rejected", "retryable"])
            rows.append(("v", None if i % 7 == 0 else "/k", f"q{i}", "r", START + timedelta(minutes=i + attempt), attempt, outcome, f"{outcome} {attempt}"))
    draw.shuffle(rows)
    for some, poll in ((rows[:500], 6), (rows[500:], 10), ([], 40)):
        live_bars.land(spark.createDataFrame(some, ATTEMPTS), at(START + timedelta(hours=poll)), landing, "requested_at")
        stream = live_bars.landed_prints(spark, spark.createDataFrame([], ATTEMPTS).schema, landing)
        finals = requests.final_outcomes(stream, "12 hours", 20 * 3600, buckets=8)
        query = finals.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "finals"))
        query.awaitTermination()
        assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) <= 8
    decided = {}
    for _, _, params, _, _, attempt, outcome, detail in rows:
        rank = ({"ok": 2, "rejected": 1}.get(outcome, 0), attempt)
        most, best, text = decided.get(params, (0, (0, 0), ""))
        decided[params] = (max(most, attempt), *max((best, text), (rank, detail)))
    names = {2: "ok", 1: "rejected", 0: "unavailable"}
    found = spark.read.parquet(str(tmp_path / "finals")).collect()
    assert sorted((r["params"], r["attempts"], r["final_outcome"], r["detail"]) for r in found) == sorted(
        (params, most, names[best[0]], text) for params, (most, best, text) in decided.items()
    )


def test_a_backlog_is_taken_in_by_bounded_batches(spark, tmp_path):
    landing, seen = str(tmp_path / "landing"), []
    for i in range(5):
        spark.range(i, i + 1).coalesce(1).write.mode("append").parquet(landing)

    class Store:
        def write(self, some):
            seen.append(some.count())

    schema = spark.range(0).schema
    ingest.ingest_available(ingest.landed_bars(spark, schema, landing, files_per_batch=2), Store(), str(tmp_path / "check"))
    assert [n for n in seen if n] == [2, 2, 1]
