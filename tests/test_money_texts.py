"""Price texts at the edges, beside the query's SQL."""

from __future__ import annotations

from datetime import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as driver


def test_minus_nothing_is_not_below_zero(spark, tmp_path):
    values = [0.0, 0.004, 12.5, -5.0, None, 3e12]
    rows = [(i * 1001 + remainder, value) for i, value in enumerate(values) for remainder in (1, 7, 11, 13, 26)]
    events = pa.table(
        {
            "event_id": pa.array([r[0] for r in rows], pa.int64()),
            "ts": pa.array([datetime(2024, 1, 1)] * len(rows), pa.timestamp("us")),
            "user_id": pa.array([1] * len(rows), pa.int64()),
            "event_type": ["view"] * len(rows),
            "value": pa.array([r[1] for r in rows], pa.float64()),
            "props": ["{}"] * len(rows),
        }
    )
    pq.write_table(events, tmp_path / "events.parquet")
    ours = driver.queries()["flt_5_money_checks"](spark, str(tmp_path)).collect()
    connection = duckdb.connect()
    connection.register("events", events)
    theirs = connection.execute(driver.oracle_sql()["flt_5_money_checks"]).fetchall()
    assert sorted(tuple(r) for r in ours) == sorted(theirs)
    assert {r["reason"]: r["rows"] for r in ours} == {"not a finite decimal": 20, "below zero": 3, "ok": 7}
