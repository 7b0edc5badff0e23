"""Run registered queries and their SQL counterparts, and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def plain(value):
    if isinstance(value, Decimal):
        return ("decimal", str(value))
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(item) for item in value)
    return value


#: Operators that pair every row with every other, or run row-at-a-time Python.
UNSCALABLE = (
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "BatchEvalPython",
    "ArrowEvalPython",
    "MapInPandas",
)


#: A whole table in one task; only the last step of a global total may do that.
ONE_TASK = "SinglePartition"
GLOBAL_TOTALS = {"cal_3_known_missing", "pol_8_policy_rules"}


def unscalable_operators(name: str, frame) -> list[str]:
    plan = frame._jdf.queryExecution().executedPlan().toString()
    banned = UNSCALABLE if name in GLOBAL_TOTALS else (*UNSCALABLE, ONE_TASK)
    return [operator for operator in banned if operator in plan]


def difference(frame, sf_dir: str, sql: str, allow_empty: bool = False) -> str | None:
    """None when both sides give the same columns and the same rows."""
    order = sorted(frame.columns)
    ours = [tuple(plain(row[name]) for name in order) for row in frame.collect()]
    cursor = connect(sf_dir).execute(sql)
    names = [item[0] for item in cursor.description]
    if sorted(names) != order:
        return f"columns differ: spark {order}, sql {sorted(names)}"
    places = [names.index(name) for name in order]
    theirs = [tuple(plain(row[at]) for at in places) for row in cursor.fetchall()]
    only_ours = Counter(ours) - Counter(theirs)
    only_theirs = Counter(theirs) - Counter(ours)
    if not ours and not allow_empty:
        return "no rows"
    if only_ours or only_theirs:
        return (
            f"{order}: {len(ours)} rows against {len(theirs)}; only spark "
            f"{list(only_ours)[:2]}; only sql {list(only_theirs)[:2]}"
        )
    return None


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as driver
    from tidemark.session import build_session

    spark = build_session(
        "sidebyside",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, wanted = argv[1], argv[2:]
    queries, oracles = driver.queries(), driver.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if wanted and not any(name.startswith(prefix) for prefix in wanted):
            continue
        started = time.time()
        try:
            frame = run(spark, sf_dir)
            unscalable = unscalable_operators(name, frame)
            if name in oracles:
                verdict = difference(frame, sf_dir, oracles[name])
            else:
                verdict = None if frame.count() else "no rows"
                name += " (rows only)"
            if unscalable:
                verdict = f"{verdict or ''} plan has {unscalable}"
        except Exception as error:  # noqa: BLE001 - every failure is reported
            verdict = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += verdict is not None
        print(f"{'ok ' if verdict is None else 'BAD'} {time.time() - started:6.2f}s {name} {verdict or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv))
