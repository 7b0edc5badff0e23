"""Time the headline queries at one scale and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.session import build_session  # noqa: E402
from tidemark.workloads import catalog  # noqa: E402

HEADLINE = (
    "pol_7_monthly_table",
    "pol_9_two_refresh_buffer",
    "rul_3_median_quote_volume",
    "jn_1_window_join",
    "jn_2_asof_join",
    "win_1_trailing_window",
    "win_2_ordered_history",
    "win_4_rank_and_score",
    "cal_7_survivorship_loss",
    "src_1_parse_klines",
    "src_3_parse_ohlc",
    "src_4_parse_symbol_metadata",
    "src_16_bars_from_prints",
    "agg_8_final_outcome",
    "agg_12_equity_identity",
    "udx_2_two_venue_models",
    "set_1_entitlements",
    "flt_7_typed_payloads",
    "flt_16_redaction",
    "str_2_closed_bars_stream",
)


def run(query, spark, sf_dir: str) -> None:
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = catalog.queries()
    # One unmeasured run, so that no query pays for starting the JVM's compilers.
    run(registered[HEADLINE[0]], spark, sf_dir)
    timings: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        run(registered[name], spark, sf_dir)
        timings[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
