"""Time the headline queries; prints one JSON line.

$BENCH_SF_DIR (default /root/testdata/sf0.1), $BENCH_CPUS (default all), $BENCH_QUERIES (comma list, "all").
Each query runs once to warm up and once timed, into Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from marketspark.catalog import QUERIES
from marketspark.session import build_session

HEADLINE = [
    "a20_build_candles",
    "p7_ohlcv_result",
    "f12_chart_rows",
    "t1_newest",
    "s10_last_bars",
    "w12_keep_last",
    "w14_gaps",
    "a14_duplicates",
    "a17_quality",
    "w1_ema",
    "w3_atr",
    "w4_sma",
    "w9_rolling_features",
    "w10_newest_features",
    "a2_buckets_1h",
    "a4_calendar_week",
    "a6_spearman",
    "w5_trend",
    "w7_training_set",
    "w8_anomalies",
    "j1_rules_with_quotes",
    "j2_fallback_price",
    "j4_fresh_price",
    "x5b_alert_replay",
    "x5_stateful_alerts",
    "x1_ingest",
    "m1_standardise",
    "m4a_core_distance",
    "j8_nearest_centroid",
    "v2_fallback",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    partitions = str(os.cpu_count() if cpus == "*" else int(cpus))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=partitions,
        spark__ui__enabled="false",
        spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {took[name]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
