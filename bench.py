"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then three times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from opsframe.plans.catalog import builds  # noqa: E402
from opsframe.session import build_session  # noqa: E402

HEADLINE = (
    "metric_rate_hourly", "metric_rate_5m", "metric_irate", "metric_gauge", "metric_query_range",
    "metric_export", "span_table", "span_dedupe", "trace_of_service", "log_flatten", "log_normalize",
    "log_volume_two_weeks", "log_first_per_day", "line_split", "line_blocks", "line_compress",
    "line_compress_multi", "session_usage", "history_trim", "action_extract", "action_solution",
    "score_localization", "session_evaluate", "score_mitigation", "gpu_job_details",
    "gpu_usage_capacity", "gpu_plan_vs_actual", "gpu_job_shape", "stream_compress",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = builds()
    times = {}
    for name in chosen:
        taken = []
        for _ in range(4):
            began = time.perf_counter()
            run[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        times[name] = round(statistics.median(taken[1:]), 4)
    print(
        json.dumps({
            "metric": "headline_total",
            "value": round(sum(times.values()), 3),
            "unit": "sec",
            "queries": times,
            "sf": os.path.basename(sf_dir).removeprefix("sf"),
        })
    )
    spark.stop()


if __name__ == "__main__":
    main()
