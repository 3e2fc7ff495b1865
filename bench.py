"""Times the headline queries and prints one JSON line.

Data comes from $BENCH_SF_DIR, cores from $BENCH_CPUS. Every query runs once to warm
up and then three times; the best time counts. Batch results go to Spark's ``noop``
sink; streaming queries include their whole run. The slices that streams get their input in
are written once, and timed apart as ``replay_seconds``, which is no part of the total.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time

from panewise import build_session
from panewise.plans import all_queries
from panewise.plans.outputs import replayed_events

HEADLINE = (
    "filter_chain",
    "agg_sum_min_max_avg_count",
    "agg_int_types",
    "batch_count",
    "window_rows_sliding",
    "window_agg_sliding",
    "window_agg_panes",
    "window_agg_panes_day",
    "join_single",
    "join_multi_key",
    "join_three_way",
    "join_left",
    "join_full",
    "window_join_equal",
    "window_join_panes_equal",
    "window_join_asym",
    "window_join_panes_asym",
    "join_selectivity",
    "join_edge_ranking",
    "window_selectivity",
    "parse_delimited",
    "parse_rejected_count",
    "normalise_address",
    "count_slices_arrival",
    "stream_window_agg",
    "stream_window_panes",
    "stream_join",
    "stream_window_join",
)
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "panewise-bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="run-", dir="/tmp"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter()
    replayed_events(spark, folder)
    replay = time.perf_counter() - start
    queries, times = all_queries(), {}
    for name in HEADLINE:
        seconds = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
        times[name] = round(min(seconds[1:]), 3)
    spark.stop()
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else folder,
                "replay_seconds": round(replay, 3),
            }
        )
    )


if __name__ == "__main__":
    main()
