"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8) the local cores.
Each query runs whole into a sink that keeps nothing; the build of its plan counts too.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from perfsieve.plans.queries import queries
from perfsieve.session import build_session

HEADLINE = [
    "alert_summary",
    "agg_numeric_stats",
    "agg_mode",
    "join_bug_priority",
    "push_gap",
    "time_split_80_20",
    "stratified_folds",
    "backfill_stats",
    "quantile_edges",
    "row_to_text",
    "sanitize_text",
    "onehot_tags",
    "token_length_profile",
    "resolve_series",
    "asof_anchor",
    "ts_window_features",
    "ts_rollup",
    "embed_notes",
    "average_precision",
    "pr_curve",
]


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    registered["calendar_features"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in names or HEADLINE:
        runs = []
        for _ in range(repeats):
            start = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs), 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
