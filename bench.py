"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is planned and written in full to the no-op sink, once to warm up and then
$BENCH_RUNS times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import QUERIES  # noqa: E402
from sightline.session import build_session  # noqa: E402

HEADLINE = [
    "site_stats", "asof_price", "interval_join_direct", "mentions_company", "supersede_same_day",
    "correlate", "list_companies", "timeline", "build_graph", "graph_neighborhood",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = sys.argv[1:] or HEADLINE
    conf = {
        "spark.sql.shuffle.partitions": str(2 * int(cpus)),
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.ui.enabled": "false",
    }
    spark = build_session("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for key in wanted:
        taken = []
        for _ in range(runs + 1):
            started = time.time()
            QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.time() - started)
        times[key] = round(statistics.median(taken[1:]), 3)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": scale}))


if __name__ == "__main__":
    main()
