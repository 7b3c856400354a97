"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of the tables.  BENCH_CPUS: local threads.  Each query is
run once to warm up and then BENCH_RUNS times; the median counts, over a sink
that takes every row and keeps none.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

HEADLINE = (
    "tpch_q01", "tpch_q03", "tpch_q05", "tpch_q06", "tpch_q07", "tpch_q09", "tpch_q13", "tpch_q17", "tpch_q18", "tpch_q21", "tpch_q22",
    "join_inner", "join_full", "join_left_anti", "join_full_residual", "four_way_join", "skewed_join",
    "strategy_auto", "strategy_shuffle_hash", "strategy_sort_merge", "strategy_broadcast", "sort_multi_key", "window_rank",
)


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from sparkloom import queries
    from sparkloom.session import EngineConfig, build_session

    config = EngineConfig(partitions=int(cpus), master=f"local[{cpus}]", settings={"spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark = build_session(config)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        took = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            queries.QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(median(took[1:]), 4)
    spark.stop()
    sf = os.path.basename(path.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
