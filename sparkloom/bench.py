"""Benchmark command: times SQL files or named queries, and writes results.

``python -m sparkloom.bench --data-path DIR [--query-path DIR | named queries]``
writes ``results.json`` (all iterations), ``summary.csv``, and for each query
its rows as CSV and its logical plan.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
import traceback
from pathlib import Path
from statistics import median

from pyspark.sql import DataFrame, SparkSession

from . import queries as named
from .functions import sqltext
from .operators.joins import STRATEGIES
from .plans import introspect
from .session import EngineConfig, build_session, read_settings
from .sources import catalog, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkloom.bench", description=__doc__)
    p.add_argument("--data-path", required=True, help="folder of <table>.parquet files or folders")
    p.add_argument("--query-path", help="folder of q<number>.sql files; without it the named queries run")
    p.add_argument("--output", help="folder for results")
    p.add_argument("--config-path", help="file of key=value session settings")
    p.add_argument("--query", help="one query: a number with --query-path, else a name; its failure ends the run")
    p.add_argument("--num-queries", type=int, default=22, help="how many SQL files there are")
    p.add_argument("--exclude", action="append", default=[], help="a query to leave out; may be repeated")
    p.add_argument("--concurrency", type=int, help="shuffle partitions, and local threads where no master is set")
    p.add_argument("--iterations", type=int, default=3)
    p.add_argument("--strategy", choices=sorted(STRATEGIES), default="auto", help="join strategy that the planner is led to")
    p.add_argument("--from-memory", action="store_true", help="load the tables into memory first")
    p.add_argument("--memory-partitions", type=int)
    p.add_argument("--print-plan", action="store_true")
    p.add_argument("--debug", action="store_true", help="print tracebacks of failed queries")
    return p


def strategy_settings(strategy: str) -> dict[str, str]:
    """Session settings that lead the planner to one join strategy for whole SQL files, where hints can't reach."""
    return {
        "shuffle_hash": {"spark.sql.join.preferSortMergeJoin": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "1g"},
        "sort_merge": {"spark.sql.join.preferSortMergeJoin": "true", "spark.sql.autoBroadcastJoinThreshold": "-1"},
        "broadcast": {"spark.sql.autoBroadcastJoinThreshold": "1g"},
    }.get(strategy, {})


def timed(build, iterations: int, after=None) -> list[float]:
    """Milliseconds of planning and collecting, for each iteration; ``after`` gets the frames of the first."""
    out = []
    for i in range(iterations):
        began = time.perf_counter()
        frames: list[DataFrame] = build()
        for f in frames:
            f.collect()
        out.append((time.perf_counter() - began) * 1000)
        if i == 0 and after:
            after(frames)
    return out


def run(args: argparse.Namespace, spark: SparkSession) -> list[dict]:
    out = Path(args.output) if args.output else None
    if out:
        out.mkdir(parents=True, exist_ok=True)
    tables = catalog.register_dir(spark, args.data_path)
    if args.from_memory:
        for t in tables:
            catalog.load_to_memory(spark.table(t), args.memory_partitions).createOrReplaceTempView(t)
    if args.query_path:
        names = [args.query] if args.query else [str(i) for i in range(1, args.num_queries + 1)]
        read = lambda n: (lambda: sqltext.run_script(spark, (Path(args.query_path) / f"q{n}.sql").read_text()))
    else:
        names = [args.query] if args.query else list(named.QUERIES)
        read = lambda n: (lambda: [named.QUERIES[n](spark, args.data_path)])
    results = []
    for n in [n for n in names if n not in args.exclude]:

        def keep(frames: list[DataFrame], n=n) -> None:
            for i, f in enumerate(frames):
                stem = f"{n}_part_{i}" if len(frames) > 1 else n
                if args.print_plan:
                    print(introspect.physical_plan(f))
                if out:
                    sinks.write_plan(f, str(out / f"{stem}.plan.txt"))
                    sinks.write_csv(f, str(out / f"{stem}.csv"))

        try:
            ms = timed(read(n), args.iterations, keep)
        except Exception as e:
            if args.query:
                raise
            print(f"{n}: failed: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
            if args.debug:
                traceback.print_exc()
            continue
        results.append({"query": n, "first_ms": ms[0], "median_ms": median(ms), "iterations_ms": ms})
        print(f"{n}: first {ms[0]:.0f} ms, median {median(ms):.0f} ms")
    if out:
        sinks.write_json({"strategy": args.strategy, "data_path": args.data_path, "results": results}, str(out / "results.json"))
        sinks.write_summary([{k: r[k] for k in ("query", "first_ms", "median_ms")} for r in results], str(out / "summary.csv"))
    return results


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    settings = (read_settings(args.config_path) if args.config_path else {}) | strategy_settings(args.strategy)
    master = f"local[{args.concurrency}]" if args.concurrency and "spark.master" not in settings else None
    spark = build_session(EngineConfig(partitions=args.concurrency, master=master, settings=settings))
    results = run(args, spark)
    print(json.dumps({r["query"]: round(r["median_ms"], 1) for r in results}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
