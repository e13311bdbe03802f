"""Benchmark: run the registered queries on $BENCH_SF_DIR and print one JSON line.

Each query is executed in full through Spark's ``noop`` sink (the whole
plan runs, nothing is collected to the driver). One untimed warm-up query
runs first so JVM start-up and code loading are not charged to a query.

    BENCH_SF_DIR   default /root/testdata/sf0.1
    BENCH_CPUS     default 8       (local[N])
    BENCH_QUERIES  optional comma-separated subset
    BENCH_REPEAT   default 1       (best of N per query)
    BENCH_MEM      default 4g      (driver memory; local mode runs in the driver)
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from churnlab.plans.catalog import NO_ORACLE, QUERIES, TRAINING  # noqa: E402
from churnlab.session import local_session  # noqa: E402

# Model training runs are benchmarked separately (they are iterative and
# dominated by MLlib); streaming queries write files by design.
SKIP = set(NO_ORACLE) | TRAINING


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = [n for n in QUERIES if n not in SKIP]
    if chosen:
        names = [n for n in chosen.split(",") if n in QUERIES]

    spark = local_session(cpus, shuffle_partitions=max(8, cpus), driver_memory=os.environ.get("BENCH_MEM", "4g"))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["agg1_page_visits"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up

    # a plain scan of the events, to compare runs on machines of other speed
    t0 = time.perf_counter()
    spark.read.parquet(f"{sf_dir}/events.parquet").write.format("noop").mode("overwrite").save()
    calibration = time.perf_counter() - t0

    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else sf_dir,
                "cpus": cpus,
                "n_queries": len(times),
                "calibration_scan": round(calibration, 3),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
