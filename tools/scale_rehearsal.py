"""Scale rehearsal: the driver's tables replicated N times, plus a hot user.

    python tools/scale_rehearsal.py [SF_DIR] [FACTOR] [HOT_SHARE]

Builds, with Spark, a folder of the same four tables the adapter reads:
events copied FACTOR times with shifted user and event ids, and one user's
events copied again (with shifted times) until that user holds HOT_SHARE
of all events. Then runs key queries with the event log on and reports
wall time and the largest single task per stage. Data goes to a fresh
scratch folder and is not kept in the repository.
"""

from __future__ import annotations

import glob
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from churnlab.plans.catalog import QUERIES  # noqa: E402
from tools.stage_report import summarize  # noqa: E402

QUERIES_TO_RUN = ["jn4_user_matrix", "jn1_enriched_events", "win4_filled_running_listens", "agg7_session_totals"]


def build(spark: SparkSession, src: str, dst: str, factor: int, hot_share: float) -> dict:
    ev = spark.read.parquet(f"{src}/events.parquet")
    cust = spark.read.parquet(f"{src}/customer.parquet")
    n_users = cust.count()
    id_span = ev.agg(F.max("event_id")).first()[0] + 1
    rep = ev.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    big = rep.select(
        (F.col("event_id") + F.col("r").cast("long") * F.lit(id_span).cast("long")).alias("event_id"),
        "ts",
        (F.col("user_id") + F.col("r").cast("long") * F.lit(n_users).cast("long")).alias("user_id"),
        "event_type",
        "value",
        "props",
    )
    total = ev.count() * factor
    hot = ev.where(F.col("user_id") == 0)
    n_hot = hot.count()
    copies = max(1, int(hot_share * total / max(1, (1 - hot_share) * n_hot)))
    hot_big = hot.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(copies)))).select(
        (F.col("event_id") + (F.col("k").cast("long") + factor) * F.lit(id_span).cast("long")).alias("event_id"),
        (F.col("ts") + F.make_interval(secs=F.col("k").cast("decimal(18,6)") / 1000)).alias("ts"),
        "user_id",
        "event_type",
        "value",
        "props",
    )
    big.unionByName(hot_big).repartition(64).write.parquet(f"{dst}/events.parquet")
    crep = cust.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    crep.withColumn("c_custkey", F.col("c_custkey") + F.col("r") * n_users).drop("r").write.parquet(f"{dst}/customer.parquet")
    for t in ("nation", "region"):
        spark.read.parquet(f"{src}/{t}.parquet").write.parquet(f"{dst}/{t}.parquet")
    n = spark.read.parquet(f"{dst}/events.parquet").count()
    h = spark.read.parquet(f"{dst}/events.parquet").where("user_id = 0").count()
    return {"events": n, "hot_user_events": h, "hot_share": round(h / n, 3)}


def main() -> None:
    src = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    factor = int(sys.argv[2]) if len(sys.argv) > 2 else 100
    hot_share = float(sys.argv[3]) if len(sys.argv) > 3 else 0.3
    scratch = tempfile.mkdtemp(prefix="churnlab-scale-")
    log_dir = f"{scratch}/eventlog"
    Path(log_dir).mkdir()
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "64")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", log_dir)
        .config("spark.eventLog.compress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.setCheckpointDir(f"{scratch}/checkpoints")
    info = build(spark, src, f"{scratch}/data", factor, hot_share)
    print("data", info, flush=True)
    times = {}
    for name in QUERIES_TO_RUN:
        t0 = time.perf_counter()
        QUERIES[name](spark, f"{scratch}/data").write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 1)
        print(name, times[name], "s", flush=True)
    # The same data as a canonical event log (what a real log looks like:
    # sessionId and gender already present), written once, then the
    # operators alone on it.
    from churnlab.operators.events import drop_blank_users
    from churnlab.operators.listens import enriched_events
    from churnlab.operators.matrix import user_matrix
    from churnlab.sources.events import load_events

    load_events(spark, f"{scratch}/data").write.parquet(f"{scratch}/canonical")
    log = drop_blank_users(spark.read.parquet(f"{scratch}/canonical"))
    for label, build_df in (("user_matrix on canonical log", lambda: user_matrix(log)),
                            ("enriched_events on canonical log", lambda: enriched_events(log))):
        t0 = time.perf_counter()
        build_df().write.format("noop").mode("overwrite").save()
        print(label, round(time.perf_counter() - t0, 1), "s", flush=True)
    spark.stop()
    stages = summarize(sorted(glob.glob(f"{log_dir}/*"))[0])
    worst = sorted(stages, key=lambda s: -s.get("max_task_rows", 0))[:8]
    print("largest single tasks (rows read by one task, total rows of its stage):")
    for s in worst:
        total = s.get("input_rows", 0) + s.get("shuffle_rows_read", 0)
        print(f"  stage {s['stage']:>4}: {s.get('max_task_rows', 0):>10} of {total:>10} rows, {s.get('tasks', 0)} tasks, {s.get('ms', 0)} ms")


if __name__ == "__main__":
    main()
