"""The end-to-end batch job: event log -> user matrix -> tuned GBT -> saved results.

    python -m churnlab.plans.job <mini|full> --mini PATH --full PATH --out DIR
                                 [--format json|parquet] [--grid notebook|script]

Steps: read the log with a fixed schema (SRC1, SRC2), drop blank users,
build the user matrix (JN4), checkpoint it once to the session's
checkpoint folder, split by a hash of userId, fit preparation on the
training users, tune a GBT by 3-fold cross-validation, score the test
users, save the model with its metrics (SNK2) and the matrix (SNK1).
"""

from __future__ import annotations

import argparse
import datetime as dt
import json

from pyspark.sql import SparkSession

from churnlab.operators.events import drop_blank_users
from churnlab.operators.matrix import user_matrix
from churnlab.plans import model as ML
from churnlab.sources.events import choose_event_path, read_json_events, to_events
from churnlab.sources.sinks import save_model, write_table


def run(
    spark: SparkSession,
    events_path: str,
    out_dir: str,
    fmt: str = "json",
    grid: str = "script",
    metric: str = "f1",
    fit_on: str = "train",
    single_file: bool = False,
) -> dict:
    """Run the whole job; returns test metrics and the output paths."""
    raw = read_json_events(spark, events_path) if fmt == "json" else spark.read.parquet(events_path)
    # one scan of the log; the finished matrix is written once for the many fits
    matrix = ML.materialized(user_matrix(drop_blank_users(to_events(raw))))
    prepared = ML.prepare(matrix, fit_on=fit_on, materialize=False)
    cv = ML.tune(prepared, preset=grid, metric=metric)
    metrics = ML.evaluate(ML.predict(cv, prepared.test))
    now = dt.datetime.now(dt.timezone.utc)
    model_dir = save_model(spark, cv, f"{out_dir.rstrip('/')}/models", metrics["accuracy"], metrics["f1"], now)
    matrix_dir = f"{out_dir.rstrip('/')}/user_matrix/{now.timestamp()}"
    write_table(matrix, matrix_dir, fmt="json", single_file=single_file)
    return {
        "accuracy": float(metrics["accuracy"]),
        "f1": float(metrics["f1"]),
        "model_path": model_dir,
        "matrix_path": matrix_dir,
    }


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="churn features and model job")
    p.add_argument("size", nargs="?", help="'mini' for the small log, anything else for the full log")
    p.add_argument("--mini", required=True)
    p.add_argument("--full", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--format", default="json", choices=["json", "parquet"])
    p.add_argument("--grid", default="script", choices=sorted(ML.GRID_PRESETS))
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("churnlab-job").config("spark.ui.enabled", "false").getOrCreate()
    try:
        path = choose_event_path(args.size, args.mini, args.full)
        print(json.dumps(run(spark, path, args.out, fmt=args.format, grid=args.grid)))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
