"""Result sinks and model persistence (SNK1, SNK2, SRC4).

Paths are caller-given and should name shared storage on a cluster;
nothing here writes to a machine-local folder of its own choosing.
"""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", single_file: bool = False, partition_by: list[str] | None = None) -> str:
    """SNK1: write a result (the user matrix) as JSON / parquet / csv.

    ``mode='errorifexists'`` fails when the target exists, as the
    reference's ``save`` did. ``single_file`` coalesces to one partition -
    only sensible for small results such as a user matrix.
    """
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def land_events_by_date(events: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Write an event log partitioned by its UTC ``date`` (derived from ``ts``).

    Later reads that filter on ``date`` prune whole folders at planning
    time (``PartitionFilters``). The ``rebalance`` hint clusters rows by
    date so each task writes few folders, and lets adaptive execution
    split a skewed date (or merge small ones) instead of writing one busy
    day from a single task.
    """
    from churnlab.functions import event_date

    dated = events.withColumn("date", event_date("ts")).hint("rebalance", "date")
    dated.write.mode(mode).partitionBy("date").parquet(path)
    return path


def model_path(base_dir: str, model, accuracy: float, f1: float, now: _dt.datetime | None = None) -> str:
    """SNK2 path: ``<base>/<epoch seconds>_<model>_Acc_<acc>_F1_<f1>``."""
    stamp = (now or _dt.datetime.now(_dt.timezone.utc)).timestamp()
    name = f"{stamp}_{type(model).__name__}_Acc_{round(accuracy, 3)}_F1_{round(f1, 3)}"
    return f"{base_dir.rstrip('/')}/{name}"


def save_model(spark: SparkSession, model, base_dir: str, accuracy: float, f1: float, now: _dt.datetime | None = None) -> str:
    """SNK2: save a fitted model plus a one-row metrics file next to it."""
    path = model_path(base_dir, model, accuracy, f1, now)
    model.write().overwrite().save(f"{path}/model")
    metrics = {"model": type(model).__name__, "accuracy": float(accuracy), "f1": float(f1)}
    spark.createDataFrame([metrics]).coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    return path


def load_cv_model(path: str) -> CrossValidatorModel:
    """SRC4: load a saved cross-validated model for scoring."""
    return CrossValidatorModel.load(f"{path.rstrip('/')}/model")


def read_metrics(spark: SparkSession, path: str) -> dict:
    """The metrics row saved with a model."""
    row = spark.read.json(f"{path.rstrip('/')}/metrics").first()
    return json.loads(json.dumps(row.asDict())) if row else {}
