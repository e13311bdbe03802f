"""Fitted searches, kept under a fingerprint of data and parameters (ML10, SRC4, SNK2).

A grid search costs a dozen fits. ``tuned`` makes it once for a user matrix
and a set of parameters and stores the fitted search with its metrics (SNK2);
every later caller, also of another session on the same folder, loads it
(SRC4). The fingerprint is an order-free hash over all rows and columns of
the matrix together with the parameters, so other data, another grid or seed
is another entry and nothing stale is ever loaded.

An entry counts once its marker is committed. Two callers that fit the same
entry at once write the same model: fits are seeded and folds come from a
hash of the user.
"""

from __future__ import annotations

import hashlib
import json

import pyspark
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlab.plans import model as ML
from churnlab.session import ensure_checkpoint_dir
from churnlab.sources.sinks import load_cv_model


def fingerprint(matrix: DataFrame, **parameters: object) -> str:
    """A name for these rows, in any order, and these parameters."""
    h = F.xxhash64(*sorted(matrix.columns))
    row = matrix.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum((h % 1_000_003).cast("decimal(20,0)"))).first()
    said = json.dumps([[str(v) for v in row], sorted(matrix.columns), sorted(parameters.items()), pyspark.__version__], default=str)
    return hashlib.sha256(said.encode()).hexdigest()[:24]


def registry_folder(spark: SparkSession) -> str:
    """The default folder: below the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/churnlab-models"


def _committed(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_done/_SUCCESS")
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def tuned(
    matrix: DataFrame,
    prepared: ML.Prepared,
    preset: str = "notebook",
    metric: str = "f1",
    seed: int = ML.SEED,
    folder: str | None = None,
    **how: object,
) -> CrossValidatorModel:
    """ML10: the fitted search of ``preset`` on ``prepared``, which was made from ``matrix``.

    ``how``: further arguments that ``prepared`` was made with (``fit_on``,
    ``stratified``, ...); they are part of the entry's name.
    """
    spark = matrix.sparkSession
    name = fingerprint(matrix, preset=preset, grid=ML.GRID_PRESETS[preset], metric=metric, seed=seed, **how)
    path = f"{(folder or registry_folder(spark)).rstrip('/')}/{name}"
    if not _committed(spark, path):
        found = ML.tune(prepared, preset=preset, metric=metric, seed=seed)
        found.write().overwrite().save(f"{path}/model")
        metrics = ML.evaluate(ML.predict(found, prepared.test))
        row = {"model": type(found).__name__, "accuracy": float(metrics["accuracy"]), "f1": float(metrics["f1"])}
        spark.createDataFrame([row]).coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
        spark.range(1).write.mode("overwrite").parquet(f"{path}/_done")
    return load_cv_model(path)
