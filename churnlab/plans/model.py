"""Model preparation, training, tuning and evaluation (ML1-ML14, EXT3).

Everything is Spark MLlib and runs distributed. Differences from the

* the train/test split and the cross-validation folds come from a hash
  of ``userId``, not from ``randomSplit``/``rand``, so they do not depend
  on partition layout;
* the indexer and scaler are fitted on the training users only
  (``fit_on="all"`` reproduces the reference's leak);
* every tree estimator gets an explicit seed;
* the tuning metric is an argument (default ``f1``, the evaluator's default).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from churnlab.functions import hash_percent
from churnlab.operators.selection import hash_key, order_statistics
from churnlab.schema import FEATURE_COLUMNS
from churnlab.session import ensure_checkpoint_dir

SEED = 42
TRAIN_PERCENT = 80
#: Training users in a task of a search.
ROWS_PER_TASK = 20_000

# The reference's tuning grids (maxDepth x maxBins).
GRID_PRESETS = {
    "notebook": {"maxDepth": [3, 5], "maxBins": [16, 32]},
    "script": {"maxDepth": [3, 5, 7], "maxBins": [16, 32, 64]},
}


# ------------------------------------------------------------------ ML1-ML4
def gender_indexer() -> StringIndexer:
    """ML1: gender -> index by descending frequency; unseen / null -> last index."""
    return StringIndexer(inputCol="gender", outputCol="gender_indexed", handleInvalid="keep")


def index_gender(matrix: DataFrame) -> DataFrame:
    """ML1 as a frame: ``(userId, gender, gender_indexed)``, fitted on all users."""
    return gender_indexer().fit(matrix).transform(matrix).select("userId", "gender", "gender_indexed")


def assembler(features: Sequence[str] = FEATURE_COLUMNS) -> VectorAssembler:
    """ML2: the 16 feature columns -> one vector; a null is an error."""
    return VectorAssembler(inputCols=list(features), outputCol="raw_features", handleInvalid="error")


def scaler() -> StandardScaler:
    """ML3: standardise to mean 0, standard deviation 1 (constant column -> 0)."""
    return StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)


def preparation() -> Pipeline:
    """ML1-ML3 as one MLlib Pipeline (index, assemble, scale)."""
    return Pipeline(stages=[gender_indexer(), assembler(), scaler()])


def with_split(matrix: DataFrame, train_percent: int = TRAIN_PERCENT, stratified: bool = False) -> DataFrame:
    """ML4: ``split`` = 'train' / 'test' from a hash of userId (Q13).

    The plain split is stratified in expectation (the hash does not see the
    label). ``stratified=True`` splits each churn class at its own exact
    quantile of a 60-bit userId hash: the first ``train_percent`` percent of
    a class's users (rounded up) in the order of the hash train. The quantile
    comes from counted hash ranges, so no class is ever sorted or ranked
    inside a single task.
    """
    if not stratified:
        return matrix.withColumn(
            "split", F.when(hash_percent("userId") < train_percent, F.lit("train")).otherwise(F.lit("test"))
        )
    keys = materialized(matrix.select("churn", hash_key("userId").alias("_h")))
    cuts = order_statistics(keys, ["churn"], "_h", lambda n: F.floor((n * train_percent + 99) / 100))
    cuts = cuts.select(F.col("churn").alias("_class"), F.col("value").alias("_cut"))
    joined = matrix.join(cuts, F.col("churn").eqNullSafe(F.col("_class")), "left")
    trains = hash_key("userId") <= F.col("_cut")
    return joined.withColumn("split", F.when(trains, F.lit("train")).otherwise(F.lit("test"))).drop("_class", "_cut")


def scaled_features_long(matrix: DataFrame) -> DataFrame:
    """ML3 as a frame: ``(userId, feature, value)`` with the scaler fitted on all users."""
    prepared = preparation().fit(matrix).transform(matrix)
    names = F.array(*[F.lit(n) for n in FEATURE_COLUMNS])
    return prepared.select(
        "userId", F.posexplode(vector_to_array("features")).alias("i", "value")
    ).select("userId", F.element_at(names, F.col("i") + 1).alias("feature"), "value")


@dataclass
class Prepared:
    """Model-ready frames: ``userId, features, label`` (+ ``fold``)."""

    model: PipelineModel
    train: DataFrame
    test: DataFrame


def materialized(matrix: DataFrame) -> DataFrame:
    """Write the user matrix to the session's checkpoint folder and cut its lineage.

    Model fitting reads the matrix a dozen times or more (folds x grid);
    a reliable checkpoint keeps those reads off the event-level plan and
    survives the loss of executors, unlike an executor-local cache.
    """
    ensure_checkpoint_dir(matrix.sparkSession)
    return matrix.checkpoint(eager=True)


def prepare(
    matrix: DataFrame,
    fit_on: str = "train",
    folds: int = 3,
    train_percent: int = TRAIN_PERCENT,
    materialize: bool = True,
    stratified: bool = False,
) -> Prepared:
    """Split users, fit index + assemble + scale, return train and test frames.

    ``fit_on="train"`` (default) fits the preparation on training users
    only; ``"all"`` fits on every user as the reference did.
    """
    if materialize:
        matrix = materialized(matrix)
    split = with_split(matrix, train_percent, stratified)
    train_users = split.where(F.col("split") == "train")
    model = preparation().fit(train_users if fit_on == "train" else split)

    def frame(df: DataFrame) -> DataFrame:
        return model.transform(df).select(
            "userId",
            "features",
            F.col("churn").cast("double").alias("label"),
            F.pmod(hash_percent(F.concat(F.col("userId"), F.lit("#fold"))), F.lit(folds)).alias("fold"),
        )

    return Prepared(model, frame(train_users), frame(split.where(F.col("split") == "test")))


# ------------------------------------------------------------------ ML5-ML7
def estimators(seed: int = SEED) -> dict[str, object]:
    """ML5-ML7: the three classifiers compared by the reference."""
    return {
        "LogisticRegression": LogisticRegression(maxIter=30),
        "GBTClassifier": GBTClassifier(seed=seed),
        "RandomForestClassifier": RandomForestClassifier(seed=seed),
    }


# ------------------------------------------------------------------ ML12
def evaluate(predictions: DataFrame) -> dict[str, float]:
    """ML12: accuracy and weighted F1 with Spark's evaluator."""
    return {
        m: MulticlassClassificationEvaluator(metricName=m).evaluate(predictions) for m in ("accuracy", "f1")
    }


def metrics_frame(predictions: DataFrame) -> DataFrame:
    """ML12 as a DataFrame from ``(label, prediction)``: ``(n_test, accuracy, f1)``.

    Weighted F1 = sum over actual labels of share x 2PR/(P+R), the
    definition the evaluator uses. Two small aggregates, no collect.
    """
    p = predictions.select(F.col("label").cast("double").alias("label"), F.col("prediction").cast("double").alias("prediction"))
    by_actual = p.groupBy("label").agg(
        F.count(F.lit(1)).alias("actual"), F.count_if(F.col("label") == F.col("prediction")).alias("tp")
    )
    by_pred = p.groupBy(F.col("prediction").alias("label")).agg(F.count(F.lit(1)).alias("predicted"))
    per = by_actual.join(by_pred, "label", "left").fillna(0, ["predicted"])
    prec = F.when(F.col("predicted") == 0, F.lit(0.0)).otherwise(F.col("tp") / F.col("predicted"))
    rec = F.col("tp") / F.col("actual")
    f1 = F.when(prec + rec == 0, F.lit(0.0)).otherwise(2 * prec * rec / (prec + rec))
    return per.agg(
        F.sum("actual").alias("n_test"),
        (F.sum("tp") / F.sum("actual")).alias("accuracy"),
        (F.sum(F.col("actual") * f1) / F.sum("actual")).alias("f1"),
    )


# ------------------------------------------------------------------ ML8
def compare_models(spark: SparkSession, prepared: Prepared, seed: int = SEED) -> DataFrame:
    """ML8: fit each classifier on train, score test: ``(model, accuracy, f1)``."""
    rows = []
    for name, est in estimators(seed).items():
        scored = est.fit(prepared.train).transform(prepared.test)
        m = evaluate(scored)
        rows.append((name, float(m["accuracy"]), float(m["f1"])))
    return spark.createDataFrame(rows, "model string, accuracy double, f1 double")


# ------------------------------------------------------------------ ML9-ML11
def param_grid(gbt: GBTClassifier, preset: str = "notebook") -> list:
    """ML9: maxDepth x maxBins grid, ``'notebook'`` (2x2) or ``'script'`` (3x3)."""
    g = GRID_PRESETS[preset]
    return ParamGridBuilder().addGrid(gbt.maxDepth, g["maxDepth"]).addGrid(gbt.maxBins, g["maxBins"]).build()


def dealt(frame: DataFrame, rows: int = ROWS_PER_TASK) -> DataFrame:
    """The frame stored in parts of about ``rows`` rows by hash of userId, sorted by it.

    A search starts a thousand small jobs, whose tasks cost more than their
    rows where parts are many; here their number follows the rows. Split
    candidates are sampled part by part, so parts made from the data alone
    also give every cluster the same trees.
    """
    parts = max(1, -(-frame.count() // rows))
    return materialized(frame.repartition(parts, "userId").sortWithinPartitions("userId"))


class FoldsAtOnce(CrossValidator):
    """A cross validator that fits the points of all folds side by side.

    Boosting is a chain of small jobs, so one fold after the other leaves
    most cores idle. Folds, metrics and the best model are the parent's.
    """

    def _fit(self, dataset: DataFrame) -> CrossValidatorModel:
        estimator, points, evaluator = self.getEstimator(), self.getEstimatorParamMaps(), self.getEvaluator()
        folds = [(train.cache(), held_out.cache()) for train, held_out in self._kFold(dataset)]

        def score(job) -> float:
            (train, held_out), point = job
            return evaluator.evaluate(estimator.fit(train, point).transform(held_out))

        jobs = [(fold, point) for fold in folds for point in points]
        try:
            with ThreadPool(min(self.getParallelism(), len(jobs))) as pool:
                found = pool.map(inheritable_thread_target(dataset.sparkSession)(score), jobs, chunksize=1)
        finally:
            for frame in (f for fold in folds for f in fold):
                frame.unpersist()
        found = np.reshape(found, (len(folds), len(points)))
        mean = found.mean(axis=0)
        best = estimator.fit(dataset, points[mean.argmax() if evaluator.isLargerBetter() else mean.argmin()])
        return self._copyValues(CrossValidatorModel(best, mean.tolist(), None, found.std(axis=0).tolist()))


def tune(prepared: Prepared, preset: str = "notebook", metric: str = "f1", seed: int = SEED, parallelism: int = 12) -> CrossValidatorModel:
    """ML10: 3-fold cross-validated grid search of a GBT classifier.

    Folds come from the ``fold`` column (hash of userId), so they are
    the same on any cluster.
    """
    gbt = GBTClassifier(seed=seed)
    cv = FoldsAtOnce(
        estimator=gbt,
        estimatorParamMaps=param_grid(gbt, preset),
        evaluator=MulticlassClassificationEvaluator(metricName=metric),
        foldCol="fold",
        seed=seed,
        parallelism=parallelism,
    )
    return cv.fit(dealt(prepared.train))


def predict(model, test: DataFrame) -> DataFrame:
    """ML11: score a frame: ``userId, label, prediction, probability``."""
    return model.transform(test).select("userId", "label", "prediction", "probability")


# ------------------------------------------------------------------ ML13-ML14
def grid_results(spark: SparkSession, cv_model: CrossValidatorModel) -> DataFrame:
    """ML13: every grid point with its mean metric; the best is flagged."""
    metrics = list(cv_model.avgMetrics)
    best = max(range(len(metrics)), key=lambda i: metrics[i])
    rows = []
    for i, pm in enumerate(cv_model.getEstimatorParamMaps()):
        params = {p.name: v for p, v in pm.items()}
        rows.append((int(params["maxDepth"]), int(params["maxBins"]), float(metrics[i]), i == best))
    return spark.createDataFrame(rows, "maxDepth int, maxBins int, avg_metric double, is_best boolean")


def feature_importances(spark: SparkSession, model, names: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """ML14: ``(feature, importance)``, most important first."""
    values = model.featureImportances.toArray().tolist()
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


# ------------------------------------------------------------------ EXT3
def lift(predictions: DataFrame) -> DataFrame:
    """EXT3: churn rate of predicted churners divided by the overall churn rate."""
    p = predictions.select(F.col("label").cast("double").alias("label"), F.col("prediction").cast("double").alias("prediction"))
    predicted = F.col("prediction") == 1.0
    return p.agg(
        F.count_if(predicted).alias("n_predicted"),
        F.avg(F.when(predicted, F.col("label"))).alias("churn_rate_predicted"),
        F.avg("label").alias("churn_rate_overall"),
    ).withColumn("lift", F.try_divide(F.col("churn_rate_predicted"), F.col("churn_rate_overall")))


def baseline_predictions(matrix: DataFrame, train_percent: int = TRAIN_PERCENT) -> DataFrame:
    """A transparent one-feature rule: predict churn when the user's mean
    listens per session is below the training users' mean.

    Used to check the metric and lift code paths against SQL; the
    threshold is a scalar subquery (computed once, no collect, no join).
    """
    split = with_split(matrix, train_percent)
    threshold = split.where(F.col("split") == "train").agg(F.avg("avg_sess_listens")).scalar()
    return split.select(
        "userId",
        "split",
        F.col("churn").cast("double").alias("label"),
        F.when(F.col("avg_sess_listens") < threshold, F.lit(1.0)).otherwise(F.lit(0.0)).alias("prediction"),
    )
