"""ML1-ML14, EXT3 by properties: seeded repeat, evaluator parity, reload."""

import threading

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator

from churnlab.plans import model as ML
from churnlab.plans.catalog import matrix
from churnlab.sources.sinks import load_cv_model, read_metrics, save_model
from conftest import SF01


@pytest.fixture(scope="module")
def prepared(spark):
    m = matrix(spark, SF01).cache()
    return ML.prepare(m)


def test_split_is_stable_and_both_classes_train(prepared):
    labels = {r.label for r in prepared.train.select("label").distinct().collect()}
    assert labels == {0.0, 1.0}
    n_train, n_test = prepared.train.count(), prepared.test.count()
    assert n_train > n_test > 0
    assert prepared.train.join(prepared.test, "userId").count() == 0


def test_seeded_gbt_repeats(prepared):
    a = ML.evaluate(ML.estimators()["GBTClassifier"].fit(prepared.train).transform(prepared.test))
    b = ML.evaluate(ML.estimators()["GBTClassifier"].fit(prepared.train).transform(prepared.test))
    assert a == b


def test_points_of_all_folds_are_fitted_side_by_side(prepared, monkeypatch):
    monkeypatch.setattr(ML, "GRID_PRESETS", {"tiny": {"maxDepth": [2], "maxBins": [16, 32]}})
    gbt = GBTClassifier(seed=ML.SEED)
    rows = ML.dealt(prepared.train)
    plain = CrossValidator(
        estimator=gbt, estimatorParamMaps=ML.param_grid(gbt, "tiny"), evaluator=MulticlassClassificationEvaluator(), foldCol="fold", seed=ML.SEED
    ).fit(rows)
    # none of the 3 x 2 fits begins before all have been called
    together, fit = threading.Barrier(6), GBTClassifier.fit

    def waiting(self, *args):
        if threading.current_thread() is not threading.main_thread():
            together.wait(timeout=60)
        return fit(self, *args)

    monkeypatch.setattr(GBTClassifier, "fit", waiting)
    found = ML.tune(prepared, "tiny")
    assert list(found.avgMetrics) == pytest.approx(list(plain.avgMetrics), abs=1e-12)
    assert list(found.stdMetrics) == pytest.approx(list(plain.stdMetrics), abs=1e-12)
    assert found.bestModel.toDebugString.split("\n", 1)[1] == plain.bestModel.toDebugString.split("\n", 1)[1]


def test_parts_of_a_search_follow_the_rows_and_not_the_layout(prepared):
    n = prepared.train.count()
    one, many = ML.dealt(prepared.train.repartition(7)), ML.dealt(prepared.train, -(-n // 3))
    assert one.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() == 3
    users = lambda df: [[r.userId for r in part] for part in df.rdd.glom().collect()]
    assert users(many) == users(ML.dealt(prepared.train.repartition(5), -(-n // 3)))
    assert sorted(u for part in users(many) for u in part) == users(one)[0] and len(users(one)[0]) == n


def test_metrics_frame_equals_evaluator(prepared):
    scored = ML.estimators()["RandomForestClassifier"].fit(prepared.train).transform(prepared.test)
    want = ML.evaluate(scored)
    got = ML.metrics_frame(scored).first()
    assert got.accuracy == pytest.approx(want["accuracy"], abs=1e-12)
    assert got.f1 == pytest.approx(want["f1"], abs=1e-12)
    assert got.n_test == prepared.test.count()


def test_compare_models_has_three_rows(spark, prepared):
    rows = ML.compare_models(spark, prepared).collect()
    assert [r.model for r in rows] == ["LogisticRegression", "GBTClassifier", "RandomForestClassifier"]
    assert all(0.0 <= r.accuracy <= 1.0 and 0.0 <= r.f1 <= 1.0 for r in rows)


def test_tune_save_reload_scores_the_same(spark, prepared, tmp_path):
    cv = ML.tune(prepared)
    grid = ML.grid_results(spark, cv).collect()
    assert len(grid) == 4 and sum(r.is_best for r in grid) == 1
    imp = ML.feature_importances(spark, cv.bestModel).collect()
    assert len(imp) == 16 and abs(sum(r.importance for r in imp) - 1.0) < 1e-6
    before = ML.predict(cv, prepared.test)
    m = ML.evaluate(before)
    path = save_model(spark, cv, str(tmp_path), m["accuracy"], m["f1"])
    assert "_CrossValidatorModel_Acc_" in path and read_metrics(spark, path)["f1"] == pytest.approx(m["f1"])
    after = ML.predict(load_cv_model(path), prepared.test)
    a = {r.userId: r.prediction for r in before.collect()}
    b = {r.userId: r.prediction for r in after.collect()}
    assert a == b


def test_lift_of_perfect_predictions(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 0.0), (0.0, 0.0), (1.0, 1.0)], "label double, prediction double")
    r = ML.lift(df).first()
    assert (r.n_predicted, r.churn_rate_predicted, r.churn_rate_overall, r.lift) == (2, 1.0, 0.5, 2.0)


def test_fit_on_all_differs_only_in_scaler(spark):
    m = matrix(spark, SF01)
    a, b = ML.prepare(m, fit_on="train"), ML.prepare(m, fit_on="all")
    assert a.train.count() == b.train.count()
    assert sorted(a.train.select("userId").collect()) == sorted(b.train.select("userId").collect())


def test_stratified_split_keeps_class_shares(spark):
    from pyspark.sql import functions as F

    m = ML.with_split(matrix(spark, SF01), stratified=True)
    shares = m.groupBy("churn").agg(F.avg((F.col("split") == "train").cast("double")).alias("s")).collect()
    assert all(abs(r.s - 0.8) < 0.02 for r in shares)
    again = ML.with_split(matrix(spark, SF01), stratified=True)
    assert sorted(m.select("userId", "split").collect()) == sorted(again.select("userId", "split").collect())


def test_order_statistics_are_exact(spark):
    import random

    from pyspark.sql import functions as F

    from churnlab.operators.selection import order_statistics

    rng = random.Random(3)
    rows = [("hot", rng.randrange(2**60)) for _ in range(500)] + [("tied", 7)] * 20 + [("tied", 2**60 - 1)] * 5 + [(None, rng.randrange(50)) for _ in range(40)] + [("one", 0), ("one", None)]
    df = spark.createDataFrame(rows, "g string, k long")
    for percent in (1, 50, 80, 100):
        got = {r.g: r.value for r in order_statistics(df, ["g"], "k", lambda n: F.ceil(n * percent / 100)).collect()}
        for g in ("hot", "tied", None, "one"):
            keys = sorted(k for name, k in rows if name == g and k is not None)
            assert got[g] == keys[-(-len(keys) * percent // 100) - 1], (g, percent)
    assert order_statistics(df, ["g"], "k", lambda n: n + 1).count() == 0


def test_stratified_split_is_exact_in_every_class(spark):
    rows = [(f"u{i}", i % 10 == 0, i) for i in range(237)] + [(f"n{i}", None, i) for i in range(11)]
    df = spark.createDataFrame(rows, "userId string, churn boolean, x int")
    for percent in (0, 30, 80, 100):
        out = ML.with_split(df, percent, stratified=True)
        assert out.columns == ["userId", "churn", "x", "split"]
        got = {(r.churn, r.split): r["count"] for r in out.groupBy("churn", "split").count().collect()}
        for churn, n in ((True, 24), (False, 213), (None, 11)):
            assert got.get((churn, "train"), 0) == -(-n * percent // 100)
            assert got.get((churn, "test"), 0) == n - -(-n * percent // 100)
