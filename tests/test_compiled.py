"""Models as expressions, and the registry of fitted searches."""

import duckdb
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from churnlab.plans import model as ML
from churnlab.plans import registry
from churnlab.plans.catalog import QUERIES, matrix
from churnlab.plans.compiled import compile_model
from conftest import SF01


@pytest.fixture(scope="module")
def users(spark):
    return ML.materialized(matrix(spark, SF01))


def by_user(df):
    return {r["userId"]: r["prediction"] for r in df.select("userId", "prediction").collect()}


@pytest.mark.parametrize("name", ["LogisticRegression", "GBTClassifier", "RandomForestClassifier"])
def test_expression_equals_transform_and_duckdb(spark, users, name):
    train = ML.with_split(users).where("split = 'train'").selectExpr("*", "CAST(churn AS DOUBLE) AS label")
    model = Pipeline(stages=[ML.preparation(), ML.estimators()[name]]).fit(train)
    # a pipeline in a pipeline is one list of stages to the compiler
    compiled = compile_model(model.stages[1], model.stages[0])
    want = by_user(model.transform(users))
    scored = compiled.transform(users)
    assert by_user(scored) == want and set(want.values()) <= {0.0, 1.0}
    plan = scored._jdf.queryExecution().toString()
    assert "UDF" not in plan and "vector" not in plan.lower()
    con = duckdb.connect()
    con.register("users", users.toArrow())
    assert dict(con.sql(f"SELECT userId, {compiled.sql} FROM users").fetchall()) == want


def test_nested_pipeline_and_the_query_that_fits_one(spark, users):
    train = ML.with_split(users).where("split = 'train'").selectExpr("*", "CAST(churn AS DOUBLE) AS label")
    model = Pipeline(stages=[ML.preparation(), ML.estimators()["GBTClassifier"]]).fit(train)
    want = by_user(model.transform(users))
    assert by_user(compile_model(model).transform(users)) == want
    streamed = QUERIES["str5_scheduled_scores"](spark, SF01)
    assert by_user(streamed.withColumnRenamed("predicted_churn", "prediction")) == want and streamed.count() == len(want)


def test_unknown_gender_and_null_feature(spark, users):
    train = users.selectExpr("*", "CAST(churn AS DOUBLE) AS label")
    model = Pipeline(stages=[*ML.preparation().getStages(), ML.estimators()["LogisticRegression"]]).fit(train)
    compiled = compile_model(model)
    odd = users.limit(20).selectExpr("* EXCEPT (gender)", "CASE WHEN userId % 2 = 0 THEN NULL ELSE 'it''s' END AS gender")
    assert by_user(compiled.transform(odd)) == by_user(model.transform(odd))
    gap = users.limit(3).selectExpr("* EXCEPT (total_listens)", "CAST(NULL AS BIGINT) AS total_listens")
    assert set(by_user(compiled.transform(gap)).values()) == {None}


@pytest.mark.parametrize("name", ["GBTClassifier", "RandomForestClassifier"])
def test_a_full_forest_is_no_generated_code(spark, name):
    # 620 splits or so, as on half a million users; as code they are more than a method can hold
    columns = [f"f{i}" for i in range(16)]
    rows = spark.range(4000).select("id", *[(F.xxhash64("id", F.lit(c)) % 1000 / 100).alias(c) for c in columns])
    rows = ML.materialized(rows.withColumn("label", (F.xxhash64("id") % 2 == 0).cast("double")))
    stages = [VectorAssembler(inputCols=columns, outputCol="raw_features"), ML.scaler()]
    model = Pipeline(stages=[*stages, ML.estimators()[name]]).fit(rows)
    scored = compile_model(model).transform(rows).select("id", "prediction")
    want = model.transform(rows).select("id", "prediction")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert scored.exceptAll(want).count() == 0 and scored.count() == 4000
        assert len(scored._jdf.queryExecution().executedPlan().toString()) < 60_000
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_categories_and_single_leaves(spark):
    rows = spark.range(400).selectExpr("id", "substr('abcdefgh', id % 8 + 1, 1) AS letter", "CAST(id % 8 IN (1, 2, 5) AS DOUBLE) AS label", "CAST(id % 3 AS DOUBLE) AS f")
    stages = [StringIndexer(inputCol="letter", outputCol="index"), VectorAssembler(inputCols=["index", "f"], outputCol="features")]
    for estimator in (RandomForestClassifier(seed=1, numTrees=5), GBTClassifier(seed=1, maxIter=3), GBTClassifier(maxDepth=0, maxIter=2)):
        model = Pipeline(stages=[*stages, estimator]).fit(rows)
        compiled = compile_model(model)
        want = {r["id"]: r["prediction"] for r in model.transform(rows).collect()}
        assert {r["id"]: r["prediction"] for r in compiled.transform(rows).collect()} == want
        con = duckdb.connect()
        con.register("rows", rows.toArrow())
        assert dict(con.sql(f"SELECT id, {compiled.sql} FROM rows").fetchall()) == want
        assert (" IN (" in compiled.sql) == (estimator.getMaxDepth() > 0)


def test_fingerprint_sees_rows_and_parameters(spark, users):
    same = registry.fingerprint(users.repartition(7), seed=1)
    assert registry.fingerprint(users, seed=1) == same
    assert registry.fingerprint(users, seed=2) != same
    assert registry.fingerprint(users.limit(users.count() - 1), seed=1) != same
    assert registry.fingerprint(users.unionByName(users.limit(1)).unionByName(users.limit(1)), seed=1) != same


def test_one_search_for_all_callers(spark, users, tmp_path, monkeypatch):
    fits, real = [], ML.tune
    monkeypatch.setattr(ML, "GRID_PRESETS", {"tiny": {"maxDepth": [2], "maxBins": [16, 32]}})
    monkeypatch.setattr(ML, "tune", lambda *a, **k: fits.append(k) or real(*a, **k))
    prep = ML.prepare(users, materialize=False)
    first = registry.tuned(users, prep, "tiny", folder=str(tmp_path))
    again = registry.tuned(users.repartition(3), prep, "tiny", folder=str(tmp_path))
    assert len(fits) == 1
    assert by_user(ML.predict(again, prep.test)) == by_user(ML.predict(first, prep.test))
    assert list(again.avgMetrics) == list(first.avgMetrics) and len(ML.grid_results(spark, again).collect()) == 2
    registry.tuned(users, prep, "tiny", seed=7, folder=str(tmp_path))
    assert len(fits) == 2
    # an entry without its marker does not count
    name = registry.fingerprint(users, preset="tiny", grid=ML.GRID_PRESETS["tiny"], metric="f1", seed=ML.SEED)
    (tmp_path / name / "_done" / "_SUCCESS").unlink()
    registry.tuned(users, prep, "tiny", folder=str(tmp_path))
    assert len(fits) == 3
