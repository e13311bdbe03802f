"""PRF2, SRT6, ML9 and small helpers."""

from churnlab.functions import hash_percent
from churnlab.operators.events import drop_blank_users
from churnlab.operators.listens import event_listing
from churnlab.operators.profile import first_rows, schema_profile
from churnlab.plans import model as ML
from fixtures import h1


def test_schema_profile_lists_columns_in_order(spark):
    ev = h1(spark)
    rows = schema_profile(spark, ev).orderBy("position").collect()
    assert [(r.column, r.type) for r in rows][:4] == [("userId", "string"), ("sessionId", "bigint"), ("ts", "bigint"), ("page", "string")]
    assert first_rows(ev).count() == 1


def test_event_listing_is_ordered_and_limited(spark):
    rows = event_listing(drop_blank_users(h1(spark)), n=5).collect()
    assert [(r.userId, r.page, r.running_listens_mon) for r in rows] == [
        ("a", "Home", None), ("a", "NextSong", 1), ("a", "Thumbs Up", None), ("a", "NextSong", 2), ("a", "NextSong", 3)
    ]


def test_grid_presets():
    from pyspark.ml.classification import GBTClassifier

    gbt = GBTClassifier()
    assert len(ML.param_grid(gbt, "notebook")) == 4
    assert len(ML.param_grid(gbt, "script")) == 9


def test_hash_percent_is_stable(spark):
    vals = spark.createDataFrame([("10",), ("11",), ("abc",)], "k string").select(hash_percent("k").alias("p")).collect()
    again = spark.createDataFrame([("abc",), ("11",), ("10",)], "k string").select(hash_percent("k").alias("p")).collect()
    assert sorted(v.p for v in vals) == sorted(v.p for v in again)
    assert all(0 <= v.p < 100 for v in vals)


def test_cli_list_and_sql(capsys):
    from churnlab.__main__ import main

    assert main(["list"]) == 0
    listed = capsys.readouterr().out.split("\n")
    assert "jn4_user_matrix" in listed
    assert main(["sql", "agg1_page_visits"]) == 0
    assert "count_visits" in capsys.readouterr().out


def test_checkpoint_folder_is_taken_from_the_session(spark):
    from churnlab.session import ensure_checkpoint_dir

    first = ensure_checkpoint_dir(spark)
    assert first and ensure_checkpoint_dir(spark) == first
    assert spark.sparkContext.getCheckpointDir().rstrip("/").endswith(first.rstrip("/").split("/")[-1])


def test_files_added_under_a_partition_are_seen(spark, tmp_path):
    import shutil

    from pyspark.sql import functions as F

    from churnlab.plans.catalog import QUERIES
    from conftest import SF001

    d = tmp_path / "sf"
    d.mkdir()
    for name in ("customer", "nation", "region"):
        shutil.copy(f"{SF001}/{name}.parquet", d)
    source = spark.read.parquet(f"{SF001}/events.parquet")
    half = lambda n: source.where(F.col("event_id") % 2 == n).withColumn("part", F.lit(1))
    half(0).write.partitionBy("part").parquet(str(d / "events.parquet"))
    shape = lambda: QUERIES["prf1_shape"](spark, str(d)).first().n_rows
    first = shape()
    half(1).write.mode("append").partitionBy("part").parquet(str(d / "events.parquet"))
    assert first < shape() == source.count()

