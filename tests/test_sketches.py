"""Stored distinct sketches: any period from its days, days written again."""

from churnlab.operators import sketches as K
from churnlab.plans.catalog import events
from conftest import SF01


def test_periods_from_stored_days(spark, tmp_path):
    ev = events(spark, SF01)
    path = str(tmp_path / "days")
    K.store_sketches(K.daily_sketches(ev, ["userId"]), path)
    days = K.read_sketches(spark, path)
    assert days.count() == ev.selectExpr("CAST(timestamp_millis(ts) AS DATE) AS d").distinct().count()
    direct = ev.select("userId").distinct().count()
    all_days = K.distinct_from_sketches(days, ["userId"]).first()[0]
    assert abs(all_days - direct) <= 0.05 * direct
    # days written twice replace themselves; sketches of repeated events are the same
    K.store_sketches(K.daily_sketches(ev.unionByName(ev), ["userId"]), path)
    assert K.distinct_from_sketches(K.read_sketches(spark, path), ["userId"]).first()[0] == all_days
    # the rewritten files, not those of the first reading
    days = K.read_sketches(spark, path)
    bounds = days.selectExpr("CAST(min(date) AS STRING)", "CAST(date_add(min(date), 20) AS STRING)").first()
    some = K.read_sketches(spark, path, *bounds)
    assert "PartitionFilters: [isnotnull(date" in some._jdf.queryExecution().executedPlan().toString()
    want = ev.where(f"CAST(timestamp_millis(ts) AS DATE) BETWEEN DATE '{bounds[0]}' AND DATE '{bounds[1]}'").select("userId").distinct().count()
    got = K.distinct_from_sketches(some, ["userId"]).first()[0]
    assert abs(got - want) <= max(1, 0.05 * want)


def test_empty_and_null(spark, tmp_path):
    df = spark.createDataFrame([("a", 0), (None, 0), ("a", 5)], "userId string, ts long")
    out = K.distinct_from_sketches(K.daily_sketches(df, ["userId"]), ["userId"], ["date"]).collect()
    assert [r.n_distinct_userId for r in out] == [1]
    assert K.daily_sketches(df.limit(0), ["userId"]).count() == 0
