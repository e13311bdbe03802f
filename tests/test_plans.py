"""Plan checks: no Python evaluation, pruned and pushed-down scans, shuffle shape."""

import re

import pytest

from churnlab.operators import matrix as M
from churnlab.operators.events import drop_blank_users
from churnlab.plans.catalog import NO_ORACLE, QUERIES, TRAINING
from churnlab.sources.events import to_events
from conftest import SF001
from fixtures import h1

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas")
STREAMING = {"str2_page_hour_counts", "str3_user_day_totals", "str3_session_totals", "str4_streamed_user_matrix", "src1_json_matrix", "prf2_schema", "str5_rule_scores", *TRAINING}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in NO_ORACLE and n not in STREAMING])
def test_no_python_in_plan(spark, name):
    plan = plan_of(QUERIES[name](spark, SF001))
    assert not any(node in plan for node in PY_NODES), name


@pytest.fixture(scope="module")
def parquet_log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "events.parquet")
    h1(spark).write.parquet(path)
    return path


def test_matrix_scan_is_pruned_and_filter_pushed(spark, parquet_log):
    ev = drop_blank_users(spark.read.parquet(parquet_log))
    plan = plan_of(M.user_matrix(ev))
    scans = re.findall(r"FileScan parquet \[[^\]]*\].*?ReadSchema: struct<[^>]*>", plan)
    assert scans, plan
    for s in scans:
        assert "Not(EqualTo(userId,))" in s  # blank-user filter reaches the scan
        schema = s.split("ReadSchema:")[1]
        assert "level" not in schema and "location" not in schema and "status" not in schema


def _windows_by_user_alone_over_events(plan: str) -> list[str]:
    """Windows partitioned by userId alone whose input is not an aggregate."""
    lines = plan.splitlines()
    bad = []
    for i, line in enumerate(lines):
        if "Window [" not in line or not re.search(r"\], \[userId#\d+\], \[", line):
            continue
        depth = len(line) - len(line.lstrip(" :+-"))
        for below in lines[i + 1 :]:
            if len(below) - len(below.lstrip(" :+-")) <= depth:
                break
            if "Aggregate" in below:
                break
            if "Relation" in below or "LogicalRDD" in below:
                bad.append(line.strip()[:120])
                break
    return bad


def test_matrix_has_no_event_grain_window_by_user_alone(spark, parquet_log):
    ev = drop_blank_users(spark.read.parquet(parquet_log))
    plan = M.user_matrix(ev, intended=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" in plan
    assert _windows_by_user_alone_over_events(plan) == []


def test_listen_windows_have_no_event_grain_window_by_user_alone(spark, parquet_log):
    from churnlab.operators.listens import enriched_events

    ev = drop_blank_users(spark.read.parquet(parquet_log))
    plan = enriched_events(ev)._jdf.queryExecution().optimizedPlan().toString()
    assert _windows_by_user_alone_over_events(plan) == []


def _sort_aggregates_over_scans(plan: str) -> list[str]:
    """Sort aggregates with a scan below and no hash aggregate between."""
    lines, bad = plan.splitlines(), []
    for i, line in enumerate(lines):
        if "SortAggregate(" not in line:
            continue
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        for below in lines[i + 1 :]:
            if len(below) - len(below.lstrip(" :+-*()0123456789")) <= depth or "HashAggregate(" in below:
                break
            if "FileScan" in below:
                bad.append(line.strip()[:120])
                break
    return bad


def test_no_sort_aggregate_over_the_events(spark, parquet_log):
    ev = drop_blank_users(spark.read.parquet(parquet_log))
    for df in (M.user_matrix(ev), M.user_matrix(ev, intended=True), M.user_gender(ev), M.user_attributes(ev)):
        plan = plan_of(df)
        assert not any(node in plan for node in PY_NODES)
        assert _sort_aggregates_over_scans(plan) == []
    from pyspark.sql import functions as F

    assert _sort_aggregates_over_scans(plan_of(ev.groupBy("userId").agg(F.max("gender"))))


def _nodes(plan: str, name: str) -> int:
    return len(re.findall(rf"\b{name}\b", plan))


def test_events_are_read_and_shuffled_once(spark, parquet_log):
    from churnlab.operators import listens as L

    ev = drop_blank_users(spark.read.parquet(parquet_log))
    for options in ({}, {"intended": True}, {"fanout": True}, {"only_listen_days": True}):
        assert _nodes(plan_of(M.user_matrix(ev, **options)), "FileScan") == 1
    for df, scans in ((L.running_listens(ev), 2), (L.filled_running_listens(ev), 2), (L.running_listens_by_churn(ev), 2), (L.enriched_events(ev), 3)):
        plan = plan_of(df)
        assert _nodes(plan, "FileScan") <= scans
        # an exchange of events carries the tie-break, summaries do not
        exchanged = [x for x in plan.split("Exchange hashpartitioning")[1:] if "Aggregate" not in x.split("FileScan")[0]]
        assert len(exchanged) == 1, plan


def test_page_filter_reaches_the_raw_column(spark):
    plan = plan_of(QUERIES["flt2_listen_events"](spark, SF001))
    assert "EqualTo(event_type,view)" in plan


def test_json_source_pushes_blank_filter(spark, tmp_path):
    import json

    p = tmp_path / "log.json"
    p.write_text("\n".join(json.dumps({"userId": u, "ts": 1538388000000, "page": "NextSong", "sessionId": 1}) for u in ["a", ""]))
    from churnlab.sources.events import read_json_events

    ev = drop_blank_users(to_events(read_json_events(spark, str(p))))
    plan = plan_of(ev)
    assert "PushedFilters: [IsNotNull(userId), Not(EqualTo(userId,))]" in plan
    assert [r.userId for r in ev.collect()] == ["a"]


def test_window_detector_catches_event_grain_user_window(spark, parquet_log):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    ev = spark.read.parquet(parquet_log)
    naive = ev.withColumn("rn", F.row_number().over(Window.partitionBy("userId").orderBy("ts")))
    assert _windows_by_user_alone_over_events(naive._jdf.queryExecution().optimizedPlan().toString())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in NO_ORACLE and n not in STREAMING])
def test_no_cross_join_in_plan(spark, name):
    df = QUERIES[name](spark, SF001)
    df.collect()  # final adaptive plan
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
