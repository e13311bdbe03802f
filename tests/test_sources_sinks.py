"""SRC1, SRC2, SRC3, SNK1, SNK2, SRC4."""

import json

import pytest
from pyspark.sql import functions as F

from churnlab.operators import matrix as M
from churnlab.operators.events import drop_blank_users
from churnlab.sources import choose_event_path, read_json_events, to_events, write_table
from churnlab.sources.events import CORRUPT_COLUMN, load_events
from conftest import SF001
from fixtures import H1_ROWS, ms


def _json_lines(rows):
    out = []
    for i, (u, s, t, p, g, loc) in enumerate(rows):
        out.append(json.dumps({"userId": u, "sessionId": s, "ts": ms(t), "page": p, "gender": g,
                               "location": loc, "itemInSession": i, "level": "free", "status": 200,
                               "artist": None, "song": None, "length": None}))
    return "\n".join(out)


def test_json_log_gives_same_matrix_as_frame(spark, tmp_path):
    from fixtures import h1

    p = tmp_path / "log.json"
    p.write_text(_json_lines(H1_ROWS))
    from_json = M.user_matrix(drop_blank_users(to_events(read_json_events(spark, str(p)))))
    direct = M.user_matrix(drop_blank_users(h1(spark)))
    assert sorted(from_json.collect()) == sorted(direct.collect())


def test_inferred_schema_reads_too(spark, tmp_path):
    p = tmp_path / "log.json"
    p.write_text(_json_lines(H1_ROWS[:3]))
    ev = to_events(read_json_events(spark, str(p), infer_schema=True))
    assert ev.count() == 3 and dict(ev.dtypes)["ts"] == "bigint"


def test_corrupt_lines_are_kept_aside(spark, tmp_path):
    p = tmp_path / "log.json"
    p.write_text(_json_lines(H1_ROWS[:2]) + "\n{not json\n")
    raw = read_json_events(spark, str(p), keep_corrupt=True).cache()
    assert raw.where(F.col(CORRUPT_COLUMN).isNotNull()).count() == 1
    assert raw.where(F.col(CORRUPT_COLUMN).isNull()).count() == 2


def test_choose_event_path():
    assert choose_event_path("mini", "small", "big") == "small"
    assert choose_event_path("full", "small", "big") == "big"
    with pytest.raises(ValueError):
        choose_event_path(None, "small", "big")


def test_adapter_shape_and_types(spark):
    ev = load_events(spark, SF001)
    assert ev.columns == ["userId", "sessionId", "ts", "page", "seq", "gender", "location", "level", "status"]
    assert dict(ev.dtypes) == {"userId": "string", "sessionId": "bigint", "ts": "bigint", "page": "string",
                               "seq": "bigint", "gender": "string", "location": "string", "level": "string",
                               "status": "int"}
    assert ev.count() == spark.read.parquet(f"{SF001}/events.parquet").count()


def test_write_matrix_json_round_trip_and_fail_if_present(spark, tmp_path):
    from fixtures import h1

    m = M.user_matrix(drop_blank_users(h1(spark)))
    out = str(tmp_path / "matrix")
    write_table(m, out, fmt="json", single_file=True)
    back = spark.read.schema(m.schema).json(out)
    assert sorted(back.collect()) == sorted(m.collect())
    with pytest.raises(Exception):
        write_table(m, out, fmt="json")


def test_events_landed_by_date_prune_on_date_filters(spark, tmp_path):
    import datetime as dt

    from churnlab.sources import land_events_by_date
    from fixtures import h1

    path = land_events_by_date(h1(spark), str(tmp_path / "by_date"))
    ev = spark.read.parquet(path).where(F.col("date") >= dt.date(2018, 11, 1)).drop("date")
    plan = ev._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "2018-11-01" in plan
    want = h1(spark).where(F.col("ts") >= 1541030400000)  # 2018-11-01 00:00 UTC
    assert sorted(M.user_matrix(drop_blank_users(ev)).collect()) == sorted(M.user_matrix(drop_blank_users(want)).collect())
