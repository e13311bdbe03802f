"""Hand fixtures H1 / H2 with known values (FIXTURES.md)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from churnlab.operators import days as D
from churnlab.operators import listens as L
from churnlab.operators import matrix as M
from churnlab.operators.events import drop_blank_users
from fixtures import h1, h2


def _by_user(df, key="userId"):
    return {r[key]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def ev1(spark):
    return drop_blank_users(h1(spark)).cache()


def test_day_table_user_a(ev1):
    rows = (
        D.day_features(D.user_days(ev1))
        .where("userId = 'a'")
        .orderBy("date")
        .select("date", "date_group", "days_consec_listen", "days_since_last_listen")
        .collect()
    )
    got = [(r.date.isoformat(), r.date_group, r.days_consec_listen, r.days_since_last_listen) for r in rows]
    assert got == [
        ("2018-10-01", 0, 0, 0),
        ("2018-10-02", 1, 1, 1),
        ("2018-10-05", 0, 1, 3),
        ("2018-10-06", 1, 2, 1),
        ("2018-11-01", 0, 2, 26),
        ("2018-11-02", 1, 3, 1),
    ]


def test_day_table_user_b(ev1):
    rows = D.day_features(D.user_days(ev1)).where("userId = 'b'").collect()
    assert [(r.date_group, r.days_consec_listen, r.days_since_last_listen) for r in rows] == [(0, 0, 0)]


def test_matrix_exact(ev1):
    m = _by_user(M.user_matrix(ev1))
    a, b = m["a"], m["b"]
    assert (a["gender"], a["churn"], b["gender"], b["churn"]) == ("M", 1, "F", 0)
    assert a["most_listens_one_month"] == 6 and b["most_listens_one_month"] == 0
    assert a["most_days_since_last_listen"] == 26 and b["most_days_since_last_listen"] == 0
    assert a["most_days_consec_listen"] == 3 and b["most_days_consec_listen"] == 0
    assert (a["total_listens"], a["total_thumbsU"], a["total_thumbsD"], a["total_err"]) == (6, 2, 0, 1)
    assert (b["total_listens"], b["total_thumbsU"], b["total_thumbsD"], b["total_err"]) == (0, 0, 1, 0)
    assert (a["avg_sess_listens"], a["avg_sess_thU"], a["avg_sess_thD"], a["avg_sess_err"]) == (1.5, 0.5, 0.0, 0.25)
    assert (b["avg_sess_listens"], b["avg_sess_thU"], b["avg_sess_thD"], b["avg_sess_err"]) == (0.0, 0.0, 1.0, 0.0)


def test_matrix_fanout_parity(ev1):
    a = _by_user(M.user_matrix(ev1, fanout=True))["a"]
    assert (a["total_listens"], a["total_thumbsU"], a["total_err"]) == (8, 3, 1)
    assert (a["avg_sess_listens"], a["avg_sess_thU"], a["avg_sess_err"]) == (2.0, 0.75, 0.25)
    # the row number is taken before the reference's tie join
    assert a["most_listens_one_month"] == 6


def test_matrix_intended_columns(ev1):
    m = _by_user(M.user_matrix(ev1, intended=True))
    assert (m["a"]["most_listens_in_month"], m["b"]["most_listens_in_month"]) == (5, 0)
    assert (m["a"]["longest_streak_days"], m["b"]["longest_streak_days"]) == (2, 1)
    assert (m["a"]["most_days_without_listen"], m["b"]["most_days_without_listen"]) == (26, 0)


def test_running_and_filled_listens(ev1):
    rows = L.filled_running_listens(ev1).where("userId = 'a'").orderBy("ts", "seq").collect()
    assert [r.running_listens_mon for r in rows] == [None, 1, None, 2, 3, None, 4, None, 5, 6, None, None]
    assert [r.running_listens_mon_fill for r in rows] == [0, 1, 1, 2, 3, 3, 4, 4, 5, 6, 6, 6]
    b = L.filled_running_listens(ev1).where("userId = 'b'").collect()
    assert [r.running_listens_mon_fill for r in b] == [0, 0]


def test_running_listens_by_churn_reference_null(ev1):
    r = _by_user(L.running_listens_by_churn(ev1), "churn")
    assert r[1]["avg_running_listens"] is None  # churn rows are never listens (Q20)
    assert r[0]["avg_running_listens"] == pytest.approx((1 + 2 + 3 + 4 + 5 + 6) / 6)


def test_enriched_events_row_count(ev1):
    # exact mode: one row per event, no fan-out on the tied timestamp
    assert L.enriched_events(ev1).count() == 14


# ----------------------------------------------------------------- H2
@pytest.fixture(scope="module")
def ev2(spark):
    return h2(spark).cache()


def test_blank_and_null_users_dropped(ev2):
    kept = {r.userId for r in drop_blank_users(ev2).select("userId").distinct().collect()}
    assert kept == {"c", "solo", "late", "tail"}


def test_state_edges(spark, ev2):
    from churnlab.functions import state

    got = {r.location: r.s for r in ev2.select("location", state("location").alias("s")).distinct().collect()}
    assert got[None] is None and got["A"] == "A"


def test_fill_before_first_listen_is_zero(ev2):
    rows = (
        L.filled_running_listens(drop_blank_users(ev2))
        .where("userId = 'late'")
        .orderBy("ts", "seq")
        .collect()
    )
    assert [r.running_listens_mon_fill for r in rows] == [0] * 10 + [1]


def test_fill_stops_after_seven_rows_across_days(ev2):
    ev = drop_blank_users(ev2)
    rows = L.filled_running_listens(ev, horizon=L.REFERENCE_FILL_HORIZON).where("userId = 'tail'").orderBy("ts", "seq").collect()
    assert [r.running_listens_mon_fill for r in rows] == [1] * 8 + [0, 0]
    unbounded = L.filled_running_listens(ev, horizon=None).where("userId = 'tail'").collect()
    assert all(r.running_listens_mon_fill == 1 for r in unbounded)


def test_null_ts_and_gender_do_not_break_matrix(ev2):
    m = _by_user(M.user_matrix(drop_blank_users(ev2)))
    assert set(m) == {"c", "solo", "late", "tail"}
    assert m["c"]["gender"] == "F"  # max ignores the null
    assert m["solo"]["total_listens"] == 0 and m["solo"]["avg_sess_listens"] == 0.0
    assert m["late"]["total_listens"] == 1


def test_time_parts_are_utc_whatever_the_session_zone(spark):
    from churnlab.functions import event_date, event_hour

    t = int(dt.datetime(2018, 10, 1, 23, 30, tzinfo=dt.timezone.utc).timestamp() * 1000)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        r = spark.range(1).select(event_date(F.lit(t)).alias("d"), event_hour(F.lit(t)).alias("h")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert (r.d.isoformat(), r.h) == ("2018-10-01", 23)


def test_null_ts_rows_do_not_shift_running_counts(ev2):
    rows = L.filled_running_listens(drop_blank_users(ev2)).where("userId = 'c'").collect()
    by_ts = {r.ts: (r.running_listens_mon, r.running_listens_mon_fill) for r in rows}
    assert by_ts[None] == (None, 0)
    timed = [v for k, v in sorted((k, v) for k, v in by_ts.items() if k is not None)]
    assert timed == [(None, 0), (1, 1)]


def test_listen_day_matrix_keeps_users_without_listens(ev1):
    m = _by_user(M.user_matrix(ev1, only_listen_days=True))
    assert set(m) == {"a", "b"}
    assert (m["b"]["most_days_since_last_listen"], m["b"]["most_days_consec_listen"]) == (0, 0)
    # listening days of a: 10-01, 10-02, 10-06, 11-01 -> one adjacent pair, largest gap 26
    assert (m["a"]["most_days_since_last_listen"], m["a"]["most_days_consec_listen"]) == (26, 1)


def test_page_roles_are_parameters(ev1):
    from churnlab.schema import PageRoles

    only_cancel = PageRoles(churn=("Cancellation Confirmation",))
    m = _by_user(M.user_matrix(ev1, roles=only_cancel))
    assert m["a"]["churn"] == 0  # a downgraded but never cancelled
    home_is_listen = PageRoles(listen="Home")
    h = _by_user(M.user_matrix(ev1, roles=home_is_listen))
    assert (h["a"]["total_listens"], h["b"]["total_listens"]) == (2, 1)
