
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from churnlab.operators import days as D
from churnlab.operators import listens as L
from churnlab.operators import matrix as M
from churnlab.operators import sessions as S
from churnlab.operators.events import drop_blank_users
from churnlab.plans.catalog import events as adapted_events
from conftest import SF01
from fixtures import frame

PAGES = ["NextSong", "NextSong", "NextSong", "Home", "Thumbs Up", "Thumbs Down", "Error", "Add Friend", "Downgrade"]


@pytest.fixture(scope="module")
def random_log(spark):
    rng = random.Random(7)
    rows = []
    for u in range(6):
        for _ in range(rng.randint(1, 60)):
            day = rng.randint(1, 28)
            hh, mm = rng.randint(0, 23), rng.choice([0, 0, 15, 30])  # many tied timestamps
            rows.append((f"u{u}", rng.randint(1, 4), f"2018-10-{day:02d} {hh:02d}:{mm:02d}", rng.choice(PAGES), "M", "X, CA"))
    return frame(spark, rows).cache()


def _fill_by_plain_window(ev, horizon):
    """The obvious statement: one window over all events of a user."""
    w = Window.partitionBy("userId").orderBy("ts", "seq")
    listen = (F.col("page") == "NextSong").cast("int")
    ev = ev.withColumn("l", F.coalesce(listen, F.lit(0)))
    cum = F.sum("l").over(w.rowsBetween(Window.unboundedPreceding, 0))
    near = F.max("l").over(w.rowsBetween(-horizon, 0)) if horizon is not None else F.max("l").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ev.select("seq", F.when(near == 1, cum).otherwise(0).cast("int").alias("fill"),
                     F.when(F.col("l") == 1, cum).cast("int").alias("run"))


@pytest.mark.parametrize("horizon", [0, 1, 3, 7, None])
@pytest.mark.parametrize("bucket_ms", [60_000, 3_600_000, 86_400_000])
def test_two_level_fill_equals_plain_window(random_log, horizon, bucket_ms):
    got = {
        r.seq: (r.running_listens_mon_fill, r.running_listens_mon)
        for r in L.filled_running_listens(
            random_log, horizon=horizon, bucket_ms=bucket_ms
        ).collect()
    }
    want = {r.seq: (r.fill, r.run) for r in _fill_by_plain_window(random_log, horizon).collect()}
    assert got == want


def test_matrix_equals_its_parts(random_log):
    """The one-pass matrix against the tables the streaming upkeep keeps."""
    for kw in ({}, {"fanout": True}):
        parts = M.assemble_matrix(
            M.rollup_sessions(M.session_parts(random_log, **kw)), D.day_user_maxima(D.user_days(random_log)), M.user_gender(random_log)
        )
        assert sorted(parts.collect()) == sorted(M.user_matrix(random_log, **kw).collect())
    days = D.user_days(random_log)
    table = D.longest_streak(days).join(D.listen_gaps(days), "userId").join(L.most_listens_in_month(random_log), "userId")
    for kw in ({}, {"only_listen_days": True}):
        whole = M.user_matrix(random_log, intended=True, **kw).select("userId", *M.INTENDED_COLUMNS)
        assert sorted(table.select("userId", *M.INTENDED_COLUMNS).collect()) == sorted(whole.collect())


def test_results_do_not_depend_on_layout(random_log):
    a = sorted(M.user_matrix(random_log.repartition(1)).collect())
    b = sorted(M.user_matrix(random_log.repartition(5, "page")).collect())
    c = sorted(M.user_matrix(random_log.orderBy(F.desc("ts"))).collect())
    assert a == b == c


def test_session_totals_sum_to_user_totals(random_log):
    sess = S.session_totals(random_log).groupBy("userId").agg(F.sum("sess_listens").alias("s"), F.sum("sess_thU").alias("u"))
    m = M.user_matrix(random_log).select("userId", "total_listens", "total_thumbsU")
    bad = sess.join(m, "userId").where("s <> total_listens OR u <> total_thumbsU").count()
    assert bad == 0


def test_streak_bounds(spark):
    ev = adapted_events(spark, SF01, attrs=False)
    days = D.user_days(ev)
    active = days.groupBy("userId").agg(F.count("*").alias("n_days"))
    streak = D.longest_streak(days)
    consec = D.day_user_maxima(days)
    j = active.join(streak, "userId").join(consec, "userId")
    bad = j.where("NOT (longest_streak_days - 1 <= most_days_consec_listen AND most_days_consec_listen <= n_days - 1)")
    assert bad.count() == 0


def test_unbounded_fill_is_running_count_after_first_listen(random_log):
    df = L.filled_running_listens(random_log)
    w = Window.partitionBy("userId").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.max(F.col("running_listens_mon").isNotNull().cast("int")).over(w)
    check = df.withColumn("seen", seen).where("seen = 1 AND running_listens_mon_fill = 0")
    assert check.count() == 0


def test_fanout_weight_matches_tie_counts(random_log):
    ex = M.user_matrix(random_log)
    fo = M.user_matrix(random_log, fanout=True)
    # fan-out only inflates; it never lowers a total, never changes labels
    j = ex.alias("e").join(fo.alias("f"), "userId")
    assert j.where("f.total_listens < e.total_listens OR f.churn <> e.churn").count() == 0
    assert sorted(r.userId for r in ex.collect()) == sorted(r.userId for r in fo.collect())


def test_blank_filter_keeps_all_real_users(random_log):
    assert drop_blank_users(random_log).count() == random_log.count()


def test_enriched_day_features_equal_the_day_table_join(random_log):
    days = D.day_features(D.user_days(random_log)).select("userId", "date", "days_consec_listen", "days_since_last_listen")
    want = {
        r.seq: (r.days_consec_listen, r.days_since_last_listen)
        for r in random_log.withColumn("date", F.date_from_unix_date(F.floor(F.col("ts") / 86_400_000).cast("int")))
        .join(days, ["userId", "date"], "left")
        .collect()
    }
    got = {
        r.seq: (r.days_consec_listen, r.days_since_last_listen)
        for r in L.enriched_events(random_log).collect()
    }
    assert got == want
