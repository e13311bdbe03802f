"""A user holding far more than a third of all events.

The event-grain shuffles of the library are keyed so that such a user is
spread over many tasks: (userId, hour bucket) for the running-listen
windows, (userId, date) and (userId, sessionId) for the first aggregates.
These tests measure the largest hash partition under each key and check
that the results stay exact.
"""

import random

import pytest
from pyspark.sql import functions as F

from churnlab.functions import event_date
from churnlab.operators import listens as L
from churnlab.operators import matrix as M
from fixtures import frame

N_PART = 16


@pytest.fixture(scope="module")
def hot_log(spark):
    rng = random.Random(3)
    rows = []
    for i in range(6000):  # the hot user: 6,000 events over 60 days
        day, hh, mm = 1 + i % 60, rng.randint(0, 23), rng.randint(0, 59)
        rows.append(("hot", 1 + i // 50, f"2018-{9 + (day - 1) // 30:02d}-{1 + (day - 1) % 30:02d} {hh:02d}:{mm:02d}",
                     rng.choice(["NextSong", "NextSong", "Home", "Thumbs Up"]), "M", "X, CA"))
    for u in range(200):  # 200 ordinary users, 20 events each
        for j in range(20):
            rows.append((f"u{u}", j // 5, f"2018-09-{1 + j:02d} 10:{j:02d}", rng.choice(["NextSong", "Home"]), "F", "Y, NY"))
    return frame(spark, rows).cache()


def largest_share(df, *keys):
    parts = df.repartition(N_PART, *keys).groupBy(F.spark_partition_id().alias("p")).count()
    total = df.count()
    return parts.agg(F.max("count")).first()[0] / total


def test_hot_user_dominates_user_key(hot_log):
    assert hot_log.where("userId = 'hot'").count() / hot_log.count() > 0.5
    assert largest_share(hot_log, "userId") > 0.5


def test_bucket_key_spreads_the_hot_user(hot_log):
    keyed = hot_log.withColumn("_bucket", F.floor(F.col("ts") / F.lit(3_600_000)))
    assert largest_share(keyed, "userId", "_bucket") < 0.15
    dated = hot_log.withColumn("date", event_date("ts"))
    assert largest_share(dated, "userId", "date") < 0.15
    assert largest_share(hot_log, "userId", "sessionId") < 0.15


@pytest.mark.parametrize("horizon", [7, None])
def test_results_exact_under_skew(hot_log, horizon):
    from test_properties import _fill_by_plain_window

    got = {r.seq: r.running_listens_mon_fill for r in L.filled_running_listens(hot_log, horizon=horizon).collect()}
    want = {r.seq: r.fill for r in _fill_by_plain_window(hot_log, horizon).collect()}
    assert got == want
    hot = M.user_matrix(hot_log).where("userId = 'hot'").first()
    n_listens = hot_log.where("userId = 'hot' AND page = 'NextSong'").count()
    assert hot.total_listens == n_listens == hot.most_listens_one_month
