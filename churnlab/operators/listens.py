"""Running listens and their forward fill (WIN3, WIN3b, WIN4, JN1, AGG11).


* ``running_listens_mon`` numbers a user's listens over the user's whole
  life (the row number never restarts per month). Ordered here by
  ``(ts, seq)``, which refines the month order and makes it deterministic.
* ``running_listens_mon_fill`` copies the value of the nearest earlier
  listen, else 0. ``horizon=7`` is the parity form: it looks back at most
  seven rows.

One window over all events of a user would put a heavy user in one task,
so the count is taken in two levels, the same for every user:

1. a partial aggregate per (userId, time bucket) - an hour by default -
   gives the listens of each bucket, and a window over these few rows per
   user the listens before it;
2. a window per (userId, bucket) counts inside the bucket;
3. an equi-join on (userId, bucket) adds the two. The events are already
   partitioned by these keys, so only the small summary moves.

The events are shuffled once, by (userId, bucket); a user with a large
share of all events is spread over as many tasks as it has active buckets.
Events without a time are dealt over ``UNTIMED`` groups of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlab.functions import event_date, event_hour, page_flag
from churnlab.functions.columns import MS_PER_DAY
from churnlab.operators.days import day_features
from churnlab.operators.events import with_flags
from churnlab.schema import DEFAULT_ROLES, PageRoles

REFERENCE_FILL_HORIZON = 7  # fixed value: one lag step plus six loop rounds
BUCKET_MS = 3_600_000
UNTIMED = 1024
_FIRST_TIMED = -(1 << 62)  # bucket numbers below it hold events without a time

_UNBOUNDED = Window.unboundedPreceding
_CURRENT = Window.currentRow


def _bucketed(events: DataFrame, roles: PageRoles, bucket_ms: int) -> DataFrame:
    """Adds ``date``, ``listen_flag``, ``_bucket`` and ``_l`` (a listen with a time)."""
    if MS_PER_DAY % bucket_ms:
        raise ValueError("bucket_ms must divide one day")
    untimed = F.lit(_FIRST_TIMED - 1) - F.pmod(F.xxhash64("seq", "page"), F.lit(UNTIMED))
    flag = page_flag("page", roles.listen)
    return events.withColumns(
        {
            "date": event_date("ts"),
            "listen_flag": flag,
            "_bucket": F.coalesce(F.floor(F.col("ts") / F.lit(bucket_ms)), untimed),
            "_l": F.when(F.col("ts").isNotNull(), flag).otherwise(F.lit(0)),
        }
    )


def _summary(events: DataFrame, roles: PageRoles, bucket_ms: int) -> DataFrame:
    """``(userId, _bucket, _n_listens, _before)``: listens in and before each bucket."""
    ev = _bucketed(events.select("userId", "ts", "seq", "page"), roles, bucket_ms).where(F.col("ts").isNotNull())
    buckets = ev.groupBy("userId", "_bucket").agg(F.sum("_l").alias("_n_listens"))
    earlier = Window.partitionBy("userId").orderBy("_bucket").rowsBetween(_UNBOUNDED, -1)
    return buckets.withColumn("_before", F.coalesce(F.sum("_n_listens").over(earlier), F.lit(0)))


def _bucket_days(summary: DataFrame, bucket_ms: int) -> DataFrame:
    """Adds the day features (WIN1, WIN2) of the bucket's date to the summary.

    A bucket never spans two dates, so the user-day table is an aggregate
    of the summary; the events are not read again.
    """
    date = F.date_from_unix_date(F.floor(F.col("_bucket") * F.lit(bucket_ms) / F.lit(MS_PER_DAY)).cast("int"))
    dated = summary.withColumn("_date", date)
    table = dated.groupBy("userId", F.col("_date").alias("date")).agg(F.max((F.col("_n_listens") > 0).cast("int")).alias("listen_flag"))
    days = day_features(table).select("userId", F.col("date").alias("_date"), "days_consec_listen", "days_since_last_listen")
    return dated.join(days, ["userId", "_date"]).drop("_date")


def listen_positions(
    events: DataFrame,
    roles: PageRoles = DEFAULT_ROLES,
    horizon: int | None = None,
    bucket_ms: int = BUCKET_MS,
    with_day_features: bool = False,
) -> DataFrame:
    """WIN3 + WIN4 for every event.

    Keeps the input columns and adds ``date``, ``listen_flag``,
    ``running_listens_mon`` (int, null on non-listen rows) and
    ``running_listens_mon_fill`` (int). The fill reaches any earlier
    listen; ``horizon`` limits it to so many rows. Events without a time
    keep their row (no running count, fill 0) and do not shift the others.

    ``with_day_features`` adds ``days_consec_listen`` and
    ``days_since_last_listen`` of the event's day (WIN1, WIN2), which come
    with the bucket summary: there is no event-grain join on the day.
    """
    summary = _summary(events, roles, bucket_ms)
    if with_day_features:
        summary = _bucket_days(summary, bucket_ms)
    ev = _bucketed(events, roles, bucket_ms)
    ordered = Window.partitionBy("userId", "_bucket").orderBy("ts", "seq")
    ev = ev.withColumn("_in", F.sum("_l").over(ordered.rowsBetween(_UNBOUNDED, _CURRENT)))
    joined = ev.join(summary.drop("_n_listens"), ["userId", "_bucket"], "left")
    total = (F.coalesce("_before", F.lit(0)) + F.col("_in")).cast("int")
    fill = total
    if horizon is not None:
        joined = _with_distance(joined, ordered)
        fill = F.when(F.col("_distance") <= horizon, total).otherwise(F.lit(0))
    out = joined.withColumns({"running_listens_mon": F.when(F.col("_l") == 1, total), "running_listens_mon_fill": fill})
    return out.drop("_bucket", "_l", "_in", "_before", "_distance")


def _with_distance(joined: DataFrame, ordered) -> DataFrame:
    """Adds ``_distance``: rows back to the user's last listen, null if none.

    Only the parity form needs row positions. The rows and the position of
    the last listen of every bucket are aggregated from the numbered rows,
    so this form goes over the shuffled events twice.
    """
    running = ordered.rowsBetween(_UNBOUNDED, _CURRENT)
    rows = joined.withColumn("_pos", F.row_number().over(ordered))
    listened = F.when(F.col("_l") == 1, F.col("_pos"))
    rows = rows.withColumn("_last", F.max(listened).over(running))
    ends = rows.where(F.col("ts").isNotNull()).groupBy("userId", "_bucket").agg(F.count(F.lit(1)).alias("_rows"), F.max(listened).alias("_end"))
    earlier = Window.partitionBy("userId").orderBy("_bucket").rowsBetween(_UNBOUNDED, -1)
    ends = ends.withColumn("_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    ends = ends.withColumn("_earlier", F.max(F.col("_start") + F.col("_end")).over(earlier)).select("userId", "_bucket", "_start", "_earlier")
    found = rows.join(ends, ["userId", "_bucket"], "left")
    here = F.col("_pos") - F.col("_last")
    return found.withColumn("_distance", F.coalesce(here, F.col("_start") + F.col("_pos") - F.col("_earlier"))).drop("_pos", "_last", "_start", "_earlier")


def running_listens(events: DataFrame, roles: PageRoles = DEFAULT_ROLES) -> DataFrame:
    """WIN3: ``(userId, ts, seq, date, running_listens_mon)`` for listen events."""
    return (
        listen_positions(events, roles)
        .where(F.col("listen_flag") == 1)
        .select("userId", "ts", "seq", "date", "running_listens_mon")
    )


def filled_running_listens(
    events: DataFrame,
    roles: PageRoles = DEFAULT_ROLES,
    horizon: int | None = None,
    bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """WIN4: every event with its running and filled running listen count."""
    return listen_positions(events, roles, horizon, bucket_ms).select(
        "userId", "ts", "seq", "page", "running_listens_mon", "running_listens_mon_fill"
    )


def most_listens_in_month(events: DataFrame, roles: PageRoles = DEFAULT_ROLES) -> DataFrame:
    """WIN3b (intended): most listens in one calendar month, per user.

    Two aggregates with map-side combine; users without a listen get 0.
    """
    ev = events.select("userId", F.trunc(event_date("ts"), "month").alias("month"), page_flag("page", roles.listen).alias("l"))
    return (
        ev.groupBy("userId", "month")
        .agg(F.sum("l").alias("n"))
        .groupBy("userId")
        .agg(F.max("n").cast("long").alias("most_listens_in_month"))
    )


def enriched_events(
    events: DataFrame,
    roles: PageRoles = DEFAULT_ROLES,
    horizon: int | None = None,
) -> DataFrame:
    """JN1: each event with its day features, running counts, flags, churn flag.

    The day features (the two day-level joins JN1, JN2) come with the
    bucket summary, without an event-grain join. The running counts need
    no join on ts at all (JN3 removed), so there is no fan-out on tied
    timestamps.
    """
    ev = listen_positions(events, roles, horizon, with_day_features=True)
    ev = with_flags(ev.drop("listen_flag"), roles)
    return ev.select(
        "userId",
        "sessionId",
        "seq",
        "ts",
        "page",
        "date",
        event_hour("ts").alias("hour"),
        "days_consec_listen",
        "days_since_last_listen",
        "running_listens_mon",
        "running_listens_mon_fill",
        "listen_flag",
        "thU_flag",
        "thD_flag",
        "err_flag",
        "addP_flag",
        "addF_flag",
        "churn",
    )


def running_listens_by_churn(events: DataFrame, roles: PageRoles = DEFAULT_ROLES) -> DataFrame:
    """AGG11: mean running listen count by the churn-event flag.

    ``avg_running_listens`` is the reference form: the running count
    exists on listen rows only and churn rows are never listens, so the
    mean for churn = 1 is null. ``avg_running_listens_fill`` averages the
    filled count (WIN4), which is defined on every row.
    """
    ev = with_flags(listen_positions(events, roles).drop("listen_flag"), roles)
    return ev.groupBy("churn").agg(
        F.avg("running_listens_mon").alias("avg_running_listens"),
        F.avg("running_listens_mon_fill").alias("avg_running_listens_fill"),
    )


def event_listing(events: DataFrame, n: int = 20, roles: PageRoles = DEFAULT_ROLES) -> DataFrame:
    """SRT6: events with their running listen number, by user and time, first ``n``.

    A global top-n: each task keeps its own first ``n`` rows and only those
    are merged, so the sort never gathers the whole log in one place.
    """
    return (
        listen_positions(events, roles)
        .orderBy("userId", "ts", "seq")
        .select("userId", "date", "page", "running_listens_mon")
        .limit(n)
    )
