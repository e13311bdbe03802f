"""The user matrix and user-grain features (AGG6, AGG9, JN4, EXT1, EXT2).

Shape of the plan - the events are read once:

    events -> group (userId, sessionId, date, gender): 6 sums, max churn
           -> windows per user over these rows: gaps between active days
           -> group userId: totals, means, label, gender, day maxima

The first aggregate is a hash aggregate with a map-side part, so the event
volume is reduced before any shuffle and no event-grain window is keyed by
userId: a user with a large share of the events is spread over its
sessions and days. Gender is a grouping key there, because ``max`` of a
string cannot live in a hash-aggregate buffer and would sort all events;
the maximum is taken over the few rows per user.

The streaming upkeep keeps the three parts of the matrix (sessions, days,
genders) in tables of their own and assembles them with
``assemble_matrix``.

``most_listens_one_month`` is the maximum of a row number over the user's
listens (Q5), i.e. the user's listen count. It is taken unweighted even
under ``fanout``, where only the flag sums are weighted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlab.functions import churn_flag, days_between, event_date, page_flag, period_start
from churnlab.operators.sessions import flagged
from churnlab.schema import (
    DEFAULT_ROLES,
    FLAG_COLUMNS,
    MEAN_MEASURES,
    SESSION_MEASURES,
    TOTAL_MEASURES,
    USER_MATRIX_COLUMNS,
    PageRoles,
)

NO_SESSION = -(1 << 63)  # events without a session form one session
INTENDED_COLUMNS = ("most_listens_in_month", "longest_streak_days", "most_days_without_listen")


SESSION_PART_COLUMNS = ("userId", "sessionId", *SESSION_MEASURES, "_listens", "_churn")


def session_parts(events: DataFrame, roles: PageRoles = DEFAULT_ROLES, fanout: bool = False) -> DataFrame:
    """Per (userId, sessionId): the six session sums, raw listen count, churn flag.

    Additive (sums) and idempotent (max) measures only, so parts built
    from separate slices of the log can be merged by grouping again
    (see ``merge_session_parts``).
    """
    ev = flagged(events.select("userId", "sessionId", "ts", "page"), roles, fanout)
    return ev.groupBy("userId", "sessionId").agg(
        *[F.sum(F.col(f"w_{c}")).cast("long").alias(m) for c, m in zip(FLAG_COLUMNS, SESSION_MEASURES)],
        F.sum("listen_flag").cast("long").alias("_listens"),
        F.max("churn").alias("_churn"),
    )


def merge_session_parts(parts: DataFrame, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Merge session parts that may repeat a (userId, sessionId) key.

    ``extra_keys`` are carried along; they must be functions of userId
    (for example a hash bucket), so they do not split a session.
    """
    return parts.groupBy(*extra_keys, "userId", "sessionId").agg(
        *[F.sum(m).cast("long").alias(m) for m in (*SESSION_MEASURES, "_listens")],
        F.max("_churn").alias("_churn"),
    )


def rollup_sessions(parts: DataFrame) -> DataFrame:
    """Session parts -> per-user totals, session means and churn label."""
    return parts.groupBy("userId").agg(
        F.max("_churn").alias("churn"),
        F.sum("_listens").cast("int").alias("most_listens_one_month"),
        *[F.sum(s).cast("long").alias(t) for s, t in zip(SESSION_MEASURES, TOTAL_MEASURES)],
        *[F.avg(s).alias(m) for s, m in zip(SESSION_MEASURES, MEAN_MEASURES)],
    )


def session_rollup(events: DataFrame, roles: PageRoles = DEFAULT_ROLES, fanout: bool = False) -> DataFrame:
    """Session branch: per-user totals, session means and churn label."""
    return rollup_sessions(session_parts(events, roles, fanout))


def gender_pairs(events: DataFrame) -> DataFrame:
    """Distinct (userId, gender) pairs: strings as hash-aggregate keys.

    The filter on the count keeps the optimizer from removing the pairs
    below a later maximum, which would then sort all events.
    """
    pairs = events.groupBy("userId", "gender").agg(F.count(F.lit(1)).alias("_n"))
    return pairs.where(F.col("_n") > 0).select("userId", "gender")


def max_gender(pairs: DataFrame) -> DataFrame:
    """``(userId, gender)`` = max gender per user, from distinct pairs."""
    return pairs.groupBy("userId").agg(F.max("gender").alias("gender"))


def user_gender(events: DataFrame) -> DataFrame:
    """``(userId, gender)`` = max gender per user, via distinct pairs (hash aggregate)."""
    return max_gender(gender_pairs(events))


def assemble_matrix(
    session_users: DataFrame, day_maxima: DataFrame, genders: DataFrame, keep_users_without_days: bool = False
) -> DataFrame:
    """JN4: join the three user-grain tables into the 18 matrix columns.

    Inner joins, as in the reference (every user has an active day). With
    listening days only, a user may have none: ``keep_users_without_days``
    keeps such users with day features 0.
    """
    if keep_users_without_days:
        days = session_users.join(day_maxima, "userId", "left").fillna(
            0, ["most_days_since_last_listen", "most_days_consec_listen"]
        )
    else:
        days = session_users.join(day_maxima, "userId")
    return days.join(genders, "userId").select(*USER_MATRIX_COLUMNS)


def user_churn(events: DataFrame, roles: PageRoles = DEFAULT_ROLES) -> DataFrame:
    """``(userId, churn)`` = max churn-event flag per user."""
    return events.select("userId", churn_flag("page", roles.churn).alias("c")).groupBy("userId").agg(
        F.max("c").alias("churn")
    )


def user_attributes(events: DataFrame, roles: PageRoles = DEFAULT_ROLES) -> DataFrame:
    """AGG9: ``(userId, gender, churn)`` - max gender, max churn-event flag."""
    return user_gender(events).join(user_churn(events, roles), "userId").select("userId", "gender", "churn")


def user_totals(events: DataFrame, roles: PageRoles = DEFAULT_ROLES, fanout: bool = False) -> DataFrame:
    """AGG6: per-user maxima of the window features and totals of the flags."""
    return user_matrix(events, roles, fanout, gender=False).select("userId", *USER_MATRIX_COLUMNS[3:12])


def matrix_base(events: DataFrame, roles: PageRoles = DEFAULT_ROLES, fanout: bool = False, gender: bool = True) -> DataFrame:
    """One partial aggregate per (userId, sessionId, date, gender)."""
    extra = ["gender"] if gender else []
    ev = flagged(events.select("userId", "sessionId", "ts", "page", *extra), roles, fanout, extra)
    return ev.withColumn("date", event_date("ts")).groupBy("userId", "sessionId", "date", *extra).agg(
        *[F.sum(F.col(f"w_{c}")).cast("long").alias(m) for c, m in zip(FLAG_COLUMNS, SESSION_MEASURES)],
        F.sum("listen_flag").cast("long").alias("_listens"),
        F.max("churn").alias("_churn"),
    )


def user_matrix(
    events: DataFrame,
    roles: PageRoles = DEFAULT_ROLES,
    fanout: bool = False,
    only_listen_days: bool = False,
    intended: bool = False,
    gender: bool = True,
) -> DataFrame:
    """JN4: the 18-column user matrix, one row per user.

    ``only_listen_days`` takes the day features over listening days (0 for
    users without one). ``intended=True`` appends
    ``most_listens_in_month``, ``longest_streak_days`` and
    ``most_days_without_listen``, the values the feature names describe.
    ``gender=False`` leaves that column out, for callers that do not need
    the attribute source.
    """
    base = matrix_base(events, roles, fanout, gender)
    by_day = Window.partitionBy("userId").orderBy("date")
    before = by_day.rowsBetween(Window.unboundedPreceding, -1)
    listened = F.when(F.col("_listens") > 0, F.col("date"))
    # rows of one day follow each other: only the first of a day has a gap
    day = listened if only_listen_days else F.col("date")
    last = F.last(day, ignorenulls=True).over(before) if only_listen_days else F.lag("date").over(by_day)
    rows = base.withColumn("_gap", F.when(day.isNotNull(), days_between("date", last)))
    sessions = F.count_distinct(F.coalesce("sessionId", F.lit(NO_SESSION)))
    columns = {
        "churn": F.max("_churn"),
        "most_listens_one_month": F.sum("_listens").cast("int"),
        "most_days_since_last_listen": F.coalesce(F.max("_gap"), F.lit(0)),
        "most_days_consec_listen": F.coalesce(F.sum((F.col("_gap") == 1).cast("int")), F.lit(0)).cast("long"),
        **{t: F.sum(m).cast("long") for m, t in zip(SESSION_MEASURES, TOTAL_MEASURES)},
        **{a: F.sum(m) / sessions for m, a in zip(SESSION_MEASURES, MEAN_MEASURES)},
    }
    if gender:
        columns["gender"] = F.max("gender")
    if intended:
        by_month = Window.partitionBy("userId", F.trunc("date", "month"))
        rows = rows.withColumn("_month", F.sum("_listens").over(by_month))
        silent = F.when(listened.isNotNull(), days_between("date", F.last(listened, ignorenulls=True).over(before)))
        rows = rows.withColumn("_silent", silent)
        # days of one run share the date less its rank
        run = F.date_sub("date", F.dense_rank().over(by_day))
        first = F.coalesce(F.lag("date").over(by_day) != F.col("date"), F.lit(True)).cast("int")
        rows = rows.withColumn("_run", run).withColumn("_first", first)
        rows = rows.withColumn("_streak", F.sum("_first").over(Window.partitionBy("userId", "_run")))
        columns["most_listens_in_month"] = F.max("_month")
        columns["longest_streak_days"] = F.max("_streak")
        columns["most_days_without_listen"] = F.coalesce(F.max("_silent"), F.lit(0))
    out = rows.groupBy("userId").agg(*[c.alias(n) for n, c in columns.items()])
    return out.select(*[c for c in (*USER_MATRIX_COLUMNS, *INTENDED_COLUMNS) if c in out.columns])


def thumbs_up_by_period(events: DataFrame, roles: PageRoles = DEFAULT_ROLES) -> DataFrame:
    """EXT1: thumbs-up count per user per day, week (Monday) and month.

    Long form ``(userId, grain, period_start, n_thumbs_up)``. Thumbs-up
    events are first counted per (user, day) - filter pushed to the scan,
    partial aggregate - and the day counts are then rolled up to each
    grain, so only the day-grain table is expanded threefold.
    """
    daily = (
        events.where(F.col("page") == F.lit(roles.thumbs_up))
        .select("userId", event_date("ts").alias("date"))
        .groupBy("userId", "date")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grains = daily.withColumn("grain", F.explode(F.array(F.lit("day"), F.lit("week"), F.lit("month"))))
    start = (
        F.when(F.col("grain") == "day", period_start("date", "day"))
        .when(F.col("grain") == "week", period_start("date", "week"))
        .otherwise(period_start("date", "month"))
    )
    return (
        grains.select("userId", "grain", start.alias("period_start"), "n")
        .groupBy("userId", "grain", "period_start")
        .agg(F.sum("n").cast("long").alias("n_thumbs_up"))
    )


def thumbs_ratio(events: DataFrame, roles: PageRoles = DEFAULT_ROLES) -> DataFrame:
    """EXT2: thumbs-up to thumbs-down ratio per user (null without thumbs-down)."""
    ev = events.select(
        "userId",
        page_flag("page", roles.thumbs_up).alias("u"),
        page_flag("page", roles.thumbs_down).alias("d"),
    )
    return (
        ev.groupBy("userId")
        .agg(F.sum("u").cast("long").alias("total_thumbsU"), F.sum("d").cast("long").alias("total_thumbsD"))
        .withColumn("thumbs_ratio", F.try_divide(F.col("total_thumbsU").cast("double"), F.col("total_thumbsD")))
    )
