"""User-day features (AGG5, WIN1, WIN1b, WIN2, WIN2b, SRT5).

Events are first reduced to one row per active (userId, date) with a
partial (map-side) aggregate, and only then windowed per user. A user's
day count is bounded by the calendar, so the per-user window never holds
more than a few thousand rows even when one user owns a large share of
all events, and the event volume is shuffled once, already reduced.


* Q1 - the day table holds every *active* day, listening or not;
  ``only_listen_days=True`` gives the intended listening-day form.
* Q2 - the adjacency flag is 0 (never null) on a user's first day.
* Q3 - ``days_consec_listen`` is a running sum that never resets, so its
  per-user maximum is the number of adjacent-day pairs. The intended
  longest streak is ``longest_streak``.
* Q4 - ``days_since_last_listen`` is the gap to the previous active day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlab.functions import days_between, event_date, next_day_flag, page_flag
from churnlab.schema import DEFAULT_ROLES, PageRoles

_RUNNING = (Window.unboundedPreceding, Window.currentRow)


def user_days(events: DataFrame, roles: PageRoles = DEFAULT_ROLES, only_listen_days: bool = False) -> DataFrame:
    """AGG5: ``(userId, date, listen_flag)``, one row per active day."""
    days = (
        events.select("userId", event_date("ts").alias("date"), page_flag("page", roles.listen).alias("listen_flag"))
        .groupBy("userId", "date")
        .agg(F.max("listen_flag").alias("listen_flag"))
    )
    if only_listen_days:
        days = days.where(F.col("listen_flag") == 1)
    return days


def day_features(days: DataFrame) -> DataFrame:
    """WIN1 + WIN2 on a day table, one window pass per user.

    Adds ``prev_day``, ``date_group`` (adjacent-day flag),
    ``days_consec_listen`` (running sum of the flag) and
    ``days_since_last_listen`` (days since the previous row, first 0).
    """
    w = Window.partitionBy("userId").orderBy("date")
    return (
        days.withColumn("prev_day", F.lag("date").over(w))
        .withColumn("date_group", next_day_flag("date", "prev_day"))
        .withColumn("days_consec_listen", F.sum("date_group").over(w.rowsBetween(*_RUNNING)))
        .withColumn("days_since_last_listen", F.coalesce(days_between("date", "prev_day"), F.lit(0)))
    )


def consecutive_days(events: DataFrame, roles: PageRoles = DEFAULT_ROLES, only_listen_days: bool = False) -> DataFrame:
    """WIN1: ``(userId, date, prev_day, date_group, days_consec_listen)``."""
    return day_features(user_days(events, roles, only_listen_days)).select(
        "userId", "date", "prev_day", "date_group", "days_consec_listen"
    )


def days_since_last(events: DataFrame, roles: PageRoles = DEFAULT_ROLES, only_listen_days: bool = False) -> DataFrame:
    """WIN2: ``(userId, date, days_since_last_listen)``."""
    return day_features(user_days(events, roles, only_listen_days)).select("userId", "date", "days_since_last_listen")


def longest_streak(days: DataFrame) -> DataFrame:
    """WIN1b: longest run of consecutive days per user (gaps and islands).

    Days of one run share ``date - row_number``; the run length is the
    size of that island. Users with no day in ``days`` are absent.
    """
    w = Window.partitionBy("userId").orderBy("date")
    islands = days.select("userId", F.date_sub("date", F.row_number().over(w)).alias("island"))
    return (
        islands.groupBy("userId", "island")
        .agg(F.count("*").alias("run"))
        .groupBy("userId")
        .agg(F.max("run").alias("longest_streak_days"))
    )


def listen_gaps(days: DataFrame) -> DataFrame:
    """WIN2b: largest gap in days between two listening days, per user.

    Runs over every active day and looks back to the last listening day
    only, so users without any listening day stay in the result with 0.
    """
    w = Window.partitionBy("userId").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    listen_date = F.when(F.col("listen_flag") == 1, F.col("date"))
    prev_listen = F.last(listen_date, ignorenulls=True).over(w)
    gap = F.when(F.col("listen_flag") == 1, days_between("date", prev_listen))
    return (
        days.select("userId", gap.alias("gap"))
        .groupBy("userId")
        .agg(F.coalesce(F.max("gap"), F.lit(0)).alias("most_days_without_listen"))
    )


def day_user_maxima(days: DataFrame) -> DataFrame:
    """Per-user maxima of the day features (used by the user matrix)."""
    return (
        day_features(days)
        .groupBy("userId")
        .agg(
            F.max("days_since_last_listen").alias("most_days_since_last_listen"),
            F.max("days_consec_listen").alias("most_days_consec_listen"),
        )
    )


def streak_listing(events: DataFrame, roles: PageRoles = DEFAULT_ROLES) -> DataFrame:
    """SRT5: one row per (user, listening day) with its running streak value.

    The reference listed listen events joined to the streak column and
    removed duplicates per (user, date); that is the day table restricted
    to days with a listen, here without the join.
    """
    return (
        day_features(user_days(events, roles))
        .where(F.col("listen_flag") == 1)
        .select("userId", "date", "days_consec_listen")
        .orderBy("userId", "date")
    )
