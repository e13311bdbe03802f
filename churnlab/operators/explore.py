"""Exploratory aggregates and listings (AGG1-AGG4, AGG10, AGG12-AGG15, SRT1, SRT2).

All aggregates are hash aggregates with a partial (map-side) step; their
group counts are bounded (pages, states, hours, days, months, classes),
so after the partial step the shuffle carries at most a few hundred rows
per map task whatever the input size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlab.functions import event_day, event_hour, event_month, event_year, state
from churnlab.operators.events import keep_page
from churnlab.schema import DEFAULT_ROLES, PageRoles

# The eight matrix fields compared between churned and other users.
COHORT_FIELDS = (
    "avg_sess_listens",
    "avg_sess_thU",
    "avg_sess_thD",
    "avg_sess_err",
    "avg_sess_addP",
    "avg_sess_addF",
    "most_days_since_last_listen",
    "most_days_consec_listen",
)

TIME_PARTS = {"hour": event_hour, "day": event_day, "month": event_month, "year": event_year}


def page_visits(events: DataFrame) -> DataFrame:
    """AGG1: visits per page, ``count(userId)`` - run before blank users are dropped."""
    return events.groupBy("page").agg(F.count("userId").alias("count_visits"))


def listens_by_state(events: DataFrame, roles: PageRoles = DEFAULT_ROLES) -> DataFrame:
    """AGG2 + SRT1: listens per state, most first, ties by state."""
    return (
        keep_page(events, roles.listen)
        .groupBy(state("location").alias("state"))
        .agg(F.count("userId").alias("count"))
        .orderBy(F.desc("count"), F.asc_nulls_first("state"))
    )


def users_by_state(events: DataFrame, roles: PageRoles = DEFAULT_ROLES) -> DataFrame:
    """AGG3: listening users per state, each user counted once at its last known state.

    ``max_by(state, (ts, seq))`` replaces the reference's arbitrary row per
    user (Q14). Two aggregates, both with map-side combine.
    """
    per_user = (
        keep_page(events, roles.listen)
        .groupBy("userId")
        .agg(F.max_by(state("location"), F.struct("ts", "seq")).alias("state"))
    )
    return (
        per_user.groupBy("state")
        .agg(F.count("userId").alias("count"))
        .orderBy(F.desc("count"), F.asc_nulls_first("state"))
    )


def listens_by(events: DataFrame, part: str, roles: PageRoles = DEFAULT_ROLES) -> DataFrame:
    """AGG4: listens per hour / day / month / year, in part order."""
    fn = TIME_PARTS[part]
    return (
        keep_page(events, roles.listen)
        .groupBy(fn("ts").alias(part))
        .agg(F.count("userId").alias("n_listens"))
        .orderBy(part)
    )


def listens_by_part_long(events: DataFrame, parts: Sequence[str] = ("hour", "day", "month"), roles: PageRoles = DEFAULT_ROLES) -> DataFrame:
    """AGG15: chart data of AGG4 in long form ``(part, value, n_listens)``.

    One scan and one aggregate for all parts: each listen is expanded to
    one row per part before the partial aggregate.
    """
    pairs = F.array(*[F.struct(F.lit(p).alias("part"), TIME_PARTS[p]("ts").alias("value")) for p in parts])
    return (
        keep_page(events, roles.listen)
        .select("userId", F.inline(pairs))
        .groupBy("part", "value")
        .agg(F.count("userId").alias("n_listens"))
    )


def class_balance(matrix: DataFrame) -> DataFrame:
    """AGG10: users per churn class."""
    return matrix.groupBy("churn").agg(F.count(F.lit(1)).alias("n_users"))


def cohort_stats(matrix: DataFrame, fields: Sequence[str] = COHORT_FIELDS) -> DataFrame:
    """AGG12: mean and sample standard deviation of each field by churn class."""
    aggs: list[Column] = []
    for f in fields:
        aggs += [F.avg(f).alias(f"{f}_mean"), F.stddev_samp(f).alias(f"{f}_std")]
    return matrix.groupBy("churn").agg(*aggs)


def cohort_means_long(matrix: DataFrame, fields: Sequence[str] = COHORT_FIELDS) -> DataFrame:
    """AGG13: ``(churn, field, mean)``, keyed by the label value itself (Q19)."""
    means = matrix.groupBy("churn").agg(*[F.avg(f).alias(f) for f in fields])
    return means.unpivot("churn", list(fields), "field", "mean")


def churn_by_gender(matrix: DataFrame) -> DataFrame:
    """AGG14: users by churn class and gender."""
    return matrix.groupBy("churn", "gender").agg(F.count(F.lit(1)).alias("n_users"))


def top_n(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """SRT2: first ``n`` rows by a full ordering (give a complete tie-break)."""
    return df.orderBy(*order).limit(n)
