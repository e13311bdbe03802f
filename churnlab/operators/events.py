"""Event-grain filters and derived columns (FLT1, FLT2, PRJ2, SCL*).

Every function here is a narrow transformation: no shuffle, and filters
on raw columns are pushed into the parquet / JSON scan by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlab.functions import (
    churn_flag,
    event_date,
    event_day,
    event_hour,
    event_month,
    event_year,
    page_flag,
    state,
)
from churnlab.schema import DEFAULT_ROLES, PageRoles


def drop_blank_users(events: DataFrame) -> DataFrame:
    """FLT1: drop events whose userId is blank; null ids go too."""
    return events.where(F.col("userId") != F.lit(""))


def keep_page(events: DataFrame, page: str) -> DataFrame:
    """FLT2: keep events of one page."""
    return events.where(F.col("page") == F.lit(page))


def with_time_parts(events: DataFrame) -> DataFrame:
    """SCL2 + SCL3: UTC hour, day of month, month, year and date of ``ts``."""
    return events.withColumns(
        {
            "hour": event_hour("ts"),
            "day": event_day("ts"),
            "month": event_month("ts"),
            "year": event_year("ts"),
            "date": event_date("ts"),
        }
    )


def with_state(events: DataFrame) -> DataFrame:
    """SCL1: ``state`` from ``location``."""
    return events.withColumn("state", state("location"))


def with_flags(events: DataFrame, roles: PageRoles = DEFAULT_ROLES) -> DataFrame:
    """SCL4 + SCL5: the six page flags and the churn-event flag, one projection."""
    cols = {name: page_flag("page", page) for name, page in roles.flag_pages().items()}
    cols["churn"] = churn_flag("page", roles.churn)
    return events.withColumns(cols)
