"""Scalar column functions, all native Catalyst expressions."""

from churnlab.functions.columns import (
    churn_flag,
    days_between,
    event_date,
    event_day,
    event_hour,
    event_month,
    event_time,
    event_year,
    hash_percent,
    month_start,
    next_day_flag,
    page_flag,
    period_start,
    state,
    unix_day,
)

__all__ = [
    "churn_flag",
    "days_between",
    "event_date",
    "event_day",
    "event_hour",
    "event_month",
    "event_time",
    "event_year",
    "hash_percent",
    "month_start",
    "next_day_flag",
    "page_flag",
    "period_start",
    "state",
    "unix_day",
]
