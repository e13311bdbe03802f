"""Scalar column functions (SCL1-SCL10) as Catalyst expressions.

No Python UDF anywhere: every helper returns a ``Column`` built from
``pyspark.sql.functions`` so it stays inside whole-stage codegen and
does not block predicate pushdown.

Time parts are derived arithmetically from epoch milliseconds, so they
are UTC whatever ``spark.sql.session.timeZone`` is set to.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

MS_PER_HOUR = 3_600_000
MS_PER_DAY = 86_400_000


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def state(location: str | Column = "location") -> Column:
    """SCL1: last two characters of the location (``'LA, CA'`` -> ``'CA'``).

    Multi-state metros (``'... NY-NJ-PA'``) give the last state. One
    character gives itself, empty gives empty, null gives null.
    """
    return F.right(_c(location), F.lit(2))


def unix_day(ts: str | Column = "ts") -> Column:
    """Days since 1970-01-01 (UTC) of an epoch-millisecond timestamp."""
    return F.floor(_c(ts) / F.lit(MS_PER_DAY)).cast("int")


def event_date(ts: str | Column = "ts") -> Column:
    """SCL3: UTC calendar date of an epoch-millisecond timestamp."""
    return F.date_from_unix_date(unix_day(ts))


def event_hour(ts: str | Column = "ts") -> Column:
    """SCL2: UTC hour of day, 0-23."""
    return F.pmod(F.floor(_c(ts) / F.lit(MS_PER_HOUR)), F.lit(24)).cast("int")


def event_day(ts: str | Column = "ts") -> Column:
    """SCL2: UTC day of month."""
    return F.dayofmonth(event_date(ts))


def event_month(ts: str | Column = "ts") -> Column:
    """SCL2: UTC month number."""
    return F.month(event_date(ts))


def event_year(ts: str | Column = "ts") -> Column:
    """SCL2: UTC year."""
    return F.year(event_date(ts))


def event_time(ts: str | Column = "ts") -> Column:
    """Epoch milliseconds as a Spark timestamp (an instant)."""
    return F.timestamp_millis(_c(ts))


def page_flag(page: str | Column, value: str) -> Column:
    """SCL4: 1 when the page equals ``value``, else 0 (null page -> 0)."""
    return F.coalesce(_c(page) == F.lit(value), F.lit(False)).cast("int")


def churn_flag(page: str | Column, pages: Iterable[str]) -> Column:
    """SCL5: 1 when the page is one of the churn pages, else 0."""
    return F.coalesce(_c(page).isin(list(pages)), F.lit(False)).cast("int")


def next_day_flag(date: str | Column, prev_date: str | Column) -> Column:
    """SCL6: 1 when ``date`` is the calendar day after ``prev_date``.

    A missing previous day (first day of a user) gives 0, never null.
    """
    return F.coalesce(_c(date) == F.date_add(_c(prev_date), 1), F.lit(False)).cast("int")


def days_between(later: str | Column, earlier: str | Column) -> Column:
    """SCL8: ``datediff``."""
    return F.datediff(_c(later), _c(earlier))


def month_start(date: str | Column = "date") -> Column:
    """SCL9: first day of the month of a date."""
    return F.trunc(_c(date), "month")


def period_start(date: str | Column, grain: str) -> Column:
    """Start date of the day / week (Monday) / month containing ``date``."""
    if grain == "day":
        return _c(date)
    if grain == "week":
        return F.trunc(_c(date), "week")
    if grain == "month":
        return F.trunc(_c(date), "month")
    raise ValueError(f"unknown grain {grain!r}")


def hash_percent(key: str | Column) -> Column:
    """Stable 0-99 bucket of a string key: first 32 bits of its MD5, mod 100.

    Depends only on the key, never on partition layout, so splits built
    on it are reproducible across runs and cluster sizes.
    """
    return F.pmod(F.conv(F.substring(F.md5(_c(key)), 1, 8), 16, 10).cast("long"), F.lit(100)).cast("int")
