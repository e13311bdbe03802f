"""Session totals and per-user session means (AGG7, AGG8).

``fanout=True`` reproduces the reference's inflated sums (Q6): there the
running-listen table was joined back on (userId, ts), so an instant with
``k >= 1`` listens was repeated ``k`` times for every event at it. The
same numbers come from a weight ``greatest(1, k)`` per event, with no
join and no extra rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlab.operators.events import with_flags
from churnlab.schema import DEFAULT_ROLES, FLAG_COLUMNS, MEAN_MEASURES, SESSION_MEASURES, PageRoles


def flagged(events: DataFrame, roles: PageRoles = DEFAULT_ROLES, fanout: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """Events with the six flags and churn flag, and ``w_`` copies to sum.

    Under ``fanout`` the events are first summed per (userId, sessionId, ts
    and ``keys``), then each row is weighted by ``greatest(1, listens at its
    (userId, ts))``; the window moves these sums, not the events.
    """
    ev = with_flags(events, roles)
    if not fanout:
        return ev.withColumns({f"w_{c}": F.col(c) for c in FLAG_COLUMNS})
    sums = [F.sum(c).alias(c) for c in FLAG_COLUMNS]
    ties = ev.groupBy("userId", "sessionId", "ts", *keys).agg(*sums, F.max("churn").alias("churn"))
    weight = F.greatest(F.lit(1), F.sum("listen_flag").over(Window.partitionBy("userId", "ts")))
    return ties.withColumn("_w", weight).withColumns({f"w_{c}": F.col(c) * F.col("_w") for c in FLAG_COLUMNS})


def session_totals(events: DataFrame, roles: PageRoles = DEFAULT_ROLES, fanout: bool = False) -> DataFrame:
    """AGG7: ``(userId, sessionId, sess_listens, ..., sess_addF)`` (bigint sums)."""
    ev = flagged(events.select("userId", "sessionId", "ts", "page"), roles, fanout)
    return ev.groupBy("userId", "sessionId").agg(
        *[F.sum(F.col(f"w_{c}")).cast("long").alias(m) for c, m in zip(FLAG_COLUMNS, SESSION_MEASURES)]
    )


def session_means(sessions: DataFrame) -> DataFrame:
    """AGG8: per-user mean of each session total (double)."""
    return sessions.groupBy("userId").agg(
        *[F.avg(s).alias(m) for s, m in zip(SESSION_MEASURES, MEAN_MEASURES)]
    )
