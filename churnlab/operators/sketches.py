"""Stored distinct counts (PRF4 for any period): one HyperLogLog sketch per day.

A day's sketches are a few kilobytes whatever the number of its events. They
are written once a day; the distinct users of any period are the union of
its days' sketches, with no look at the events. Sketches merge in any order
and repeated events change nothing, so a day may be written again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlab.functions import event_date

#: log2 of a sketch's registers: a standard error of about 0.8 %, exact for small sets.
PRECISION = 14


def daily_sketches(events: DataFrame, columns: Sequence[str], precision: int = PRECISION) -> DataFrame:
    """``(date, sketch_<column>...)``: partial sketches per task, merged per UTC date."""
    dated = events.select(event_date("ts").alias("date"), *columns)
    return dated.groupBy("date").agg(*[F.hll_sketch_agg(c, precision).alias(f"sketch_{c}") for c in columns])


def store_sketches(sketches: DataFrame, path: str) -> None:
    """Write days below ``path``, one folder a date; days written before are replaced."""
    writer = sketches.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("date").parquet(path)


def read_sketches(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The stored days from ``first`` to ``last``; other dates' folders are not read."""
    days = spark.read.parquet(path)
    if first is not None:
        days = days.where(F.col("date") >= F.lit(first).cast("date"))
    if last is not None:
        days = days.where(F.col("date") <= F.lit(last).cast("date"))
    return days


def distinct_from_sketches(days: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(*by, n_distinct_<column>...)``: estimates for the union of days, by columns of ``days``."""
    return days.groupBy(*by).agg(*[F.hll_sketch_estimate(F.hll_union_agg(f"sketch_{c}")).alias(f"n_distinct_{c}") for c in columns])
