"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import json
import os
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlab.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space of the text contracts: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
TOKEN = r"[^\x20\x09-\x0D]+"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def give_back() -> None:
    """Return memory that a worker has freed to the system.

    A reused Python worker else holds what its earlier tasks had freed, of
    this step or another, beside what the next one takes.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc
        trim(0)


def inline_table(spark: SparkSession, schema: str, rows: list[dict]) -> DataFrame:
    """A small table of driver-side rows as one literal, read on the JVM."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other letter left alone."""
    return F.translate(text, UPPER, UPPER.lower())


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def running_total(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Inclusive running total of ``value`` over all rows in ``order``.

    Rows are range-partitioned once and stored with their partition number;
    the partitions' totals give each partition its start. No task holds
    more than one range partition. ``order`` should be a total order.
    """
    parts = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # one row per range partition, so the broadcast is bounded by the partition count
    joined = parts.join(F.broadcast(starts), "_part")
    return joined.withColumn(out, F.col("_start") + F.sum(value).over(inside)).drop("_part", "_start")
