"""Profiling ("look at the data"): PRF1-PRF5.

Each profile is one aggregate over the frame, returned as a DataFrame;
no driver loop, and all columns are profiled in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shape(df: DataFrame) -> DataFrame:
    """PRF1: ``(n_rows, n_cols)`` of a frame, one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)).cast("int"))


def schema_profile(spark: SparkSession, df: DataFrame) -> DataFrame:
    """PRF2: ``(position, column, type, nullable)`` from the frame's schema.

    Built from schema metadata only; no data is read.
    """
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    schema = T.StructType(
        [
            T.StructField("position", T.IntegerType(), False),
            T.StructField("column", T.StringType(), False),
            T.StructField("type", T.StringType(), False),
            T.StructField("nullable", T.BooleanType(), False),
        ]
    )
    return spark.createDataFrame(rows, schema)


def first_rows(df: DataFrame, n: int = 1) -> DataFrame:
    """PRF2: a peek at the first rows (``take(1)`` as a frame)."""
    return df.limit(n)


def distinct_values(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """PRF3: distinct values of a column, ordered (nulls first), optionally the first ``n``.

    Distinct first, then order, then limit: ordering before a distinct
    (as the reference did) is lost in the shuffle.
    """
    out = df.select(column).distinct().orderBy(F.col(column).asc_nulls_first())
    return out.limit(n) if n is not None else out


def distinct_counts(df: DataFrame, columns: Sequence[str], approx: bool = False, rsd: float = 0.05) -> DataFrame:
    """PRF4: number of distinct non-null values of each column, one row.

    ``approx=True`` uses HyperLogLog++ (``approx_count_distinct``), whose
    state is a fixed-size sketch per partition: no shuffle of the values.
    """
    if approx:
        aggs = [F.approx_count_distinct(c, rsd).alias(f"n_distinct_{c}") for c in columns]
    else:
        aggs = [F.count_distinct(c).alias(f"n_distinct_{c}") for c in columns]
    return df.agg(*aggs)


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """PRF5: null count of every column in one pass, one row ``n_null_<col>``."""
    cols = list(columns) if columns is not None else df.columns
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_null_{c}") for c in cols])
