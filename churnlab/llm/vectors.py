"""Reading embedding columns: which vectors count, and blocks of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not zero, and every component a finite number."""
    values = vector.cast("array<double>")
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad & F.exists(values, lambda x: x != 0), F.lit(False))


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of double), dims of the usable vectors with an id."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("dims", F.size("v"))


def matrix(column) -> np.ndarray:
    """A pandas column of equally long lists as one float64 matrix."""
    return np.ascontiguousarray(np.stack([np.asarray(x, np.float64) for x in column])) if len(column) else np.zeros((0, 0))


def ordered_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed component by component from the first.

    One fixed order of additions: equal vectors give equal sums wherever
    they are, and SQL that sums in order gives the same double.
    """
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total
