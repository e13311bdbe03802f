"""Exact order statistics by counted key ranges (distributed selection).

The r-th smallest key of each group without sorting a group: keys are
counted by their leading bits, the running counts name the range that holds
rank r, and the next round counts inside that range by the next bits. A
round is one hash aggregate with map-side partial counts; a range has at most
``2 ** STEP`` cells a group, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlab.session import ensure_checkpoint_dir

#: Bits of a key, and bits settled in a round.
BITS, STEP = 60, 12


def hash_key(key: str | Column) -> Column:
    """The first 60 bits of a string key's MD5 as a long; depends on the key only."""
    return F.conv(F.substring(F.md5(F.col(key) if isinstance(key, str) else key), 1, BITS // 4), 16, 10).cast("long")


def order_statistics(df: DataFrame, by: Sequence[str], key: str, rank: Callable[[Column], Column]) -> DataFrame:
    """``(*by, value)``: the key of rank ``rank(n)`` (from 1) of each group of ``n`` keys.

    Keys are longs from 0 below ``2 ** 60``; null keys do not count. Equal
    keys take as many ranks as there are rows. A rank outside 1..n gives no
    row. ``df`` is read once a round, so it should be stored.
    """
    ensure_checkpoint_dir(df.sparkSession)
    groups = [f"_g{i}" for i in range(len(by))]
    rows = df.where(F.col(key).isNotNull()).select(*[F.col(c).alias(g) for c, g in zip(by, groups)], F.col(key).alias("_key"))
    found = rows.groupBy(*groups).agg(rank(F.count(F.lit(1))).cast("long").alias("_rank"))
    for shift in range(BITS - STEP, -1, -STEP):
        cells = rows.withColumn("_cell", F.shiftright("_key", shift))
        if shift < BITS - STEP:
            # the range is part of the join key, so a large group is spread over its ranges
            left = cells.withColumn("_range", F.shiftright("_key", shift + STEP))
            right = found.select(*[F.col(g).alias(f"{g}_") for g in groups], F.col("_prefix"))
            same = F.col("_range") == F.col("_prefix")
            for g in groups:
                same = same & F.col(g).eqNullSafe(F.col(f"{g}_"))
            cells = left.join(right, same, "left_semi")
        counts = cells.groupBy(*groups, "_cell").agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_cell"))
        counts = counts.withColumn("_upto", upto)
        ranks = found.select(*[F.col(g).alias(f"{g}_") for g in groups], "_rank")
        same = (F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank"))
        for g in groups:
            same = same & F.col(g).eqNullSafe(F.col(f"{g}_"))
        found = counts.join(ranks, same).select(*groups, (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"), F.col("_cell").alias("_prefix"))
        # one row a group; the next round starts from it
        found = found.checkpoint(eager=True)
    return found.select(*[F.col(g).alias(c) for c, g in zip(by, groups)], F.col("_prefix").alias("value"))
