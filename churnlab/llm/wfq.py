"""Mixing sources to target weights by weighted fair queueing.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating,
and share 150 % of all tokens; a target stops at twice its source's size
and the excess is shared again by weight until no target is above.

Every source's documents are shuffled by a hash, once per pass over the
source. A document's virtual finish time is the source's tokens up to and
including it, divided by the source's target. All copies are then sorted
by finish time over all sources, and the mix takes them in that order
while the running total stays within the budget.

A source's running total is taken in two levels: hash buckets of about
``BUCKET_ROWS`` rows, then the buckets' totals, so a source that holds a
third of all rows is no single group. The global order is a range
partitioning with partition totals.

Defined cases: a null text has size 0; documents of size 0 are taken with
0 words; a null source is one source; repeated rows count as they come; an
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlab.llm.common import checkpointed, running_total, token_count

WEIGHTS = (5, 2, 1)
BUCKET_ROWS = 4000


def source_key(source="source"):
    """Sorts by code point with null last, and is never null."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """``target`` of each source from columns skey, source_size.

    Each step shares what is left of the budget among the sources not yet
    stopped. A step is one aggregate over the table of sources.
    """
    ranked = running_total(sources.withColumn("one", F.lit(1)), ["skey"], "one", "rank").drop("one")
    place = ((F.col("rank") - 1) % len(weights)).cast("int")
    ranked = checkpointed(ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1)))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget, full = min(share, most) * total, F.lit(False)
    while True:
        rest = ranked.agg(
            F.coalesce(F.sum(F.when(full, most * F.col("source_size"))), F.lit(0)).alias("stopped"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        left, weight = budget - rest.stopped, rest.weight
        if not weight:
            break
        share_now = F.col("weight") * F.lit(float(left)) / F.lit(float(weight))
        more = full | (most * F.col("source_size") < share_now)
        if ranked.filter(more).count() == rest.n:
            break
        full = more
    due = F.when(full, (most * F.col("source_size")).cast("double"))
    if weight:
        due = due.otherwise(share_now)
    return ranked.withColumn("target", due)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    sizes = docs.select(F.col("doc_id"), source_key().alias("skey"), token_count(F.col("text")).alias("size"))
    sizes = checkpointed(sizes.withColumn("rid", F.monotonically_increasing_id()))
    return mix_sizes(sizes, weights, share, most, seed).drop("rid", "skey")


def mix_sizes(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """``mix`` for rows of rid, doc_id, skey, size; keeps rid and skey."""
    by_source = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = checkpointed(source_targets(by_source, weights, share, most))
    passes = F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(F.col("target") / F.greatest("source_size", F.lit(1))).cast("int")))
    copies = sizes.join(targets, "skey").withColumn("pass", F.explode(F.sequence(F.lit(1), passes)))
    shuffled = F.md5(F.concat_ws("/", F.lit(seed), F.col("pass"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    buckets = F.ceil(F.col("n") / BUCKET_ROWS)
    place = F.conv(F.substring(shuffled, 1, 12), 16, 10).cast("double") / float(1 << 48)
    copies = copies.withColumn("h", shuffled).withColumn("bucket", F.col("pass") * buckets + F.floor(place * buckets))
    copies = checkpointed(copies.select("rid", "doc_id", "skey", "size", "source_size", "target", "pass", "bucket", "h"))

    sums = copies.groupBy("skey", "bucket").agg(F.sum("size").alias("part"))
    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("skey", "bucket", F.coalesce(F.sum("part").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("skey", "bucket").orderBy("h", "doc_id", "rid").rowsBetween(Window.unboundedPreceding, 0)
    queued = copies.withColumn("upto", F.sum("size").over(inside)).join(starts, ["skey", "bucket"])
    finish = F.coalesce((F.col("start") + F.col("upto")) / F.when(F.col("target") > 0, F.col("target")), F.lit(0.0))
    queued = queued.withColumn("finish", finish).drop("start", "upto", "bucket", "h")

    total = sizes.agg(F.sum("size")).first()[0] or 0
    budget = int(min(share, most) * total)
    served = running_total(queued, ["finish", "skey", "doc_id", "pass", "rid"], "size", "served")
    taken = F.sum(F.when(F.col("served") <= budget, F.col("size")).otherwise(0))
    keys = ["rid", "skey", "doc_id", "size", "source_size", "target"]
    return served.groupBy(*keys).agg(taken.alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each taken document once or, where taken twice, twice."""
    # every row has its own id, repeated rows too; stored, so that it stays
    rows = checkpointed(docs.withColumn("_rid", F.monotonically_increasing_id()))
    sizes = rows.select(F.col("_rid").alias("rid"), "doc_id", source_key().alias("skey"), token_count(F.col("text")).alias("size"))
    out = mix_sizes(checkpointed(sizes), **options)
    times = out.filter(F.col("taken") > 0).select(F.col("rid").alias("_rid"), (F.col("taken") / F.col("size")).cast("int").alias("_times"))
    kept = rows.join(times, "_rid")
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)
