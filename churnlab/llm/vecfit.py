"""Packing documents into sequences by vector best fit.

A piece of a document is a vector: its tokens, one document, and its
attention cost, the square of its length. A sequence has a capacity in each
dimension. Pieces go from the longest to the shortest into the open
sequence where they fit in every dimension and leave the smallest weighted
residual norm (``score="norm"``), or whose residual has the largest weighted
dot product with them (``score="dot"``); where none fits, a new one opens.
The query asks for the fewest sequences of 2048 tokens: there only the token
capacity binds, and documents and attention act through the score.

Pieces of one length are equal vectors, so the choice is made for all of
them at once from the table of lengths, and sequences with equal contents
are one group: the plan has a size bounded by the capacity, not by the
data. Spark counts the lengths, numbers the pieces of each length (in
buckets, so a length shared by a third of all pieces is no single group)
and joins each number with its place in the plan.

Defined cases: a null text is empty and has its end id alone; repeated rows
are packed each; only documents longer than a sequence are cut, into full
pieces behind a first one that may be shorter; an empty table gives no
rows. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlab.llm.common import checkpointed, give_back, partitions, ship
from churnlab.llm.tokens import column_chunks, encoder

TOKENS = 2048
#: Pieces of one length in a task's window: a share of all, within these bounds.
BUCKET_ROWS, LEAST_ROWS = 4000, 250
#: Bytes of text encoded at once, and words that a worker holds: packing runs in
#: workers that other stages have used, beside a heap that they have filled.
ENCODE_BYTES, CACHE_WORDS = 1 << 20, 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(total: int, limit: int) -> list[tuple[int, int]]:
    """(start, end) of a document's pieces; only the first may be shorter."""
    count = max(1, -(-total // limit))
    first = total - (count - 1) * limit
    edges = [0, *range(first, total + 1, limit)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end: int, limit: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    give_back()
    encode = encoder(path, CACHE_WORDS).encode
    for batch in batches:
        doc_ids = batch.column(0).to_pylist()
        for first, texts in column_chunks(batch.column(1), ENCODE_BYTES):
            ids, offsets = encode(texts, end)
            ids = ids.astype("<u4")
            rows, parts = [], []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                for n, (s, t) in enumerate(cut(b - a, limit)):
                    part = ids[a + s : a + t]
                    rows.append((doc_ids[first + i], n, s, t - s, zlib.crc32(part.tobytes())))
                    if with_ids:
                        parts.append(part.view(np.int32))
            columns = dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), zip(*rows, strict=True), strict=True))
            types = {"piece": pa.int32()}
            arrays = {k: pa.array(v, types.get(k, pa.int64())) for k, v in columns.items()}
            if with_ids:
                arrays["ids"] = pa.array(parts, pa.list_(pa.int32()))
            yield pa.record_batch(arrays)
        give_back()


def pieces(docs: DataFrame, tokenizer: str, end: int = 0, limit: int = TOKENS, with_ids: bool = False) -> DataFrame:
    """The pieces of every document, with their ids if asked for."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(partial(_pieces, path=tokenizer, end=end, limit=limit, with_ids=with_ids), schema)


class _Plan:
    """Groups of sequences with equal residuals, and where pieces went."""

    def __init__(self, capacity, weights, score):
        self.capacity, self.score = np.asarray(capacity, float), score
        self.weights = np.asarray(weights, float) / self.capacity**2
        self.first, self.count, self.used = [], [], []
        self.residual = np.zeros((0, 3))
        self.sequences, self.slots = 0, []

    def best(self, item: np.ndarray) -> int | None:
        open_ = np.flatnonzero((np.asarray(self.count) > 0) & (self.residual >= item).all(axis=1)) if self.count else []
        if not len(open_):
            return None
        left = self.residual[open_]
        if self.score == "dot":
            return int(open_[(left * item * self.weights).sum(axis=1).argmax()])
        return int(open_[(((left - item) ** 2) * self.weights).sum(axis=1).argmin()])

    def group(self, first: int, count: int, residual: np.ndarray, used: int) -> None:
        self.first.append(first)
        self.count.append(count)
        self.used.append(used)
        self.residual = np.vstack([self.residual, residual])

    def place(self, length: int, number: int) -> None:
        item, lo = np.array([length, 1, length * length], float), 0
        while number > 0:
            g = self.best(item)
            if g is None:
                each = int((self.capacity / item).min())
                need = -(-number // each)
                self.group(self.sequences, need, self.capacity.copy(), 0)
                self.sequences += need
                g = len(self.first) - 1
            each = max(1, int((self.residual[g] / item).min()))
            # whole sequences of the group take `each`, a last one the rest
            full = min(self.count[g], number // each)
            taken = [(full, each)] if full else [(1, number)]
            for bins, per in taken:
                first, used = self.first[g], self.used[g]
                self.slots.append((length, lo, lo + bins * per, first, per, used))
                lo, number = lo + bins * per, number - bins * per
                self.first[g] += bins
                self.count[g] -= bins
                self.group(first, bins, self.residual[g] - per * item, used + per * length)

    def close(self, smallest: int) -> None:
        """Forget groups that nothing more fits into."""
        keep = (np.asarray(self.count) > 0) & (self.residual[:, 0] >= smallest) & (self.residual[:, 1] >= 1)
        at = np.flatnonzero(keep)
        self.first, self.count, self.used = ([x[i] for i in at] for x in (self.first, self.count, self.used))
        self.residual = self.residual[at]


def plan(lengths: dict[int, int], tokens: int = TOKENS, documents: int | None = None, attention: int | None = None, weights=(1.0, 1.0, 1.0), score: str = "norm") -> tuple[list[tuple], int]:
    """Slots (length, lo, hi, first sequence, per sequence, offset) and the number of sequences."""
    out = _Plan((tokens, documents or tokens, attention or tokens * tokens), weights, score)
    smallest = min(lengths, default=0)
    for length in sorted(lengths, reverse=True):
        out.place(length, lengths[length])
        if out.count:
            out.close(smallest)
    return out.slots, out.sequences


def pack(parts: DataFrame, tokens: int = TOKENS, **capacities) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...)."""
    spark = parts.sparkSession
    # at most `tokens` lengths, whatever the number of pieces
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, _ = plan(counts, tokens, **capacities)
    share = min(BUCKET_ROWS, max(LEAST_ROWS, sum(counts.values()) // (4 * partitions(spark))))
    sizes = spark.createDataFrame([(k, -(-n // share)) for k, n in counts.items()], "length long, buckets long")
    dealt = parts.join(F.broadcast(sizes), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.col("buckets")))
    dealt = dealt.drop("buckets")
    ordered = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    starts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(ordered) - 1).join(starts, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("before", "bucket")
    table = spark.createDataFrame(slots, "slot_length long, lo long, hi long, first long, per long, used long")
    here = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    # the plan's size is bounded by the lengths there are, at most `tokens`
    placed = ranked.join(F.broadcast(table), here)
    at = F.col("rank") - F.col("lo")
    placed = placed.withColumn("sequence_id", F.col("first") + F.floor(at / F.col("per")))
    placed = placed.withColumn("offset", F.col("used") + F.pmod(at, F.col("per")) * F.col("length"))
    return placed.select(*parts.columns, "sequence_id", "offset")


def packed_documents(docs: DataFrame, tokenizer: str, end: int = 0, tokens: int = TOKENS) -> DataFrame:
    return pack(checkpointed(pieces(docs, tokenizer, end, tokens)), tokens)
