"""Nearest neighbours by inner product from randomly rotated one-bit codes.

A vector is taken relative to the mean of all vectors, rotated by a random
orthogonal matrix fixed by a seed, and kept as its signs, packed into
64-bit words, with three scalars: the length of the residual, the inner
product of the unit residual with its code, and the inner product with the
mean. A query's rotated residual is quantised to 4 bits, so its inner
product with a code is four ANDs and bit counts a word. Divided by the
code's correction scalar this is an unbiased estimate whose error is
bounded by ``BOUND`` standard deviations.

The search holds blocks of queries against blocks of codes. In each pair of
blocks the best by estimate give a k-th best inner product, and the vectors
whose upper bound reaches it are reranked, with exact inner products in
double precision. A query's best of every block are merged by a grouped
top-k. Every row is indexed and every
code is scanned; the bound is the one thing that can miss a neighbour
(recall is measured in the tests).

Defined cases: unusable vectors (null, zero, null or non-finite
components) take no part; vectors of another length than the query's are
no candidates; ties go to the smaller vec_id; rows with one vec_id are
separate candidates, never their own query's; an empty table gives no
rows. Extra columns are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlab.llm.common import checkpointed, ship
from churnlab.llm.vectors import matrix, ordered_dot, vectors

BOUND = 2.5
#: Vectors beyond k that are looked at first, to find the k-th best.
FIRST = 20
QUERY_BITS = 4
BLOCK = 8192
QUERY_BLOCK = 1024
SEED = 20
OUT = "query_id long, vec_id long, score double"


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same for one seed and length."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dims]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def pack(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words."""
    words = -(-signs.shape[1] // 64)
    padded = np.zeros((len(signs), words * 64), bool)
    padded[:, : signs.shape[1]] = signs
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def encode(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, residual length, <unit residual, code>, <vector, mean>."""
    residual = (x - mean) @ turn.T
    length = np.linalg.norm(residual, axis=1)
    safe = np.where(length > 0, length, 1)
    signs = residual > 0
    fit = np.abs(residual).sum(axis=1) / np.sqrt(x.shape[1]) / safe
    return pack(signs), length, np.where(length > 0, fit, 1.0), x @ mean


def levels(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q as 4-bit levels, with the first level's value and the step."""
    lo, hi = q.min(axis=1, keepdims=True), q.max(axis=1, keepdims=True)
    step = np.where(hi > lo, (hi - lo) / ((1 << QUERY_BITS) - 1), 1.0)
    return np.rint((q - lo) / step).astype(np.uint8), lo[:, 0], step[:, 0]


def set_bits(codes: np.ndarray, level: np.ndarray) -> np.ndarray:
    """For each (query, code) the sum of the query's levels at the code's ones."""
    total = np.zeros((len(level), len(codes)), np.uint32)
    for bit in range(QUERY_BITS):
        plane = pack((level >> bit) & 1 == 1)
        for w in range(codes.shape[1]):
            total += np.left_shift(np.bitwise_count(plane[:, w, None] & codes[None, :, w]), bit, dtype=np.uint16)
    return total


def bit_dots(codes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """<q, code> for each (query, code): codes as signs / sqrt(dims)."""
    level, lo, step = levels(q)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    # sum over set bits of q, twice, less the sum of all of q
    plus = step[:, None] * set_bits(codes, level) + lo[:, None] * ones
    return (2 * plus - (step * level.sum(axis=1) + lo * q.shape[1])[:, None]) / np.sqrt(q.shape[1])


def _search(keys, queries: pd.DataFrame, block: pd.DataFrame, mean: list[float], k: int) -> pd.DataFrame:
    found = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    if not len(queries) or not len(block):
        return found
    dims = int(keys[0])
    center = np.asarray(mean[:dims]) if len(mean) == dims else np.zeros(dims)
    turn = rotation(dims)
    x, q = matrix(block["v"]), matrix(queries["v"])
    codes, length, fit, with_mean = encode(x, center, turn)
    turned = (q - center) @ turn.T
    offset = q @ center - center @ center
    q_length = np.linalg.norm(turned, axis=1)
    spread = (BOUND * length * np.sqrt(np.maximum(1 - fit**2, 0)) / fit / np.sqrt(max(dims - 1, 1))).astype(np.float32)
    ids, query_ids = block["vec_id"].to_numpy(), queries["query_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    x, ids, codes, spread = x[order], ids[order], codes[order], spread[order]
    scale, with_mean = ((length / fit)[order]).astype(np.float32), with_mean[order].astype(np.float32)
    nth = min(k + FIRST, len(ids)) - 1
    out = [found]
    for a in range(0, len(q), 64):
        part = slice(a, a + 64)
        guess = bit_dots(codes, turned[part]).astype(np.float32)
        guess *= scale
        guess += with_mean
        guess += offset[part, None].astype(np.float32)
        guess[query_ids[part, None] == ids[None, :]] = -np.inf
        first = np.argpartition(guess, len(ids) - 1 - nth, axis=1)[:, len(ids) - 1 - nth :]
        for i in range(len(guess)):
            # the k-th best inner product among the first by estimate
            query, own = q[a + i], query_ids[a + i]
            some = first[i][ids[first[i]] != own]
            if len(some) >= k:
                floor = np.partition(x[some] @ query, len(some) - k)[len(some) - k]
                near = np.flatnonzero(guess[i] + np.float32(q_length[a + i]) * spread >= floor)
            else:
                near = np.flatnonzero(ids != own)
            rough = x[near] @ query
            if len(near) > k:  # order the best only, with room for rounding
                edge = np.partition(rough, len(rough) - k)[len(rough) - k]
                near = near[rough >= edge - 1e-9 * max(1.0, abs(edge))]
            score = ordered_dot(x[near], np.broadcast_to(query, (len(near), dims)))
            best = np.lexsort((ids[near], -score))[:k]
            out.append(pd.DataFrame({"query_id": own, "vec_id": ids[near][best], "score": score[best]}))
    return pd.concat(out)


def _sums(batches):
    for frame in batches:
        for dims, rows in frame.groupby("dims"):
            yield pd.DataFrame({"dims": [dims], "n": [len(rows)], "total": [matrix(rows["v"]).sum(axis=0).tolist()]})


def nearest(df: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The k nearest of every query row: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``; candidates are
    all rows but the query's own.
    """
    ship(df.sparkSession)
    rows = checkpointed(vectors(df))
    sums = rows.select("dims", "v").mapInPandas(_sums, "dims int, n long, total array<double>")
    # the mean of the most frequent length: one row of `dims` doubles
    one = sums.select("dims", "n", F.posexplode("total")).groupBy("dims", "pos").agg(F.sum("col").alias("s"), F.sum("n").alias("n"))
    top = one.groupBy("dims").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("s"))
    first = top.orderBy(F.desc("n"), "dims").first()
    mean = [x.s / first.n for x in first.s] if first else []

    count = rows.count()
    blocks, query_blocks = max(1, -(-count // BLOCK)), max(1, -(-count // (every * QUERY_BLOCK)))
    deal = F.xxhash64("vec_id")
    data = rows.withColumn("block", F.pmod(deal, F.lit(blocks)).cast("int"))
    data = data.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    queries = rows.filter(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    queries = queries.withColumn("qblock", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"))
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    grid = ["dims", "block", "qblock"]
    found = queries.groupBy(*grid).cogroup(data.groupBy(*grid)).applyInPandas(partial(_search, mean=mean, k=k), OUT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
