"""Whitening of embeddings by QDWH spectral divide and conquer.

Each usable vector becomes whole numbers x = floor(1024 c) + 100000. Three
passes: sums give n and S; the covariance is centred before multiplying, on
the whole number next to the mean, in whole numbers, and the remainder of
the mean is taken out exactly, so it is the covariance to the last bit
however rows are dealt; the whitened columns are checked against the
identity. The covariance is split on the driver (its size is that of one
vector squared): the polar factor of V - s I, by dynamically weighted
Halley steps on QR factors, is the matrix sign, half of it plus I the
projector on the eigenvectors above s, and orthonormal bases of projector
and complement give two smaller blocks, until blocks are single numbers.
Tasks then get the first components as a matrix.

Defined cases: a vector that is null, empty or holds null or non-finite
entries is dropped, and so are vectors of another length than the most
frequent one (the smaller of equals); a null id stays null; entries beyond
2 ** 40 count as that; components whose variance is nothing next to the largest
(``NOTHING``) are left out, as they can't be whitened; a deviation beyond
64 bits is null; signs make the entry of the largest size positive; repeated
rows get rows each; an empty table gives no rows. Extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlab.llm.common import checkpointed, ship

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
LARGEST = float(1 << 40)
NOTHING = 1e-13
#: Rows of one matrix product, and the size below which its sums of
#: products are exact in doubles: (2 ** 20) ** 2 * 4096 = 2 ** 52.
BLOCK, EXACT = 4096, 1 << 20
EPS = float(np.finfo(float).eps)


# -- spectral divide and conquer --------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a square matrix, by QDWH steps on QR factors."""
    size = len(a)
    scale = np.linalg.norm(a)
    if scale == 0:
        return np.eye(size)
    x = a / scale
    # a lower bound of the smallest singular value sets the weights; a bound
    # that is too small costs a step or two
    low = max(EPS, np.abs(np.diag(np.linalg.qr(x, mode="r"))).min() / np.sqrt(size) / 2)
    for _ in range(60):
        l2 = low * low
        d = np.cbrt(4 * (1 - l2) / (l2 * l2))
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - l2) / (l2 * np.sqrt(1 + d))))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        low = min(1.0, low * (wa + wb * l2) / (1 + wc * l2))
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(size)]))
        new = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:size] @ q[size:].T)
        moved = np.linalg.norm(new - x)
        x = new
        if moved <= np.cbrt(EPS) and abs(1 - low) <= 10 * EPS:
            break
    return x


def _bases(sign: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the subspaces where ``sign`` is 1 and -1; None if it has others."""
    size = len(sign)
    above = (sign + np.eye(size)) / 2
    rank = int(round(np.trace(above)))
    if not 0 < rank < size or abs(np.trace(above) - rank) > 1e-6:
        return None
    return _range(above, rank), _range(np.eye(size) - above, size - rank)


def _range(projector: np.ndarray, rank: int) -> np.ndarray:
    """An orthonormal basis of a projector's range: subspace iteration from its largest columns."""
    columns = []
    rest = projector.copy()
    for _ in range(rank):  # pivoted Gram-Schmidt picks independent columns
        k = int((rest**2).sum(axis=0).argmax())
        v = rest[:, k] / np.linalg.norm(rest[:, k])
        columns.append(k)
        rest -= np.outer(v, v @ rest)
    q, _ = np.linalg.qr(projector[:, columns])
    q, _ = np.linalg.qr(projector @ q)
    return q


def spectral(a: np.ndarray, size: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) of a symmetric matrix, in no order."""
    n = len(a)
    size = np.linalg.norm(a) if size is None else size
    if n == 1:
        return a[0].copy(), np.ones((1, 1))
    off = a - np.diag(np.diag(a))
    if np.linalg.norm(off) <= 4 * EPS * size:
        return np.diag(a).copy(), np.eye(n)
    for shift in _shifts(a):
        bases = _bases(polar(a - shift * np.eye(n)))
        if bases is None:
            continue
        up, down = bases
        if np.linalg.norm(up.T @ a @ down) > 64 * n * EPS * size:
            continue
        parts = []
        for basis in bases:
            block = basis.T @ a @ basis
            values, inner = spectral((block + block.T) / 2, size)
            parts.append((values, basis @ inner))
        return np.concatenate([v for v, _ in parts]), np.hstack([q for _, q in parts])
    # no shift splits it: all its eigenvalues are one to working precision
    return np.diag(a).copy(), np.eye(n)


def _shifts(a: np.ndarray) -> Iterator[float]:
    """The median of the diagonal, the mean, then other places of the spectrum's range."""
    diagonal = np.sort(np.diag(a))
    yield float(np.median(diagonal))
    yield float(diagonal.mean())
    radius = np.abs(a - np.diag(np.diag(a))).sum(axis=1)
    low, high = float((np.diag(a) - radius).min()), float((np.diag(a) + radius).max())
    low, high = max(low, -np.linalg.norm(a)), min(high, np.linalg.norm(a))
    middle = float(diagonal.mean())
    for k in range(1, 48):
        # on both sides of the mean, nearer and nearer to it
        step = 0.75 ** ((k + 1) // 2)
        yield middle + step * ((high - middle) if k % 2 else (low - middle))


def components(covariance: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The first eigenvalues, falling, and their unit eigenvectors as columns."""
    values, vectors = spectral((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    keep = np.flatnonzero(values > NOTHING * max(values.max(initial=0.0), 0.0))[:most]
    values, vectors = values[keep], vectors[:, keep]
    for j in range(vectors.shape[1]):
        v = vectors[:, j]
        v /= np.linalg.norm(v)
        if v[np.abs(v).argmax()] < 0:
            v *= -1
    return values, vectors


# -- passes over the rows ---------------------------------------------------


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x (array of long) and dims of the rows that take part."""
    values = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), values.alias("v")).filter("v is not null and size(v) > 0")
    held = F.transform("v", lambda c: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c)) * SCALE).cast("long") + SHIFT)
    return rows.filter(~bad).select("vec_id", held.alias("x"), F.size("v").alias("dims"))


def _blocks(column: pa.Array, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, whole numbers) of blocks of a list column of equal lengths."""
    for at in range(0, len(column), BLOCK):
        part = column.slice(at, BLOCK)
        yield at, part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), dims)


def _products(batches: Iterator[pa.RecordBatch], middle: list[int]) -> Iterator[pa.RecordBatch]:
    """One row per pair of dimensions and task: the exact sum of centred products."""
    dims, offset = len(middle), np.array(middle, np.int64)
    total, seen = np.zeros((dims, dims), object), False
    for batch in batches:
        for _, x in _blocks(batch.column(0), dims):
            z = x - offset
            if len(z) and np.abs(z).max() < EXACT:
                f = z.astype(np.float64)
                total = total + (f.T @ f).astype(np.int64).astype(object)
            else:
                z = z.astype(object)
                total = total + z.T @ z
            seen = True
    if seen:
        i, j = np.triu_indices(dims)
        sums = [Decimal(int(v)) for v in total[i, j]]
        yield pa.record_batch({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "p": pa.array(sums, pa.decimal128(38, 0))})


def moments(rows: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S, and the covariance (divisor n) of whole vectors."""
    sums = rows.select(F.posexplode("x").alias("d", "x")).groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("s"))
    found = sums.orderBy("d").collect()  # a row per dimension
    n, total = found[0]["n"], [int(r["s"]) for r in found]
    middle = [(2 * s + n) // (2 * n) for s in total]
    pairs = rows.select("x").mapInArrow(partial(_products, middle=middle), "i int, j int, p decimal(38,0)")
    rest = [s - n * m for s, m in zip(total, middle, strict=True)]
    covariance = np.zeros((dims, dims))
    # a row per pair of dimensions
    for i, j, p in pairs.groupBy("i", "j").agg(F.sum("p").alias("p")).collect():
        covariance[i, j] = covariance[j, i] = (n * int(p) - rest[i] * rest[j]) / (n * n)
    return n, total, covariance


def _deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Exact sums of (n x - S) ** 2; None beyond 64 bits."""
    if n * float(np.abs(x).max(initial=0)) < 2**62 and max(map(abs, total)) < 2**62:
        d = n * x - np.array(total, np.int64)
        if (d.astype(np.float64) ** 2).sum(axis=1).max(initial=0) < 2**62:
            return (d * d).sum(axis=1).tolist()
    exact = ((x.astype(object) * n - np.array(total, object)) ** 2).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in exact]


def _whiten(batches: Iterator[pa.RecordBatch], n: int, total: list[int], turn: np.ndarray) -> Iterator[pa.RecordBatch]:
    mean = np.array([s / n for s in total])
    for batch in batches:
        for at, x in _blocks(batch.column(1), len(total)):
            # one fixed order of additions: equal vectors whiten equally wherever they are
            w = np.zeros((len(x), turn.shape[1]))
            for d, row in enumerate(turn):
                w += (x[:, d] - mean[d])[:, None] * row
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * turn.shape[1], pa.int32()), pa.array(w.ravel()))
            deviation = pa.array(_deviations(x, n, total), pa.int64())
            yield pa.record_batch({"vec_id": batch.column(0).slice(at, len(x)), "deviation": deviation, "w": flat})


def _spread(batches: Iterator[pa.RecordBatch], mean: list[float]) -> Iterator[pa.RecordBatch]:
    """Sums of centred products of whitened columns, a row per pair and task."""
    k, total, seen = len(mean), np.zeros((len(mean), len(mean))), False
    for batch in batches:
        for _, w in _blocks(batch.column(0), k):
            total, seen = total + (w - mean).T @ (w - mean), True
    if seen:
        i, j = (v.ravel() for v in np.indices((k, k)))
        yield pa.record_batch({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "p": pa.array(total.ravel())})


def identity_error(white: DataFrame, n: int, k: int) -> float:
    """The largest entry by which the whitened columns' covariance is off the identity."""
    means = white.select(F.posexplode("w").alias("d", "w")).groupBy("d").agg(F.sum("w").alias("s"))
    mean = [r["s"] / n for r in means.orderBy("d").collect()]
    pairs = white.select("w").mapInArrow(partial(_spread, mean=mean), "i int, j int, p double")
    found = np.zeros((k, k))
    for i, j, p in pairs.groupBy("i", "j").agg(F.sum("p").alias("p")).collect():
        found[i, j] = p / n
    return float(np.abs(found - np.eye(k)).max(initial=0.0))


def whitened(df: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Per usable row and component: n, deviation, whitened, explained, identity_error."""
    spark = df.sparkSession
    ship(spark)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole_vectors(df)
    lengths = rows.groupBy("dims").count().orderBy(F.desc("count"), "dims").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dims = lengths[0]["dims"]
    rows = checkpointed(rows.filter(F.col("dims") == dims).select("vec_id", "x"))
    n, total, covariance = moments(rows, dims)
    values, vectors = components(covariance, most)
    if not len(values):
        return spark.createDataFrame([], schema)
    turn = vectors / np.sqrt(values)
    white = checkpointed(rows.mapInArrow(partial(_whiten, n=n, total=total, turn=turn), "vec_id long, deviation long, w array<double>"))
    off = identity_error(white, n, len(values))
    trace = float(np.trace(covariance))
    shares = F.array(*(F.lit(float(e) / trace) for e in values))
    each = white.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        _at(shares, F.col("at")).alias("explained"),
        F.lit(off).alias("identity_error"),
    )


def _at(values: Column, place: Column) -> Column:
    return F.element_at(values, place + 1)
