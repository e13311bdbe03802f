"""Histogram sort: shards of near-equal bytes from exact counts below probes.

Rows are ordered by ``(content key, doc_id)``, the content key being the
first 60 bits of the text's MD5, so that equal texts lie side by side. The
driver holds candidate boundaries only. Each round counts bytes and rows of
every cell between two probes, over all partitions, and splits the cells
that still hold a wanted boundary into ``fan`` smaller ones: first along
the content key, and inside one group of equal texts along doc_id, so that
a group larger than a shard is cut as well. Shard boundaries are refined to
the exact row, the boundaries of the finer pieces that carry the sort to
``piece_tolerance`` of a piece. Then one exchange brings each piece into one
task, and the exact count below its boundary gives its first slot.

Native DataFrame operations only. The histogram on the driver is bounded
by ``pieces * fan`` cells whatever the size of the input.

Defined cases: a null text has size 1 and the crc32 of no bytes; a null
doc_id sorts first; rows equal in text and doc_id are never separated; an
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlab.llm.common import checkpointed, inline_table, partitions

KEY_BITS = 60
FIRST_BITS = 12
NO_ID = -(1 << 63)


def shard_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the sort key ``(k, d)`` of each document."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        key.alias("k"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"),
    )


class _Cell:
    """A range of keys between two probes, with its exact bytes and rows."""

    __slots__ = ("bytes", "rows", "k", "d", "before", "rows_before")

    def __init__(self, bytes_, rows, k, d):
        self.bytes, self.rows, self.k, self.d = bytes_, rows, k, d
        self.before = self.rows_before = 0

    @property
    def single(self) -> bool:
        return self.k[0] == self.k[1] and self.d[0] == self.d[1]

    @property
    def start(self) -> tuple[int, int]:
        return (self.k[0], self.d[0])

    def probes(self, fan: int) -> dict:
        """Equal steps over the cell's range of k, or of doc_id inside one k."""
        on_k = self.k[0] < self.k[1]
        lo, hi = self.k if on_k else self.d
        shift = int(hi - lo >= 1 << 62)
        lo, hi = lo >> shift, hi >> shift
        return {"on_k": on_k, "lo": lo, "step": (hi - lo) // fan + 1, "shift": shift}


def _histogram(rows: DataFrame) -> list:
    return (
        rows.groupBy("cell")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("d").alias("d0"), F.max("d").alias("d1"))
        .orderBy("cell")
        .collect()
    )


def _cells(hist: list) -> list[_Cell]:
    return [_Cell(h.bytes, h.n, (h.k0, h.k1), (h.d0, h.d1)) for h in hist]


def _count_below(cells: list[_Cell]) -> None:
    size = n = 0
    for c in cells:
        c.before, c.rows_before = size, n
        size, n = size + c.bytes, n + c.rows


def splitters(rows: DataFrame, shards: int, pieces: int, fan: int = 64, piece_tolerance: float = 0.25) -> list[dict]:
    """Boundaries ``(k, d)`` of the pieces, with exact rows below and the shard.

    Boundary ``j`` of ``pieces`` lies where ``j / pieces`` of all bytes are
    below it; ``pieces`` is a multiple of ``shards``, and each
    ``pieces / shards``-th boundary is a shard's, found to the exact row.
    """
    spark, per = rows.sparkSession, pieces // shards
    whole = _cells(_histogram(rows.withColumn("cell", F.lit(0).cast("long"))))
    if not whole:
        return []
    total = whole[0].bytes
    tolerance = piece_tolerance * total / pieces
    cells, live, active = whole, None, {0: whole[0]} if not whole[0].single else {}
    while active:
        if live is None:  # the first probes divide all rows: no lookup
            width = 1 << FIRST_BITS
            only = whole[0].probes(width)
            asked = rows.withColumns({"cell": F.lit(0).cast("long"), **{k: F.lit(v) for k, v in only.items()}})
        else:
            width = fan
            table = [{"cell": i, **c.probes(width)} for i, c in active.items()]
            # as many rows as cells under refinement: at most `pieces`
            probes = inline_table(spark, "cell bigint,on_k boolean,lo bigint,step bigint,shift int", table)
            asked = live.join(F.broadcast(probes), "cell")
        along = F.when(F.col("on_k"), F.col("k")).otherwise(F.col("d"))
        along = F.when(F.col("shift") == 1, F.shiftright(along, 1)).otherwise(along)
        placed = asked.withColumn("at", along - F.col("lo"))
        live = placed.select("size", "k", "d", (F.col("cell") * width + F.expr("at div step")).alias("cell"))
        found: dict[int, list[tuple[int, _Cell]]] = {}
        for h in _histogram(live):
            found.setdefault(h.cell // width, []).append((h.cell, _cells([h])[0]))
        ids = {id(c): i for i, c in active.items()}
        fresh: list[tuple[int | None, _Cell]] = []
        for c in cells:
            fresh += found[ids[id(c)]] if id(c) in ids else [(None, c)]
        cells = [c for _, c in fresh]
        _count_below(cells)
        number = {id(c): i for i, c in fresh if i is not None}
        wanted = _unresolved(cells, total, pieces, per, tolerance)
        # a cell that no boundary falls into any more leaves the next round by the join
        active = {number[id(c)]: c for c in wanted}
    return _boundaries(cells, total, pieces, per)


def _crossing(cells: list[_Cell], befores: list[int], total: int, j: int, pieces: int) -> int:
    """The last cell that starts below ``j / pieces`` of all bytes."""
    return bisect_right(befores, (j * total - 1) // pieces) - 1


def _unresolved(cells, total, pieces, per, tolerance) -> list[_Cell]:
    befores, out = [c.before for c in cells], {}
    for j in range(1, pieces):
        c = cells[_crossing(cells, befores, total, j, pieces)]
        exact, at = j % per == 0, j * total / pieces
        near = not exact and min(at - c.before, c.before + c.bytes - at) <= tolerance
        if not c.single and not near:
            out[id(c)] = c
    return list(out.values())


def _boundaries(cells, total, pieces, per) -> list[dict]:
    befores, out = [c.before for c in cells], []
    for j in range(1, pieces):
        i, at = _crossing(cells, befores, total, j, pieces), j * total / pieces
        if j % per == 0 or at - cells[i].before > cells[i].before + cells[i].bytes - at:
            i += 1
        if i < len(cells):
            c = cells[i]
            out.append({"k": c.start[0], "d": c.start[1], "rows": c.rows_before, "shard_edge": j // per if j % per == 0 else None})
    return out


def histogram_sort(docs: DataFrame, shards: int = 8, fan: int = 64) -> DataFrame:
    """Each document's shard and its slot there; shard sizes differ by a row at most.

    Returns doc_id, size, text_crc32, law (``bytes``), shard, slot and
    grown_shard (null: another shard count gives other boundaries).
    """
    spark = docs.sparkSession
    rows = checkpointed(shard_rows(docs))
    pieces = shards * max(1, -(-2 * partitions(spark) // shards))
    bounds = splitters(rows.select("size", "k", "d"), shards, pieces, fan)
    edges = sorted((b["k"], b["d"], b["rows"], b["shard_edge"]) for b in bounds if b["shard_edge"] is not None)
    keys = sorted({(b["k"], b["d"]): b["rows"] for b in bounds}.items())
    info, shard, start = [{"piece": 0, "shard": 0, "first": 0}], 0, 0
    for i, ((k, d), below) in enumerate(keys, 1):
        for ek, ed, er, s in edges:
            if (ek, ed) <= (k, d) and s > shard:
                shard, start = s, er
        info.append({"piece": i, "shard": shard, "first": below - start})
    # the lookup has 2 ** FIRST_BITS rows and the splitters: a fixed size
    grid: dict[int, list] = {}
    for (k, d), _ in keys:
        grid.setdefault(k >> (KEY_BITS - FIRST_BITS), []).append({"k": k, "d": d})
    lookup, base = [], 0
    for g in range(1 << FIRST_BITS):
        lookup.append({"g": g, "base": base, "inside": grid.get(g, [])})
        base += len(grid.get(g, []))
    lookup = inline_table(spark, "g bigint,base int,inside array<struct<k:bigint,d:bigint>>", lookup)
    below = F.filter("inside", lambda s: (s["k"] < F.col("k")) | ((s["k"] == F.col("k")) & (s["d"] <= F.col("d"))))
    placed = (
        rows.withColumn("g", F.shiftright("k", KEY_BITS - FIRST_BITS))
        .join(F.broadcast(lookup), "g")
        .withColumn("piece", F.col("base") + F.size(below))
        .select("doc_id", "size", "text_crc32", "k", "d", "piece")
        .join(F.broadcast(inline_table(spark, "piece int,shard int,first bigint", info)), "piece")
    )
    order = Window.partitionBy("piece").orderBy("k", "d")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.row_number().over(order) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
