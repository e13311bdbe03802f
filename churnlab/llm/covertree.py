"""Exact near-duplicate vectors by dual traversal of cover trees.

Vectors are scaled to unit length, where cosine >= c is a distance of at
most ``reach = sqrt(2 - 2c)``. Equal vectors are one class. Pivots, a
bounded sample, deal the classes into cells, each under its nearest pivot;
a cell's covering radius is the exact largest distance to its pivot. Pairs
of cells further apart than their radii and the reach are pruned, the
others are joined by tasks of their own.

Each part of a cell has a cover tree, grown once. Level i has the radius 2^(1 - i);
level 0 holds any unit vectors. A node is on the last level whose radius
covers its points (levels without a split are left out), and its children
are a greedy net of half that radius over its points: its own centre and as
many others as it takes, more than that half radius apart, each point with
its nearest centre. So radii halve from level to level, and every node also
has its exact covering radius.

The dual traversal takes pairs of nodes, holds the children's centres of
both against each other in one matrix product, and prunes a pair of children
when the centres' distance less both covering radii exceeds the reach. Pairs
left go down together; small nodes are compared point by point. A task
returns the number of links of each vector and a spanning forest of its
links, never the pairs, so a group of thousands of near copies costs
thousands of rows.

The covering bounds hold for any sample, so the pairs are exact whatever
the pivots. In many dimensions unrelated vectors are nearly orthogonal: a
net of radius 1 then has a child for each of them, the product of the root's
children is the comparison, and the work is quadratic, in blocks.

Defined cases: unusable vectors have 0 links and themselves as component;
vectors of different lengths never link; rows with one vec_id and different
vectors are one vertex with the links of both; a null vec_id has 0 links, a
null component and is kept; an empty table gives no rows. Extra columns are
not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlab.llm.common import checkpointed, ship
from churnlab.llm.components import components, forest
from churnlab.llm.vectors import matrix, ordered_dot, vectors

#: Classes in a task's side, and pivots sampled at most (the sample bound).
CELL, MAX_PIVOTS = 4096, 256
#: Points in a leaf at most, and rows of a matrix product.
LEAF, BLOCK = 256, 256
#: Added to distances taken from products of unit vectors; nodes narrower than NARROW are leaves.
SLACK, NARROW = 1e-7, 1e-6
#: Cosines this near the threshold are computed again, summed in order.
CLOSE = 1e-9
LINKS = "a long, b long, n long"
#: A class in its part's tree: place in the tree's order, depths of the nodes that begin there.
GROWN = ["rep", "n", "v", "pivot", "part", "place", "top", "bottom"]
GROWN_TYPES = "rep long, n long, v array<double>, pivot int, part int, place int, top int, bottom int"


def distances(u: np.ndarray, center: np.ndarray) -> np.ndarray:
    return np.sqrt(((u - center) ** 2).sum(axis=1))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def net(u: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(centres, owner): rows of ``u``, the first among them, more than ``radius`` apart, and each row's nearest."""
    cut = 1 - radius * radius / 2 + 1e-12
    nearest, owner = u @ u[0], np.zeros(len(u), np.int64)
    nearest[0] = np.inf
    centers = [0]
    open_rows = np.nonzero(nearest < cut)[0]
    while len(open_rows):
        block = open_rows[:BLOCK]
        own = u[block] @ u[block].T
        free = np.ones(len(block), bool)
        chosen = []
        for i in range(len(block)):
            if free[i]:
                chosen.append(block[i])
                free &= own[i] < cut
        dots = u @ u[chosen].T
        best = dots.argmax(axis=1)
        value = dots[np.arange(len(u)), best]
        nearer = value > nearest
        owner[nearer], nearest[nearer] = best[nearer] + len(centers), value[nearer]
        owner[chosen], nearest[chosen] = np.arange(len(chosen)) + len(centers), np.inf
        centers += chosen
        open_rows = open_rows[nearest[open_rows] < cut]
    return np.array(centers), owner


class Node:
    """A cover tree node over ``points``, its centre first.

    ``radius`` is the exact covering radius; a node with children has the
    last ``level`` that covers it.
    """

    __slots__ = ("points", "radius", "children")

    def __init__(self, points: np.ndarray, radius: float, children: list[Node]):
        self.points, self.radius, self.children = points, radius, children

    @property
    def level(self) -> int:
        return max(0, int(np.floor(np.log2(2 / self.radius))))


def _radii(u: np.ndarray, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Largest distance to the first of each run of ``points``."""
    first = np.repeat(points[starts], np.diff(starts, append=len(points)))
    away = np.sqrt(((u[points] - u[first]) ** 2).sum(axis=1))
    return np.maximum.reduceat(away, starts)


def grow(u: np.ndarray, points: np.ndarray, radius: float | None = None) -> Node:
    radius = float(_radii(u, points, np.zeros(1, int))[0]) if radius is None else radius
    node = Node(points, radius, [])
    if len(points) <= LEAF or radius < NARROW:
        return node
    centers, owner = net(u[points], 2.0 ** -node.level)
    later = np.ones(len(points), bool)
    later[centers] = False
    order = np.lexsort((later, owner))
    starts = np.searchsorted(owner[order], np.arange(len(centers)))
    own = points[order]
    node.children = [grow(u, *x) for x in zip(np.split(own, starts[1:]), _radii(u, own, starts).tolist(), strict=True)]
    node.points = np.concatenate([c.points for c in node.children])
    return node


def outline(tree: Node) -> tuple[np.ndarray, np.ndarray]:
    """(top, bottom) of each of the tree's points in its order: the depths of the nodes that begin there, 1 to 0 if none."""
    top, bottom = np.ones(len(tree.points), np.int32), np.zeros(len(tree.points), np.int32)
    stack = [(tree, 0, 0)]
    while stack:
        node, at, depth = stack.pop()
        # a node comes before those below it, so the first to begin at a point is the top
        if top[at] > bottom[at]:
            top[at] = depth
        bottom[at] = depth
        for child in node.children:
            stack.append((child, at, depth + 1))
            at += len(child.points)
    return top, bottom


def regrow(u: np.ndarray, top: np.ndarray, bottom: np.ndarray) -> Node:
    """The tree of an outline over the rows of ``u``, which are in its order."""

    def node(low: int, high: int, radius: float, depth: int) -> Node:
        points = np.arange(low, high)
        if bottom[low] == depth:
            return Node(points, radius, [])
        begins = (top[low:high] == depth + 1) & (bottom[low:high] >= depth + 1)
        begins[0] = True
        starts = np.nonzero(begins)[0]
        ends = np.append(starts[1:], high - low) + low
        radii = _radii(u, points, starts).tolist()
        return Node(points, radius, [node(lo, hi, r, depth + 1) for lo, hi, r in zip((starts + low).tolist(), ends.tolist(), radii, strict=True)])

    return node(0, len(u), float(_radii(u, np.arange(len(u)), np.zeros(1, int))[0]), 0)


class _Parts:
    """What a side of a pair is taken apart into: a node's children, else points."""

    def __init__(self, side: Node | np.ndarray):
        kids = side.children if isinstance(side, Node) else []
        self.wide = [k for k in kids if len(k.points) > 1]
        self.single = np.array([k.points[0] for k in kids if len(k.points) == 1], np.int64) if kids else _points(side)
        self.centers = np.array([k.points[0] for k in self.wide], np.int64)
        self.radii = np.array([k.radius for k in self.wide])
        self.inner = np.array([bool(k.children) for k in self.wide], bool)


def _points(side: Node | np.ndarray) -> np.ndarray:
    return side.points if isinstance(side, Node) else side


def _is_inner(side: Node | np.ndarray) -> bool:
    return isinstance(side, Node) and bool(side.children)


def traverse(left: Node, right: Node, xa, ua, xb, ub, cosine: float, compared: list[int] | None = None):
    """Index pairs (p, q) of linked points, in blocks.

    ``left is right`` joins a side with itself, each pair once. The numbers
    of pairs of points that no bound pruned are added to ``compared``.
    """
    reach = np.sqrt(2 - 2 * cosine) + SLACK

    def each(p, q, same=False):
        """The links among points."""
        for start in range(0, len(p), BLOCK):
            rows, cols = p[start : start + BLOCK], q[start:] if same else q
            dots = ua[rows] @ ub[cols].T
            found = dots >= cosine - CLOSE
            if same:
                found &= np.arange(len(rows))[:, None] < np.arange(len(cols))
            if compared is not None:
                compared.append(found.size)
            i, j = np.nonzero(found)
            keep = np.ones(len(i), bool)
            edge = dots[i, j] < cosine + CLOSE
            if edge.any():
                a, b = xa[rows[i[edge]]], xb[cols[j[edge]]]
                keep[edge] = ordered_dot(a, b) / (np.sqrt(ordered_dot(a, a)) * np.sqrt(ordered_dot(b, b))) >= cosine
            if keep.any():
                yield rows[i[keep]], cols[j[keep]]

    def near(p, radii, q, others):
        """(number, those of q in reach) of each ball around p."""
        for start in range(0, len(p) if len(q) else 0, BLOCK):
            rows = slice(start, start + BLOCK)
            gaps = np.sqrt(np.maximum(0, 2 - 2 * p[rows] @ q.T))
            for i, row in enumerate(gaps <= radii[rows, None] + others + reach, start):
                if row.any():
                    yield i, np.nonzero(row)[0]

    stack: list[tuple[Node | np.ndarray, Node | np.ndarray]] = [(left, right)]
    while stack:
        m, n = stack.pop()
        same = m is n
        if not _is_inner(m) and not _is_inner(n):
            yield from each(_points(m), _points(n), same)
            continue
        a = _Parts(m)
        b = a if same else _Parts(n)
        yield from each(a.single, b.single, same)
        # points of one side under the balls of the other
        for j, i in near(ub[b.centers], b.radii, ua[a.single], 0.0):
            if b.inner[j]:
                stack.append((a.single[i], b.wide[j]))
            else:
                yield from each(a.single[i], b.wide[j].points)
        for i, j in near(ua[a.centers], a.radii, ub[b.single], 0.0) if not same else ():
            if a.inner[i]:
                stack.append((a.wide[i], b.single[j]))
            else:
                yield from each(a.wide[i].points, b.single[j])
        # balls of both: leaves in reach of one are compared at once
        for i, js in near(ua[a.centers], a.radii, ub[b.centers], b.radii):
            if same:
                if a.inner[i]:
                    stack.append((a.wide[i], a.wide[i]))
                else:
                    yield from each(a.wide[i].points, a.wide[i].points, True)
                js = js[js > i]
            leaves = [b.wide[j].points for j in js if not b.inner[j]]
            if leaves and a.inner[i]:
                stack.append((a.wide[i], np.concatenate(leaves)))
            elif leaves:
                yield from each(a.wide[i].points, np.concatenate(leaves))
            own = a.wide[i] if a.inner[i] else a.wide[i].points
            stack += [(own, b.wide[j]) for j in js if b.inner[j]]


def _grow(frame: pd.DataFrame) -> pd.DataFrame:
    """A part's rows in the order of its tree, with the outline."""
    u = unit(matrix(frame["v"]))
    tree = grow(u, np.arange(len(u)))
    top, bottom = outline(tree)
    return frame.iloc[tree.points].assign(place=np.arange(len(u), dtype=np.int32), top=top, bottom=bottom)[GROWN]


def _side(frame: pd.DataFrame) -> tuple[pd.DataFrame, Node, np.ndarray, np.ndarray]:
    frame = frame.sort_values("place")
    x = matrix(frame["v"])
    u = unit(x)
    return frame, regrow(u, frame["top"].to_numpy(), frame["bottom"].to_numpy()), x, u


def _join(keys, side_a: pd.DataFrame, side_b: pd.DataFrame, cosine: float) -> pd.DataFrame:
    same = keys[0] == keys[1] and keys[2] == keys[3]
    empty = pd.DataFrame({"a": [], "b": [], "n": []}, dtype="int64")
    if not len(side_a) or not (same or len(side_b)):
        return empty
    side_a, tree, xa, ua = _side(side_a)
    if same:
        ids, weight, shift, other = side_a["rep"].to_numpy(), side_a["n"].to_numpy(), 0, (tree, xa, ua)
    else:
        side_b, *other = _side(side_b)
        shift = len(xa)
        ids = np.concatenate([side_a["rep"], side_b["rep"]])
        weight = np.concatenate([side_a["n"], side_b["n"]])
    count = np.zeros(len(ids), np.int64)
    stars_p, stars_q = [], []
    for p, q in traverse(tree, other[0], xa, ua, other[1], other[2], cosine):
        q = q + shift
        np.add.at(count, p, weight[q])
        np.add.at(count, q, weight[p])
        node, low = forest(p, q)
        stars_p.append(node)
        stars_q.append(low)
    if not stars_p:
        return empty
    node, low = forest(np.concatenate(stars_p), np.concatenate(stars_q))
    return pd.DataFrame({"a": ids[node], "b": ids[low], "n": count[node]})


def _deal(batches, pivots: dict[int, np.ndarray]):
    """The nearest pivot of each class and the distance to it."""
    for frame in batches:
        for dims, rows in frame.groupby("dims"):
            rows = rows.copy()
            if dims in pivots:
                first, centers = pivots[dims]
                u = unit(matrix(rows["v"]))
                near = (u @ centers.T).argmax(axis=1)
                rows["pivot"], rows["away"] = near + first, distances(u, centers[near])
            else:
                rows["pivot"], rows["away"] = -int(dims), 2.0
            yield rows[["rep", "n", "v", "pivot", "away"]]


def _sample(classes: DataFrame, count: int) -> dict[int, tuple[int, np.ndarray]]:
    """Up to MAX_PIVOTS unit vectors, by length: (first number, vectors)."""
    size = min(MAX_PIVOTS, max(1, -(-count // CELL)))
    rows = classes.orderBy(F.xxhash64("rep"), "rep").select("dims", "v").limit(size).collect()
    out, first = {}, 0
    for dims in sorted({r.dims for r in rows}):
        own = unit(np.array([r.v for r in rows if r.dims == dims]))
        out[dims] = (first, own)
        first += len(own)
    return out


def near_vectors(df: DataFrame, cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = df.sparkSession
    ship(spark)
    rows = vectors(df).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    same = ["h1", "h2", "dims"]
    classes = rows.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    classes = checkpointed(classes)
    count = classes.count()
    pivots = _sample(classes, count)
    dealt = classes.select("rep", "n", "v", "dims").mapInPandas(partial(_deal, pivots=pivots), "rep long, n long, v array<double>, pivot int, away double")
    dealt = checkpointed(dealt)

    # at most MAX_PIVOTS cells; those above CELL classes are cut into parts
    cells = dealt.groupBy("pivot").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("size")).collect()
    center = {first + i: c for first, own in pivots.values() for i, c in enumerate(own)}
    reach = np.sqrt(2 - 2 * cosine) + 1e-9
    pairs = []
    for i, c in enumerate(cells):
        for d in cells[i:]:
            known = c.pivot in center and d.pivot in center and center[c.pivot].shape == center[d.pivot].shape
            if c.pivot == d.pivot or known and np.sqrt(((center[c.pivot] - center[d.pivot]) ** 2).sum()) <= c.radius + d.radius + reach:
                pairs.append((c.pivot, d.pivot, -(-c["size"] // CELL), -(-d["size"] // CELL)))
    if not pairs:
        return _result(df, rows, classes, None)
    # a row per pair of pivots, at most MAX_PIVOTS squared; the parts are unfolded by the tasks
    near = F.broadcast(spark.createDataFrame(pairs, "p int, q int, p_parts int, q_parts int"))
    # a row per cell; each part's tree is grown once and goes to its tasks as an outline
    parts = F.broadcast(spark.createDataFrame([(c.pivot, -(-c["size"] // CELL)) for c in cells], "pivot int, parts int"))
    cut = dealt.join(parts, "pivot").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).drop("parts", "away")
    grown = checkpointed(cut.groupBy("pivot", "part").applyInPandas(_grow, GROWN_TYPES))
    side = [*(c for c in GROWN if c not in ("pivot", "part")), "p", "q", "s", "t"]
    left = grown.join(near, F.col("pivot") == F.col("p")).withColumn("s", F.col("part")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)))
    left = left.filter("p <> q or s <= t").select(*side).toDF(*side)
    right = grown.join(near, F.col("pivot") == F.col("q")).withColumn("t", F.col("part")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("p_parts") - 1)))
    right = right.filter("p <> q or s < t").select(*side).toDF(*side)
    tasks = ["p", "q", "s", "t"]
    found = left.groupBy(*tasks).cogroup(right.groupBy(*tasks)).applyInPandas(partial(_join, cosine=cosine), LINKS)
    return _result(df, rows, classes, checkpointed(found))


def _result(df: DataFrame, rows: DataFrame, classes: DataFrame, found: DataFrame | None) -> DataFrame:
    same = ["h1", "h2", "dims"]
    if found is None:
        found = df.sparkSession.createDataFrame([], LINKS)
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    groups = components(found).withColumnRenamed("id", "rep")
    named = classes.select(*same, "rep", "n").join(links, "rep", "left").join(groups, "rep", "left")
    per_class = named.select(*same, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    every = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    every = every.select("vec_id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), F.size("v").alias("dims"))
    out = every.join(per_class, same, "left")
    n_links = F.when(F.col("vec_id").isNotNull(), F.col("n_links"))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    out = out.select("vec_id", F.coalesce(n_links, F.lit(0)).alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
