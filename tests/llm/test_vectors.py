"""Nearest neighbours and near-duplicate vectors against brute force."""

import numpy as np
import pytest

from churnlab.llm import covertree, rabitq
from llm_data import rows_of

SCHEMA = "vec_id long, embedding array<float>, label int, v int, dims int, block int, rep int, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 1, 1, 1, 1) for i, v in rows], SCHEMA)


def clouds(n=400, dims=24, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    for i in range(n // 3):  # a group of near copies and one of copies
        x[i] = x[0] + 0.05 * rng.standard_normal(dims) if i % 2 else x[1]
    return x.astype(np.float32)


ODD = [(9000, None), (9001, []), (9002, [0.0, 0.0]), (9020, [float("nan")] * 24), (9040, [float("inf")] * 24), (None, [1.0] * 24), (9060, [1.0, None])]


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(rabitq, "BLOCK", 64)
    monkeypatch.setattr(rabitq, "QUERY_BLOCK", 8)
    x = clouds()
    rows = [(i * 2, v.tolist()) for i, v in enumerate(x)]
    got = rows_of(rabitq.nearest(table(spark, rows + ODD)), "query_id", "rank", "vec_id", "score")
    x = x.astype(float)
    want = []
    for q in range(0, 400, 10):
        score = np.zeros(400)
        for d in range(x.shape[1]):
            score += x[q, d] * x[:, d]
        best = [j for j in np.lexsort((np.arange(400), -score)) if j != q][:20]
        want += [(q * 2, r + 1, j * 2, score[j]) for r, j in enumerate(best)]
    assert len(got) == len(want)
    found = len({g[::2] for g in got} & {w[::2] for w in want}) / len(want)
    assert found >= 0.97
    exact = {(w[0], w[2]): w[3] for w in want}
    assert all(exact[g[0], g[2]] == g[3] for g in got if (g[0], g[2]) in exact)


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((500, 70)), rng.standard_normal((40, 70))
    turn = rabitq.rotation(70)
    codes, length, fit, _ = rabitq.encode(x, np.zeros(70), turn)
    guess = rabitq.bit_dots(codes, q @ turn.T) * (length / fit)
    spread = np.linalg.norm(q, axis=1)[:, None] * length * np.sqrt(1 - fit**2) / fit / np.sqrt(69)
    off = (guess - q @ x.T) / spread
    assert abs(off.mean()) < 0.05 and (np.abs(off) > rabitq.BOUND).mean() < 0.03
    assert np.allclose(turn @ turn.T, np.eye(70))


def test_fewer_candidates_ties_and_empty(spark):
    got = rows_of(rabitq.nearest(table(spark, [(0, [1.0, 0.0]), (7, [2.0, 0.0]), (3, [2.0, 0.0]), (5, [1.0])])), "query_id", "rank", "vec_id", "score")
    assert got == [(0, 1, 3, 2.0), (0, 2, 7, 2.0)]
    assert rabitq.nearest(table(spark, [])).count() == 0
    assert rabitq.nearest(table(spark, ODD[:3])).count() == 0
    zero = rows_of(rabitq.nearest(table(spark, [(0, [1.0, 1.0])])))
    assert zero == []


def brute_links(rows, cosine=0.9):
    good = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, _ in rows}
    for a, x in good:
        for b, y in good:
            if a != b and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine:
                links[a].add(b)
    seen, out = {}, []
    for i in sorted(k for k in links if k is not None):
        if i not in seen:
            stack = [i]
            while stack:
                j = stack.pop()
                if j not in seen:
                    seen[j] = i
                    stack += links[j]
    for i, _ in rows:
        out.append((i, len(links[i]) if i is not None else 0, seen.get(i), i is None or seen[i] == i))
    return sorted(out, key=lambda r: (r[0] is not None, r[0]))


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(covertree, "LEAF", 8)
    monkeypatch.setattr(covertree, "CELL", 40)
    rows = [(i, v.tolist()) for i, v in enumerate(clouds())] + [(700, (clouds()[1] * 3).tolist())] + ODD
    got = rows_of(covertree.near_vectors(table(spark, rows)), "vec_id", "n_links", "component_id", "kept")
    assert got == brute_links(rows)


def test_chains_and_thresholds(spark):
    turn = lambda a: [float(np.cos(a)), float(np.sin(a))]
    rows = [(i, turn(0.3 * (9 - i))) for i in range(10)] + [(50, [5.0, 0.0, 0.0])]
    got = rows_of(covertree.near_vectors(table(spark, rows)), "vec_id", "n_links", "component_id", "kept")
    assert got == brute_links(rows)


def test_no_vectors(spark):
    assert covertree.near_vectors(table(spark, [])).count() == 0
    assert rows_of(covertree.near_vectors(table(spark, ODD[:2])), "vec_id", "n_links", "component_id", "kept") == [(9000, 0, 9000, True), (9001, 0, 9001, True)]


def unrelated(n, dims=64, seed=3):
    return np.random.default_rng(seed).normal(size=(n, dims))


def nested_clouds(n=2000, dims=16, seed=4):
    """Clusters in clusters, with spreads that fall by four."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(8, dims))
    for spread in (0.5, 0.12, 0.03):
        x = np.repeat(x, 8, axis=0) + spread * rng.normal(size=(8 * len(x), dims))
    return x[rng.permutation(len(x))[:n]]


@pytest.mark.parametrize("x", [clouds(3000, 8), unrelated(1500), nested_clouds(), np.repeat(unrelated(30), 40, axis=0)], ids=["clouds", "unrelated", "nested", "copies"])
def test_levels_halve_nest_and_separate(x, monkeypatch):
    monkeypatch.setattr(covertree, "LEAF", 16)
    u = covertree.unit(x)
    stack, depth = [(covertree.grow(u, np.arange(len(u))), 0)], 0
    while stack:
        node, level = stack.pop()
        depth = max(depth, level)
        assert covertree.distances(u[node.points], u[node.points[0]]).max() <= node.radius + 1e-12
        if not node.children:
            assert len(node.points) <= 16 or node.radius < covertree.NARROW
            continue
        half = 2.0 ** -node.level
        assert half < node.radius <= 2 * half and all(c.radius <= half for c in node.children)
        assert sorted(np.concatenate([c.points for c in node.children])) == sorted(node.points)
        assert node.points[0] in {c.points[0] for c in node.children}
        centers = u[[c.points[0] for c in node.children]]
        apart = np.sqrt(np.maximum(0, 2 - 2 * centers @ centers.T)) + 9 * np.eye(len(centers))
        assert apart.min() > half - 1e-6
        for c in node.children:
            assert not c.children or c.level > node.level
            stack.append((c, level + 1))
    assert depth >= 1


@pytest.mark.parametrize("x", [clouds(700, 8), unrelated(400), nested_clouds(900), np.repeat(unrelated(12), 30, axis=0) * np.arange(1, 361)[:, None]], ids=["clouds", "unrelated", "nested", "copies"])
@pytest.mark.parametrize("leaf", [1, 8, 64])
@pytest.mark.parametrize("block", [7, 256])
def test_dual_traversal_finds_each_pair_once(x, leaf, block, monkeypatch):
    monkeypatch.setattr(covertree, "LEAF", leaf)
    monkeypatch.setattr(covertree, "BLOCK", block)
    u = covertree.unit(x)
    near = u @ u.T >= 0.9 - 1e-12
    tree = covertree.grow(u, np.arange(len(u)))
    got = [(min(p, q), max(p, q)) for ps, qs in covertree.traverse(tree, tree, x, u, x, u, 0.9) for p, q in zip(ps, qs, strict=True)]
    assert sorted(got) == list(zip(*np.nonzero(np.triu(near, 1)), strict=True))
    half = len(x) // 2
    a, b = covertree.grow(u[:half], np.arange(half)), covertree.grow(u[half:], np.arange(len(x) - half))
    got = [(p, q) for ps, qs in covertree.traverse(a, b, x[:half], u[:half], x[half:], u[half:], 0.9) for p, q in zip(ps, qs, strict=True)]
    assert sorted(got) == list(zip(*np.nonzero(near[:half, half:]), strict=True))


def same_tree(a, b, order):
    assert (a.points == order[b.points]).all() and abs(a.radius - b.radius) < 1e-12 and len(a.children) == len(b.children)
    for c, d in zip(a.children, b.children, strict=True):
        same_tree(c, d, order)


@pytest.mark.parametrize("x", [clouds(700, 8), unrelated(400), nested_clouds(900), np.ones((1, 4)), np.ones((50, 4))])
def test_tree_from_its_outline_is_the_tree(x, monkeypatch):
    monkeypatch.setattr(covertree, "LEAF", 4)
    u = covertree.unit(x)
    tree = covertree.grow(u, np.arange(len(u)))
    same_tree(tree, covertree.regrow(u[tree.points], *covertree.outline(tree)), tree.points)


def test_bounds_prune_most_pairs_of_nested_clusters():
    x = nested_clouds(4096)
    u = covertree.unit(x)
    tree, compared = covertree.grow(u, np.arange(len(u))), []
    links = sum(len(p) for p, _ in covertree.traverse(tree, tree, x, u, x, u, 0.9, compared))
    # 2.2 % of the pairs are links
    assert 0.02 < links / (len(u) * (len(u) - 1) / 2) < 0.025
    assert sum(compared) < 0.15 * len(u) * (len(u) - 1) / 2
