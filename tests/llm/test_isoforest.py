"""Rule statistics and the isolation forest against plain versions."""

import math
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from churnlab.llm import isoforest
from llm_data import docs, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    lines, repeats = [x for x in text.split("\n") if WORD.search(x)], 0
    for i, line in enumerate(lines):
        repeats += line in lines[:i]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeats, len(covered)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab# \n\t\x0b\x1c  |é", max_size=60)), max_size=6))
def test_statistics_equal_plain_ones(texts):
    got = isoforest.statistics([t or "" for t in texts])
    assert [tuple(r) for r in got.tolist()] == [plain_statistics(t) for t in texts]


def plain_score(forest_rows, starts, size, point):
    """The mean path through nodes (feature, cut, left, right, path), one by one."""
    total = 0.0
    for start in starts:
        at = start
        while forest_rows[at][0] >= 0:
            f, cut, left, right, _ = forest_rows[at]
            at = right if point[f] > cut else left
        total += forest_rows[at][4]
    usual = 2 * sum(1 / k for k in range(1, size)) - 2 * (size - 1) / size
    return 2 ** -(total / len(starts) / usual)


def test_tree_paths_and_scores_equal_plain_ones():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 6, (64, 4)).astype(float)
    trees = [isoforest.grow(points, np.random.default_rng(t)) for t in range(9)]
    forest = isoforest.Forest(trees, 64)
    rows = list(zip(forest.feature.tolist(), forest.cut.tolist(), forest.left.tolist(), forest.right.tolist(), forest.path.tolist(), strict=True))
    got = forest.scores(points)
    assert np.allclose(got, [plain_score(rows, forest.starts.tolist(), 64, p) for p in points], rtol=1e-12)
    # the leaves of a tree hold every point once, at most log2(n) splits deep
    for tree in trees:
        assert all(node[4] < math.log2(64) + isoforest.usual_path(64) for node in tree)
    odd = forest.scores(np.array([[50.0, 50.0, 50.0, 50.0]]))[0]
    assert odd > got.mean()


def prose(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(n))


def corpus():
    rows = [(i, prose(60 + i % 50, i)) for i in range(120)]
    junk = [(1000 + i, " ".join(w + "$$$" for w in prose(70, 500 + i).split())) for i in range(12)]
    return rows, junk


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, score int")


def test_anomalies_go_and_usual_documents_stay(spark):
    good, junk = corpus()
    named = [(i, 1, 0, 1) for i, _ in good[::3]] + [(i, 0, 0, 1) for i, _ in junk[::3]]
    got = {r["doc_id"]: r for r in isoforest.judged(docs(spark, good + junk), labels(spark, named)).collect()}
    assert all(got[i]["kept"] for i, _ in good)
    assert not any(got[i]["kept"] or got[i]["base_failed"] for i, _ in junk)
    for i, text in good[::20] + junk[::5]:
        assert tuple(got[i][c] for c in isoforest.STATISTICS) == plain_statistics(text)


def test_copies_of_junk_do_not_look_usual(spark):
    good, junk = corpus()
    copies = [(2000 + i, junk[0][1]) for i in range(150)]  # more than all others
    named = [(i, 1, 0, 1) for i, _ in good[::3]] + [(junk[0][0], 0, 0, 1)]
    got = {r["doc_id"]: r["kept"] for r in isoforest.judged(docs(spark, good + copies + junk[:1]), labels(spark, named)).collect()}
    assert all(got[i] for i, _ in good) and not any(got[i] for i, _ in copies)


def test_cut_equals_trying_every_cut():
    rng = np.random.default_rng(5)
    for _ in range(50):
        counts = [(int(s), int(g), int(b)) for s, g, b in zip(rng.permutation(30)[:8], rng.integers(0, 40, 8), rng.integers(0, 9, 8), strict=True)]
        good, low = sum(c[1] for c in counts), sum(c[2] for c in counts)
        gains = {c[0]: sum(b for s, _, b in counts if s >= c[0]) / low - 5 * sum(g for s, g, _ in counts if s >= c[0]) / good for c in counts}
        got = isoforest.best_cut(counts, 5.0)
        best = max(gains.values())
        assert (got is None and best <= 0) or math.isclose(gains[got], best)
    assert isoforest.best_cut([(3, 0, 5)]) is None and isoforest.best_cut([]) is None


def test_odd_rows(spark):
    long = " ".join(f"w{i % 4999}x" for i in range(120_000)) + " zz zz zz"
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, prose(60, 1)), (4, prose(60, 2)), (4, prose(60, 2)), (5, long), (6, "a b c " * 40)]
    named = labels(spark, [(None, 1, 0, 1), (4, None, 0, 1), (4, 1, 0, 1), (4, 0, 0, 1), (77, 0, 0, 1)])
    got = rows_of(isoforest.judged(docs(spark, rows), named), "doc_id", *isoforest.STATISTICS, "base_failed")
    want = [(i, *plain_statistics(t)) for i, t in rows if i != 5]
    assert [g[:-1] for g in got if g[0] != 5] == sorted(want, key=lambda r: [(x is not None, x) for x in r])
    assert {g[0]: g[-1] for g in got} == {None: False, 1: True, 2: True, 3: True, 4: False, 5: True, 6: True}
    assert next(g[5] for g in got if g[0] == 5) == 120_000  # the cycle returns, its end does not


def test_no_labels_and_no_rows(spark):
    good, junk = corpus()
    none = labels(spark, [])
    assert all(r["kept"] != r["base_failed"] for r in isoforest.judged(docs(spark, good[:9] + junk[:2]), none).collect())
    assert isoforest.judged(docs(spark, []), none).collect() == []
