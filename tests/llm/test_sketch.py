"""Fast similarity sketching and near groups against brute force."""

import random

import numpy as np

from churnlab.llm import fastsketch
from churnlab.llm.shingles import shingle_sets
from llm_data import docs, rows_of


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    sets = {}
    for doc_id, text, *_ in rows:
        sets.setdefault(doc_id, []).append(shingles(text))
    label = {i: i for i in ids}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    out = []
    for doc_id, text, *_ in rows:
        linked = doc_id is not None and bool(shingles(text))
        component = find(doc_id) if linked else doc_id
        out.append((doc_id, len(shingles(text)), component, doc_id is None or component == doc_id))
    return sorted(out, key=lambda r: (r[0] is not None, r[0]))


def near_copies(seed=0, groups=6, members=40, words=80):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(words)]
        for _ in range(members):
            text = list(base)
            for _ in range(rng.randrange(7)):
                text[rng.randrange(words)] = f"n{rng.randrange(10**6)}"
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return list(enumerate(rows))


def result(df):
    return rows_of(df, "doc_id", "n_shingles", "component_id", "kept")


def test_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fastsketch, "BLOCK_ROWS", 16)
    rows = near_copies()
    passage = "a passage of many words that a good number of documents have in common so that they share buckets"
    rows += [(1000 + i, f"{passage} own{i} a{i} b{i} c{i} d{i}") for i in range(30)]
    rows += [(2000 + i, "an exact copy of a text of some words") for i in range(50)] + [(2100, "An EXACT copy\tof a text of\nsome words")]
    assert result(fastsketch.near_groups(docs(spark, rows))) == brute(rows)


def test_short_null_empty_and_repeated(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "two words"), (5, "Two  Words"), (6, "two words more"), (7, None), (None, "two words"), (8, "É x"), (9, "é x"), (4, "two words")]
    assert result(fastsketch.near_groups(docs(spark, rows))) == brute(rows)
    assert fastsketch.near_groups(docs(spark, [])).count() == 0


def test_a_chain_of_links_is_one_component(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(50 - i, " ".join(words[i * 8 : i * 8 + 100])) for i in range(20)]
    assert result(fastsketch.near_groups(docs(spark, rows))) == brute(rows)


def test_shingle_sets_tell_texts_apart():
    texts = ["a b c d e f", "a b c d e", "a b c d", "ab c d", "a bc d", "", " ", "e d c b a", "a b c d e f a b c d e", "x\x0by\x1cz", "A B C D E F"]
    s, off = shingle_sets([t.encode() for t in texts])
    got = [frozenset(s[a:b].tolist()) for a, b in zip(off[:-1], off[1:], strict=True)]
    want = [shingles(t) for t in texts]
    for i, x in enumerate(texts):
        for j, y in enumerate(texts):
            assert len(got[i] & got[j]) == len(want[i] & want[j]), (x, y)


def test_sketches_fill_every_bin_and_estimate_similarity():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 5, 40, 500, 5000)]
    both = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sets += [both[:2400], both[600:], np.zeros(0, np.uint64)]
    off = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    marks = fastsketch.sketches(np.concatenate(sets), off)
    assert (marks[:-1] != 0).mean() > 0.999 and not marks[-1].any()
    assert len(np.unique(marks[0])) == fastsketch.BINS
    agree = (marks[6] == marks[7]).mean()
    assert abs(agree - 0.6) < 5 * np.sqrt(0.24 / fastsketch.BINS)


def test_intersections_by_both_ways(monkeypatch):
    rng = np.random.default_rng(0)
    a, b = ([np.unique(rng.integers(0, 90, rng.integers(0, 40))) for _ in range(n)] for n in (33, 21))
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    for rare, pairs in ((1024, 10**6), (4, 50), (0, 10)):
        monkeypatch.setattr(fastsketch, "RARE", rare)
        monkeypatch.setattr(fastsketch, "PAIRS", pairs)
        assert fastsketch.intersections(a, b).tolist() == want
