"""Prefix tries against a plain trie and the query's SQL."""

import hashlib
import random
import re
import zlib

import pytest

from churnlab.llm import bursttrie
from llm_data import rows_of

SCHEMA = "conv_id long, turn long, role string, text string, h int, n int, heads int, depth int, rep int, skey int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1, 1, 1, 1) for r in rows], SCHEMA)


def digest(turn):
    role, text = turn
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def plain(rows):
    """Every node by its prefix, from the contract's words."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest((role or "", text or "")), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])
        whole[c] = tuple(base[:h] + turns[h:])
    members = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = []
    for p, convs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in members) for q in below)
        saved = sum((len(members[q]) - 1) * (len(WORD.findall(q[-1][1])) if q else 0) for q in below)
        ends = ",".join(map(str, sorted(c for c in convs if len(whole[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(convs), len(p), parent, len(convs), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: [(x is not None, x) for x in r])


def trie(spark, rows, **limits):
    got = bursttrie.prefix_trie(bursttrie.rebuilt(table(spark, rows)), **limits)
    assert got.columns == bursttrie.COLUMNS
    return rows_of(got)


def talk(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        few = rng.random() < 0.6
        for t in range(rng.randrange(1, 7)):
            say = f"say {rng.randrange(2)}" if few else f"say {rng.randrange(40)} more words here"
            rows.append((c * 3 - 20, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), say if rng.random() < 0.95 else None))
    return rows


@pytest.mark.parametrize("limits", [{}, {"limit": 1}, {"limit": 4}])
def test_equals_plain(spark, limits):
    rows = talk(90, 1)
    assert trie(spark, rows, **limits) == plain(rows)


def test_hot_conversation_and_first_turn(spark, monkeypatch):
    monkeypatch.setattr(bursttrie, "PIECE", 7)
    monkeypatch.setattr(bursttrie, "BATCH", 5)
    rows = [(c * 20, t, "user", f"t {t}") for c in range(60) for t in range(3)]  # copies
    rows += [(c * 20, t, "user", "t 0" if t == 0 else f"x {c} {t}") for c in range(60, 90) for t in range(4)]
    assert trie(spark, rows, limit=4) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "gone"),
        (0, None, None, None),
        (0, 1, "user", "a b"),
        (0, 1, "user", "a b"),  # repeated
        (0, 1, "us", "era b"),  # another turn of the same letters
        (5, 3, "", ""),
        (40, 2, "x", "y"),
        (41, 1, "only", "one turn"),  # may lose it to the first h
        (63, 1, "only", "one turn"),
        (-7, 1, "neg", "id"),
        (2**40 + 1, 9, "big", "id"),
    ]
    assert trie(spark, rows) == plain(rows)
    assert trie(spark, rows, limit=1) == plain(rows)


def test_long_and_empty(spark):
    rows = [(20, t, "user", "w " * (t % 5)) for t in range(3000)] + [(40, t, "user", "w " * (t % 5)) for t in range(2999)]
    rows += [(60, 0, "user", "x" * 300_000)]
    got = trie(spark, rows, limit=1)
    own = [r for r in got if r[1] == 2999]
    assert len(got) == 1 + 3000 + 1 and own[0][3] == 2 and max(r[1] for r in got) == 3000
    assert trie(spark, []) == []


def test_no_container_is_larger_than_its_limit(spark, monkeypatch):
    """Only containers within the limit are swept, and larger ones do occur."""
    rows = talk(200, 3)
    sequences = bursttrie.distinct_sequences(bursttrie.rebuilt(table(spark, rows))).count()
    real, kept = bursttrie.sweep_container, bursttrie._sweep
    bound = 5

    def sweep(batches):
        def watched(held, *about):
            assert len(held) <= bound
            return real(held, *about)

        bursttrie.sweep_container = watched
        return kept(batches)

    monkeypatch.setattr(bursttrie, "_sweep", sweep)
    assert trie(spark, rows, limit=bound) == plain(rows)
    assert sequences > bound
