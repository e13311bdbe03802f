"""Fair queueing against a direct computation."""

import hashlib
import math
import random
import re

from churnlab.llm import wfq
from llm_data import docs, rows_of


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    keys = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {k: wfq.WEIGHTS[i % 3] for i, k in enumerate(keys)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = budget - sum(2 * sizes[k] for k in full)
        rest = sum(weights[k] for k in keys if k not in full)
        if not rest:
            break
        more = {k for k in keys if k not in full and 2 * sizes[k] < weights[k] * left / rest}
        if not more:
            break
        full |= more
    return {k: float(2 * sizes[k]) if k in full else weights[k] * left / rest for k in keys}


def brute(rows):
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + size_of(text)
    due, queue = targets(sizes), []
    for source in sizes:
        upto = 0
        passes = max(1, min(2, math.ceil(due[source] / max(1, sizes[source]))))
        own = [(p, hashlib.md5(f"mix/{p}/{r[0]}".encode()).hexdigest(), r[0], size_of(r[1])) for r in rows if r[3] == source for p in range(1, passes + 1)]
        for p, _, doc_id, size in sorted(own):
            upto += size
            queue.append((upto / due[source] if due[source] else 0.0, "1" if source is None else "0" + source, doc_id, p, size))
    taken, total, budget = {r[0]: 0 for r in rows}, 0, int(1.5 * sum(sizes.values()))
    for _, _, doc_id, _, size in sorted(queue):
        total += size
        taken[doc_id] += size if total <= budget else 0
    return sorted((r[0], size_of(r[1]), sizes[r[3]], due[r[3]], taken[r[0]]) for r in rows)


def sample(n=300, seed=3):
    rng = random.Random(seed)
    sources = ["hot", "b", "c", "Zz", None, "é"]
    return [(i, "w " * rng.randrange(0, 60), "en", "hot" if rng.random() < 0.4 else rng.choice(sources)) for i in range(n)]


def test_equals_direct_computation(spark, monkeypatch):
    monkeypatch.setattr(wfq, "BUCKET_ROWS", 7)
    rows = sample()
    got = rows_of(wfq.mix(docs(spark, rows)), "doc_id", "size", "source_size", "target", "taken")
    assert got == brute(rows)


def test_sources_come_near_their_targets(spark):
    rows = sample(900, 5)
    out = wfq.mix(docs(spark, rows)).collect()
    for key in {(r.source_size, r.target) for r in out}:
        took = sum(r.taken for r in out if (r.source_size, r.target) == key)
        assert abs(took - key[1]) <= 2 * 60 + 0.02 * key[1]
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in out)


def test_reruns_agree(spark):
    frame = docs(spark, sample())
    assert rows_of(wfq.mix(frame)) == rows_of(wfq.mix(frame.repartition(5)))


def test_nulls_empties_and_empty_table(spark):
    rows = [(1, None, "en", None), (2, "", "en", "a"), (3, "one two", "en", "a"), (None, "x", "en", "b"), (4, "y", "en", "b"), (4, "y", "en", "b")]
    out = rows_of(wfq.mix(docs(spark, rows)), "doc_id", "size", "taken")
    assert len(out) == 6 and all(t <= 2 * s for _, s, t in out)
    assert wfq.mix(docs(spark, [])).count() == 0
    assert rows_of(wfq.mix(docs(spark, [(1, None), (2, " ")])), "size", "target", "taken") == [(0, 0.0, 0)] * 2


def test_mixed_documents_repeat_what_is_taken_twice(spark):
    rows = sample(200, 8)
    frame = docs(spark, rows)
    taken = {r[0]: r[2] // r[1] for r in rows_of(wfq.mix(frame), "doc_id", "size", "taken") if r[2]}
    counts = {}
    for r in wfq.mixed_documents(frame).collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == taken


def test_repeated_rows_count_each_against_the_budget(spark):
    rows = [(i, "some words of it", None, "a") for i in range(40)] + [(100, "a row that is there again", None, "b")] * 60
    frame = docs(spark, rows)
    words = sum(r[2] for r in rows_of(wfq.mix(frame), "doc_id", "size", "taken"))
    assert sum(len(r.text.split()) for r in wfq.mixed_documents(frame).collect()) == words
