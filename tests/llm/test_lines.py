"""Line dedup against a direct computation, and undoing it."""

import hashlib
import random

import numpy as np

from churnlab.llm.cuckoo import CuckooFilter, FilterStack
from churnlab.llm.linededup import LineIndex, dedupe_lines
from llm_data import docs, rows_of

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows):
    first, held = {}, {}
    for doc_id, text, *_ in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 10:
                held.setdefault(k, set()).add(doc_id)
    first = {k: min(v) for k, v in held.items() if len(v) > 1}
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if first.get(key(x), doc_id) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def random_docs(n=120, seed=0):
    rng = random.Random(seed)
    pool = [f"a shared line number {i}" for i in range(30)] + ["short", "", "   ", "ÄÖÜ äöü ß lines", "\tTABBED line here \r"]
    rows = []
    for i in range(n):
        lines = [rng.choice(pool) if rng.random() < 0.6 else f"line {rng.random()} of its own" for _ in range(rng.randrange(8))]
        rows.append((i * 7 % 1000, "\n".join(x.upper() if rng.random() < 0.2 else x for x in lines)))
    return rows + [(2000, None), (2001, ""), (2002, "the hottest line of all\n" * 40), (2003, "The hottest line of all ")]


def result(df):
    return rows_of(df, "doc_id", "n_lines", "n_dropped", "text")


def test_equals_direct_computation(spark):
    rows = random_docs()
    assert result(dedupe_lines(docs(spark, rows))) == brute(rows)


def test_a_line_in_every_document(spark):
    rows = [(i, f"one line that all have\nown line {i} of it") for i in range(300)]
    assert result(dedupe_lines(docs(spark, rows))) == brute(rows)


def test_adding_and_removing_is_reversible(spark, tmp_path):
    rows = random_docs(80, 4)
    early, late = rows[:50], rows[50:]
    index = LineIndex(spark, str(tmp_path / "index"), shards=4)
    index.add(docs(spark, early))
    assert result(index.dedupe(docs(spark, early))) == brute(early)
    index.add(docs(spark, late))
    assert result(index.dedupe(docs(spark, rows))) == brute(rows)
    index.remove(spark.createDataFrame([(r[0],) for r in early[:20]], "doc_id long"))
    assert result(index.dedupe(docs(spark, rows[20:]))) == brute(rows[20:])
    index.remove(spark.createDataFrame([(r[0],) for r in late], "doc_id long"))
    assert result(index.dedupe(docs(spark, rows[20:50]))) == brute(rows[20:50])


def test_repeated_rows_nulls_and_empty_table(spark):
    rows = [(1, "the same line twice"), (1, "the same line twice"), (2, "the same line twice\nx"), (1, "the same line twice\nother text")]
    assert result(dedupe_lines(docs(spark, rows))) == brute(rows)
    got = result(dedupe_lines(docs(spark, [(None, "a line without an id"), (5, "a line without an id")])))
    assert [r[2] for r in got] == [0, 0]
    assert dedupe_lines(docs(spark, [])).count() == 0


def test_digest_of_null_text(spark):
    row = dedupe_lines(docs(spark, [(1, None)])).first()
    assert (row.n_lines, row.n_dropped, row.text) == (1, 0, "")
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def keys(n, seed):
    x = np.random.default_rng(seed).integers(-(2**63), 2**63, (n, 2))
    return x[:, 0].copy(), x[:, 1].copy()


def test_cuckoo_filter_has_no_false_negative():
    f, (a, b) = CuckooFilter(5000), keys(5000, 1)
    f.insert(a, b)
    assert f.contains(a, b).all()
    assert f.contains(*keys(20000, 2)).mean() < 0.002
    f.delete(a[:2500], b[:2500])
    assert f.contains(a[2500:], b[2500:]).all() and f.contains(a[:2500], b[:2500]).mean() < 0.05


def test_full_filter_overflows_exactly_and_stack_grows():
    f, (a, b) = CuckooFilter(100), keys(400, 3)
    f.insert(a, b)
    assert len(f.overflow) and f.contains(a, b).all()
    f.delete(a, b)
    assert not len(f.overflow) and not f.table.any()
    stack = FilterStack()
    for i in range(0, 400, 50):
        stack.insert(a[i : i + 50], b[i : i + 50])
    stack = FilterStack.load(stack.dump())
    assert len(stack.parts) > 1 and stack.contains(a, b).all()
    stack.delete(a, b)
    assert sum(stack.keys) == 0 and not stack.contains(a, b).any()


def test_deleting_from_a_grown_stack_keeps_the_other_keys():
    stack, (a, b) = FilterStack(), keys(160_000, 4)
    for i in range(0, 160_000, 20_000):
        stack.insert(a[i : i + 20_000], b[i : i + 20_000])
    assert len(stack.parts) > 1 and stack.contains(a, b).all()
    gone = np.arange(len(a)) % 4 > 0
    stack.delete(a[gone], b[gone])
    assert stack.contains(a[~gone], b[~gone]).all() and sum(stack.keys) == (~gone).sum()
    stack.delete(a[~gone], b[~gone])
    assert sum(stack.keys) == 0 and not any(p.table.any() or len(p.overflow) for p in stack.parts)


def test_index_is_taken_up_where_it_was_left(spark, tmp_path):
    rows = random_docs(80, 4)
    early, late = rows[:50], rows[50:]
    folder = str(tmp_path / "index")
    index = LineIndex.open(spark, folder)
    assert index.version == 0
    index.remove(spark.createDataFrame([(1,)], "doc_id long"))
    index.shards = 4
    index.add(docs(spark, early))
    del index
    index = LineIndex.open(spark, folder)
    assert (index.version, index.shards, index.batches) == (1, 4, [1])
    index.add(docs(spark, late))
    index = LineIndex.open(spark, folder)
    assert result(index.dedupe(docs(spark, rows))) == brute(rows)
    index.remove(spark.createDataFrame([(r[0],) for r in early[:20]], "doc_id long"))
    # a driver lost in the middle of a version: its files are there, its row is not
    lost = LineIndex.open(spark, folder)
    lost._log = lambda kind: None
    lost.add(docs(spark, random_docs(30, 9)))
    index = LineIndex.open(spark, folder)
    assert index.version == 3
    assert result(index.dedupe(docs(spark, rows[20:]))) == brute(rows[20:])
    index.remove(spark.createDataFrame([(r[0],) for r in late], "doc_id long"))
    index = LineIndex.open(spark, folder)
    assert (index.version, index.batches, index.removals) == (4, [1, 2], [3, 4])
    assert result(index.dedupe(docs(spark, rows[20:50]))) == brute(rows[20:50])
    again = random_docs(30, 9)
    index.add(docs(spark, [(r[0] + 10_000, *r[1:]) for r in again]))
    both = rows[20:50] + [(r[0] + 10_000, *r[1:]) for r in again]
    assert result(LineIndex.open(spark, folder).dedupe(docs(spark, both))) == brute(both)
