"""Histogram sort against a sort of all rows in Python."""

import hashlib
import random
import zlib

from churnlab.llm.histsort import histogram_sort
from llm_data import docs, rows_of

COLUMNS = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def brute(rows, shards=8):
    keyed = []
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        keyed.append((int(hashlib.md5(data).hexdigest()[:15], 16), doc_id, len(data) + 1, zlib.crc32(data)))
    keyed.sort(key=lambda r: (r[0], r[1]))
    total, before, slots, out = sum(r[2] for r in keyed), 0, [0] * shards, []
    for _, doc_id, size, crc in keyed:
        shard = before * shards // total
        out.append((doc_id, size, crc, "bytes", shard, slots[shard], None))
        slots[shard] += 1
        before += size
    return sorted(out, key=lambda r: r[0])


def check(spark, rows, **options):
    got = rows_of(histogram_sort(docs(spark, rows), **options), *COLUMNS)
    assert got == brute(rows, options.get("shards", 8))
    return got


def test_equals_a_full_sort(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randrange(400) + str(rng.randrange(60))) for i in range(700)]
    check(spark, rows)
    check(spark, rows, shards=3, fan=5)


def test_a_group_of_copies_larger_than_a_shard_is_cut_by_doc_id(spark):
    rows = [(i * 3, "the same text" if i % 3 else f"own {i}") for i in range(600)]
    got = check(spark, rows)
    sizes = [sum(r[1] for r in got if r[4] == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r[1] for r in got)


def test_a_huge_row_and_wide_ids(spark):
    check(spark, [(-(2**62), "a" * 50_000), (2**62, "b"), (0, "c"), (1, "é" * 10), (5, "c"), (2**61, "c")])


def test_null_empty_and_equal_rows(spark):
    rows = [(1, None), (2, ""), (3, "x"), (None, "x"), (4, None)]
    got = rows_of(histogram_sort(docs(spark, rows)), *COLUMNS)
    assert len(got) == 5 and {r[1] for r in got if r[0] in (1, 2, 4)} == {1}
    same = rows_of(histogram_sort(docs(spark, [(9, "twice")] * 40)), "shard", "slot")
    assert same == [(0, s) for s in range(40)]


def test_empty_table(spark):
    out = histogram_sort(docs(spark, []))
    assert out.columns == list(COLUMNS) and out.count() == 0
