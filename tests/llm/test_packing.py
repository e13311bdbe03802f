"""Packing, token pieces and ORC files: invariants and exact round trips."""

import random
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from churnlab.llm import orcout, tokens, vecfit, wordlid
from churnlab.llm.tokens import WordEncoder
from llm_data import docs, rows_of

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "a", "  two  spaces ", "line\n\nbreaks\r\n\tand tabs", "it's we'll DON'T", "<|endoftext|> a<|startoftext|>b", "a\x1cb \x1d c", "é é ́x",
    "a b 　c", "ΑΣ ΣΑΣ İ ǅ 123 45!! ²½", "​ x \x85 y", "🤦🏼‍♂️ x", " \n", "a\n b", "a \nb", "word. word, (word) «word» ﬁ", "x" * 300,
    "end \0", "a \0b", "\0", "\0a \0\n\0 b", "\n", "\nb", "a\n", " \0",
]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_word_encoder_equals_whole_texts(path):
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    encoder = WordEncoder(path)
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("aB é\n \t.,!1ß中́'’\0") for _ in range(rng.randrange(60))) for _ in range(400)]
    ids, offsets = encoder.encode(texts)
    for text, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
        assert ids[a:b].tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_words_are_cut_at_the_files_white_space(path):
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    rng = random.Random(6)
    texts = ["!\x1c  a", ".\x1f\n"] + ["".join(rng.choice("aB1!. \n\t\x1c\x1d\x1e\x1f\x85\xa0\u2028\u200b'") for _ in range(14)) for _ in range(500)]
    ids, offsets = WordEncoder(path).encode(texts)
    for text, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
        assert ids[a:b].tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_letters_are_looked_up_once_for_all_words_that_hold_them(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 8)

    class Counted:
        def __init__(self, model):
            self.model, self.asked = model, []

        def tokenize(self, piece):
            self.asked.append(piece)
            return self.model.tokenize(piece)

    encoder = WordEncoder(BYTES)
    encoder.model = counted = Counted(encoder.model)
    first, _ = encoder.encode(["- alpha beta gamma"])
    again, _ = encoder.encode(["- alpha. beta, gamma"])
    assert [p for p in counted.asked if p.isalpha()] == ["\u0120alpha", "\u0120beta", "\u0120gamma"]
    whole = Tokenizer.from_file(BYTES)
    assert first.tolist() == whole.encode("- alpha beta gamma").ids and again.tolist() == whole.encode("- alpha. beta, gamma").ids


def test_cut_only_the_first_may_be_shorter():
    assert vecfit.cut(5, 4) == [(0, 1), (1, 5)]
    assert vecfit.cut(8, 4) == [(0, 4), (4, 8)]
    assert vecfit.cut(3, 4) == [(0, 3)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20), st.sampled_from(["norm", "dot"]), st.sampled_from([None, 3]), st.sampled_from([None, 1500]))
def test_plan_respects_every_capacity(lengths, score, documents, attention):
    lengths = {k: n for k, n in lengths.items() if attention is None or k * k <= attention}
    slots, sequences = vecfit.plan(lengths, 64, documents, attention, score=score)
    placed = {}
    for length in lengths:
        own = sorted(s[1:] for s in slots if s[0] == length)
        assert [s[0] for s in own] == [0, *(s[1] for s in own[:-1])] and own[-1][1] == lengths[length]
        for lo, hi, first, per, used in own:
            for rank in range(hi - lo):
                placed.setdefault(first + rank // per, []).append((used + rank % per * length, length))
    assert sorted(placed) == list(range(sequences))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64 and len(parts) <= (documents or 64) and sum(n * n for _, n in parts) <= (attention or 64 * 64)
    tokens = sum(k * n for k, n in lengths.items())
    if score == "norm" and documents is None and attention is None:
        assert sequences <= 11 / 9 * max(1, -(-tokens // 64)) + 2 + sum(n for k, n in lengths.items() if k > 32)


def test_default_plan_is_bound_by_tokens_only():
    lengths = {1: 70, 3: 40, 17: 9, 33: 5, 64: 2}
    assert vecfit.plan(lengths, 64) == vecfit.plan(lengths, 64, documents=64, attention=64 * 64)
    assert "act through the score" in vecfit.__doc__


def sample(n=150):
    rng = random.Random(2)
    words = ["the", "Of", "année", "zzyzx", "12", "x.", "über"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 300, 2500])))) for i in range(n)]
    return rows + [(900, None), (901, ""), (902, "the same"), (902, "the same"), (903, "a b " * 3000)] + [(1000 + i, "copy of one") for i in range(80)]


def test_packed_documents(spark, monkeypatch):
    monkeypatch.setattr(vecfit, "BUCKET_ROWS", 9)
    rows = sample()
    out = vecfit.packed_documents(docs(spark, rows), BYTES).collect()
    whole = Tokenizer.from_file(BYTES)
    want = []
    for doc_id, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(doc_id, n, a, b - a, crc(ids[a:b])) for n, (a, b) in enumerate(vecfit.cut(len(ids), 2048))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    ends = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
    assert len(ends) <= 1.05 * sum(w[3] for w in want) / 2048 + 1


def test_pieces_carry_their_ids(spark):
    rows = vecfit.pieces(docs(spark, [(1, "one two three"), (2, None)]), BYTES, limit=2, with_ids=True).collect()
    whole = Tokenizer.from_file(BYTES).encode("one two three").ids + [0]
    assert [x for r in sorted(rows, key=lambda r: r.piece) if r.doc_id == 1 for x in r.ids] == whole
    assert all(crc(r.ids) == r.ids_crc32 for r in rows)
    assert vecfit.packed_documents(docs(spark, []), BYTES).count() == 0


def test_orc_round_trip(spark, tmp_path):
    rows = [(r[0] * 3 % 997, r[1]) for r in sample(60)][:-80] + [(5000 + i, t) for i, t in enumerate(ODD)]
    folder = str(tmp_path / "tokens")
    orcout.write_tokens(docs(spark, rows), folder, WORDS)
    read = orcout.read_tokens(spark, folder)
    whole = Tokenizer.from_file(WORDS)
    whole.encode_special_tokens = True
    want = sorted((i, [*whole.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows)
    assert sorted((r.doc_id, list(r.ids)) for r in read.collect()) == want
    start, layout = 0, []
    for doc_id, ids in sorted(want, key=lambda r: (r[0], crc(r[1]), len(r[1]))):
        layout.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, orcout.layout(read).collect())) == sorted(layout)
    some = orcout.documents_of(spark, folder, [5000, 5003, 77777])
    assert sorted(r.doc_id for r in some.collect()) == [5000, 5003]
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()


def test_orc_files_are_in_order(spark, tmp_path):
    folder = str(tmp_path / "tokens")
    orcout.write_tokens(docs(spark, [((i * 37) % 500, "some words") for i in range(500)]).repartition(7), folder, WORDS)
    files = sorted((tmp_path / "tokens").glob("part-*.orc"))
    ids = [[r.doc_id for r in spark.read.orc(str(f)).collect()] for f in files]
    assert [x for f in ids for x in f] == list(range(500))


def rows_scanned(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_orc_bloom_filters_skip_row_groups(spark, tmp_path):
    folder = str(tmp_path / "tokens")
    table = docs(spark, [(2 * i, "x") for i in range(3000)])
    orcout.write_tokens(table, folder, WORDS)
    present, absent = (orcout.documents_of(spark, folder, [i]) for i in (2000, 2001))
    assert 0 < rows_scanned(present) < 3000
    # 2001 lies within the minima and maxima; the Bloom filter rules it out
    assert rows_scanned(absent) == 0


def test_orc_of_an_empty_table(spark):
    assert rows_of(orcout.token_files(docs(spark, []), WORDS)) == []
    assert rows_of(orcout.token_files(docs(spark, [(None, None), (3, "x")]), WORDS), "doc_id", "start", "n_tokens") == [(None, 0, 1), (3, 1, 2)]


def resident():
    """Anonymous memory of this process in MB."""
    return int(re.search(r"\nRssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


@pytest.mark.parametrize("step", ["pack", "language"])
def test_a_reused_worker_gives_back_what_earlier_tasks_freed(step):
    batch = pa.record_batch({"doc_id": pa.array([1]), "text": pa.array(["a few words"])})
    model = wordlid.Model(["en"], [("en", 0, "few", 3)])
    run = {"pack": lambda: list(vecfit._pieces(iter([batch]), BYTES, 0, 2048, False)), "language": lambda: list(wordlid._with_language(iter([batch]), model, 1))}[step]
    run()
    before = resident()
    # blocks of malloc below its mmap threshold; every 500th stays, so none of the heap's end is free
    earlier = [bytes(2000) for _ in range(100_000)]
    held = earlier[::500]
    del earlier
    assert resident() - before > 100
    run()
    assert resident() - before < 50
    assert len(held) == 200


def test_packing_holds_few_words_and_encodes_little_at_once(monkeypatch):
    monkeypatch.setattr(vecfit, "CACHE_WORDS", 100)
    monkeypatch.setattr(vecfit, "ENCODE_BYTES", 500)
    texts = [" ".join(f"{chr(97 + i % 26)}{i}w{j}" for j in range(20)) for i in range(200)]
    batch = pa.record_batch({"doc_id": pa.array(range(200)), "text": pa.array(texts)})
    tokens.encoder.cache_clear()
    found = pa.Table.from_batches(vecfit._pieces(iter([batch]), BYTES, 0, 2048, False)).to_pylist()
    assert len(tokens.encoder(BYTES, 100).words) < 250
    whole = Tokenizer.from_file(BYTES)
    assert [r["ids_crc32"] for r in found] == [crc(whole.encode(t, add_special_tokens=False).ids + [0]) for t in texts]
