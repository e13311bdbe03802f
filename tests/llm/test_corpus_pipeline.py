"""The pipeline, stage by stage, against brute force; the SQL of the queries."""

import public_tokenizers
import pytest

import churnlab.plans.catalog as catalog
import churnlab.plans.oracle as oracle
import corpus_pipeline
import oracle_harness
from churnlab.llm.oracle import SQL
from churnlab.llm.queries import QUERIES
from conftest import SF001, SF01
from llm_data import docs, rows_of
from test_lines import brute as brute_lines
from test_packing import crc
from test_sketch import brute as brute_groups
from tokenizers import Tokenizer

PLACED = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, monkeypatch, name):
    monkeypatch.setitem(catalog.QUERIES, name, QUERIES[name])
    monkeypatch.setitem(oracle.SQL, name, SQL[name])
    got = oracle_harness.compare(spark, name, SF001 if name == "op7_fast_sketch" else SF01)
    assert got["ok"], got


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_against_brute_force(spark):
    whole = spark.read.parquet(f"{SF001}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, whole, SF001)
    assert kept.columns == corpus_pipeline.COLUMNS
    assert rows_of(kept, "doc_id", "text") == rows_of(whole, "doc_id", "text")

    lines = corpus_pipeline.line_dedup(spark, kept, SF001)
    want = brute_lines([(r.doc_id, r.text) for r in kept.collect()])
    assert rows_of(lines, "doc_id", "text", "n_chars") == [(r[0], r[3], len(r[3])) for r in want]

    single = corpus_pipeline.near_dedup(spark, lines, SF001)
    groups = brute_groups([(r[0], r[3]) for r in want])
    assert [r[0] for r in rows_of(single, "doc_id")] == [r[0] for r in groups if r[3]]

    mixed = corpus_pipeline.mix_sources(spark, single, SF001)
    assert mixed.columns == corpus_pipeline.COLUMNS
    texts = {r.doc_id: r.text for r in single.collect()}
    counts = {}
    for r in mixed.collect():
        assert r.text == texts[r.doc_id]
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(counts.values()) <= 2


def test_run_packs_what_the_mix_takes(spark):
    out = corpus_pipeline.run(spark, SF001).collect()
    assert out and set(out[0].asDict()) == set(PLACED)
    ends = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


def test_odd_rows_go_through_all_stages(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "...", None, "b"), (4, "the words of the text", "en", None), (4, "the words of the text", "en", None), (None, "a text without an id", None, "a")]
    frame = docs(spark, rows)
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF001)
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    marks = {crc([*whole.encode(r[1]).ids, 0]) for r in rows[3:]}
    assert {r.ids_crc32 for r in frame.collect()} == marks


def test_empty_documents(spark):
    frame = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF001)
    assert frame.count() == 0


def test_near_dedup_keeps_one_of_repeated_rows(spark):
    rows = [(1, "the words of the text", "en", "a")] * 3 + [(1, "other words are in here", "en", "a"), (2, "one more text with words", "en", "a"), (None, "no id", "en", "a")]
    got = corpus_pipeline.near_dedup(spark, docs(spark, rows), SF001).collect()
    assert sorted(r.text for r in got) == sorted({r[1] for r in rows})
