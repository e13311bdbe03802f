"""Registered queries of this package: one per operator, and the pipeline.

Each applies its operator, with production parameters, to its whole table
and derives the digest columns from what the operator returns.
"""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlab.llm import bursttrie, covertree, fastsketch, histsort, htmltext, isoforest, linededup, orcout, qdwh, rabitq, vecfit, wfq, wordlid
from churnlab.llm.oracle import SQL as SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest by inner product of every row whose id is divisible by 20."""
    return rabitq.nearest(_table(spark, sf_dir, "embeddings"))


def op2_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 shards of near-equal bytes."""
    return histsort.histogram_sort(_table(spark, sf_dir, "documents"))


def op3_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes of each document."""
    return wfq.mix(_table(spark, sf_dir, "documents"))


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of vectors linked by a cosine of 0.9 or more."""
    return covertree.near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_cuckoo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without lines that an earlier one holds, as a digest."""
    kept = linededup.dedupe_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return vecfit.packed_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_fast_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by a shingle similarity of 0.75 or more."""
    return fastsketch.near_groups(_table(spark, sf_dir, "documents"))


def op8_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to ORC files and read back."""
    return orcout.token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return wordlid.languages(_table(spark, sf_dir, "documents"))


def op10_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmltext.extract(_table(spark, sf_dir, "pages"))


def op11_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics of every document, and whether it is kept."""
    return isoforest.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every vector on the first 8 components."""
    return qdwh.whitened(_table(spark, sf_dir, "embeddings"))


def op13_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return bursttrie.prefix_trie(bursttrie.rebuilt(_table(spark, sf_dir, "conversations")))


OPERATORS = (
    op1_rabitq,
    op2_histogram_sort,
    op3_fair_queueing,
    op4_cover_tree,
    op5_cuckoo_lines,
    op6_vector_best_fit,
    op7_fast_sketch,
    op8_orc_tokens,
    op9_word_backoff,
    op10_block_rules,
    op11_isolation_forest,
    op12_qdwh_whitening,
    op13_burst_trie,
)
QUERIES = {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}
