"""Token ids in ORC files: run-length coded stripes with Bloom filters on doc_id.

Documents are range-partitioned by doc_id, sorted, encoded in their task
and written as ORC: one file per range, so ascending doc_id runs through
the files in order. ids and doc_id are integer columns in ORC's run-length
encoding; every ``ROW_INDEX`` rows have an index entry with minima and
maxima, and doc_id has a Bloom filter, so a search for documents skips
files, stripes and row groups by metadata. Readers split files by stripe.

``read_tokens`` gives the rows of the files, ``documents_of`` those of some
documents with the predicate pushed into the reader, ``layout`` each
document's place in the stream of all ids, by a running total.

Defined cases: a null text is encoded as empty and has its end id alone;
repeated doc_ids keep a row each; a null doc_id sorts first; an empty table
gives a folder that reads as no rows. Extra columns are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlab.llm.common import checkpointed, running_total, scratch_folder, ship
from churnlab.llm.tokens import ENCODE_BYTES, column_chunks, encoder

SCHEMA = "doc_id long, ids array<int>"
STRIPE_BYTES, ROW_INDEX, BLOOM_RATE = 16 << 20, 1000, 0.01


def _encode(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path).encode
    for batch in batches:
        for first, texts in column_chunks(batch.column(1), ENCODE_BYTES):
            ids, offsets = encode(texts, end)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32)))
            yield pa.record_batch({"doc_id": batch.column(0).slice(first, len(texts)), "ids": lists})


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = 1) -> None:
    """Encode ``text`` of docs and write (doc_id, ids) in doc_id order."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    encoded = ordered.mapInArrow(partial(_encode, path=tokenizer, end=end), SCHEMA)
    (
        encoded.write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", ROW_INDEX)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", BLOOM_RATE)
        .orc(folder)
    )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(folder)


def documents_of(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """Rows of the named documents; the reader skips what cannot hold them."""
    return read_tokens(spark, folder).filter(F.col("doc_id").isin(doc_ids))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.record_batch({"doc_id": batch.column(0), "n_tokens": pa.array(np.diff(offsets), pa.int64()), "ids_crc32": pa.array(sums, pa.int64())})


def layout(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the rows read back."""
    ship(tokens.sparkSession)
    digests = tokens.mapInArrow(_digests, "doc_id long, n_tokens long, ids_crc32 long")
    total = running_total(checkpointed(digests), ["doc_id", "ids_crc32", "n_tokens"], "n_tokens", "upto")
    return total.select("doc_id", (F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """Write the files to a new folder and return the layout read from them."""
    folder = scratch_folder(docs.sparkSession, "orc")
    write_tokens(docs, folder, tokenizer, end)
    return layout(read_tokens(docs.sparkSession, folder))
