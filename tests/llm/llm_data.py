"""Small tables for the operators' tests."""

from __future__ import annotations

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names the operators use themselves; as extra columns they must not clash.
CLASHES = "size shard k d cell piece slot skey rid target taken finish row pos key ids length start bucket component hub id label n h1 h2 shard_ v dims n_lines n_dropped doc gone kept predicted c0 c1 _doc _row _gone score".split()


def docs(spark, rows):
    """Documents from (doc_id, text, lang, source), with clashing extra columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS).select("*", *(F.lit(7).alias(c) for c in CLASHES))


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=lambda r: [(x is not None, x) for x in r])
