"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

A line's key is the line without blanks at both ends and with A-Z
lower-cased. ``LineIndex`` keeps in a folder, by versions that are written
whole and never changed:

- ``refs``: the exact references (key, doc_id) of every batch of documents,
- ``gone``: the doc_ids of every deletion,
- ``filters``: one cuckoo filter per shard of keys, holding the keys that
  at least two documents refer to,
- ``log``: a row per version, written last. ``LineIndex.open`` takes up an
  index at its last logged version, on any driver; what a lost driver left
  of a version without its row is not read and is written over.

``add`` and ``remove`` count the references of the touched keys before and
after, insert keys that come to have two documents and delete keys that
fall back to one, so removing documents restores the lines they had
claimed. ``dedupe`` sends the lines' keys, never the text, to their shards
and probes the filter; only keys that it may hold reach the exact counts,
which decide. A shard whose lines exceed its share is split over several
tasks by document, so one line in a third of all documents is no single
task. A filter has no false negatives and the counts are exact, so the
result is exact.

Defined cases: null and empty texts are one empty line; rows with one
doc_id are one document whose rows are cut each for itself; rows with a
null doc_id claim nothing and keep their lines; an empty table gives no
rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlab.llm.common import BLANKS, ascii_lower, checkpointed, partitions, scratch_folder, ship
from churnlab.llm.cuckoo import FilterStack
from churnlab.streaming.stream import path_exists

MIN_CHARS = 10
#: Lines a task probes at once, at most.
GROUP_LINES = 500_000
KEY = ["h1", "h2"]


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_keys(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, row (hash of the text), pos, h1, h2, shard of the lines that count."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
    keyed = rows.withColumn("key", ascii_lower(F.btrim("line", F.lit(BLANKS)))).filter(F.length("key") >= MIN_CHARS)
    keyed = keyed.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    return keyed.filter("doc_id is not null").withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))


def _changed(_, old: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    """The shard's filter after the changes of its keys."""
    shard = int((old if len(old) else changes)["shard"].iloc[0])
    on, off = changes[changes["change"] > 0], changes[changes["change"] < 0]
    keys = int(old["n_keys"].iloc[0]) if len(old) else 0
    cuckoo = FilterStack.load(old["filter"].iloc[0]) if len(old) else FilterStack()
    if len(off):
        cuckoo.delete(off["h1"].to_numpy(), off["h2"].to_numpy())
    if len(on):
        cuckoo.insert(on["h1"].to_numpy(), on["h2"].to_numpy())
    return pd.DataFrame({"shard": [shard], "n_keys": [keys + len(on) - len(off)], "filter": [cuckoo.dump()]})


def _probe(_, lines: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if not len(lines) or not len(filters):
        return lines.iloc[:0][["doc_id", "row", "pos", "h1", "h2"]]
    cuckoo = FilterStack.load(filters["filter"].iloc[0])
    maybe = cuckoo.contains(lines["h1"].to_numpy(), lines["h2"].to_numpy())
    return lines.loc[maybe, ["doc_id", "row", "pos", "h1", "h2"]]


def _drop_lines(texts: pd.Series, dropped: pd.Series) -> pd.Series:
    out = []
    for text, gone in zip(texts, dropped, strict=True):
        if gone is None or text is None:
            out.append(None)
            continue
        away = set(np.asarray(gone).tolist())
        out.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in away))
    return pd.Series(out, dtype=object)


class LineIndex:
    """References and filters below ``folder``; see the module's text."""

    def __init__(self, spark: SparkSession, folder: str, shards: int | None = None):
        ship(spark)
        self.spark, self.folder, self.version = spark, folder, 0
        self.shards, self.batches, self.removals = shards, [], []

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineIndex:
        """The index in ``folder`` as its last whole version left it; a new one if there is none."""
        index = cls(spark, folder)
        if path_exists(spark, f"{folder}/log"):
            # one row a version
            for row in spark.read.schema("kind string, shards int, version int").parquet(f"{folder}/log").orderBy("version").collect():
                index.version, index.shards = row["version"], row["shards"]
                (index.batches if row["kind"] == "add" else index.removals).append(row["version"])
        return index

    def _log(self, kind: str) -> None:
        row = self.spark.range(1, numPartitions=1).select(F.lit(kind).alias("kind"), F.lit(self.shards).cast("int").alias("shards"))
        row.write.mode("overwrite").parquet(self._path("log", self.version))

    def _path(self, kind: str, version: int) -> str:
        return f"{self.folder}/{kind}/version={version}"

    def references(self, upto: int | None = None) -> DataFrame | None:
        """The live references (h1, h2, shard, doc_id) after a version."""
        upto = self.version if upto is None else upto
        out = None
        for batch in (b for b in self.batches if b <= upto):
            refs = self.spark.read.parquet(self._path("refs", batch))
            later = [r for r in self.removals if batch < r <= upto]
            if later:
                gone = self.spark.read.parquet(*(self._path("gone", r) for r in later))
                refs = refs.join(gone, "doc_id", "left_anti")
            out = refs if out is None else out.unionByName(refs)
        return out

    def counts(self, upto: int | None = None, touched: DataFrame | None = None) -> DataFrame | None:
        """h1, h2, shard, n_docs, first_doc of keys, exact."""
        refs = self.references(upto)
        if refs is None:
            return None
        if touched is not None:
            refs = refs.join(touched, KEY, "left_semi")
        if len(self.batches) > 1:
            refs = refs.distinct()
        # one batch holds each reference once, and partial sums meet a hot key
        return refs.groupBy(*KEY, "shard").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))

    def repeated(self) -> DataFrame:
        return self.counts().filter("n_docs > 1").drop("n_docs")

    def add(self, docs: DataFrame, lines: DataFrame | None = None) -> None:
        """Insert a batch of documents."""
        if self.shards is None:
            self.shards = partitions(self.spark)
        lines = line_keys(docs, self.shards) if lines is None else lines
        before, self.version = self.version, self.version + 1
        refs = lines.select("doc_id", *KEY, "shard").distinct()
        refs.write.mode("overwrite").parquet(self._path("refs", self.version))
        first = not self.batches
        self.batches.append(self.version)
        touched = None if first else self.spark.read.parquet(self._path("refs", self.version)).select(*KEY).distinct()
        self._update(before, touched)
        self._log("add")

    def remove(self, doc_ids: DataFrame) -> None:
        """Delete documents, by a table with their doc_id."""
        if not self.batches:
            return  # nothing to delete
        before, self.version = self.version, self.version + 1
        doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().write.mode("overwrite").parquet(self._path("gone", self.version))
        self.removals.append(self.version)
        gone = self.spark.read.parquet(self._path("gone", self.version))
        touched = self.references(before).join(gone, "doc_id", "left_semi").select(*KEY).distinct()
        self._update(before, touched)
        self._log("remove")

    def _update(self, before: int, touched: DataFrame | None) -> None:
        now = self.counts(touched=touched).select(*KEY, "shard", (F.col("n_docs") > 1).cast("int").alias("now"))
        old_counts = self.counts(before, touched) if before else None
        if old_counts is None:
            changes = now.filter("now = 1").withColumn("change", F.lit(1)).drop("now")
        else:
            was = old_counts.select(*KEY, "shard", (F.col("n_docs") > 1).cast("int").alias("was"))
            both = was.join(now, [*KEY, "shard"], "full").na.fill(0, ["was", "now"])
            changes = both.select(*KEY, "shard", (F.col("now") - F.col("was")).alias("change")).filter("change <> 0")
        old = self.filters(before)
        columns = "shard int, n_keys long, filter binary"
        if old is None:
            old = self.spark.createDataFrame([], columns)
        new = old.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(_changed, columns)
        new.write.mode("overwrite").parquet(self._path("filters", self.version))

    def filters(self, version: int | None = None) -> DataFrame | None:
        version = self.version if version is None else version
        return self.spark.read.parquet(self._path("filters", version)) if version else None

    def dropped(self, docs: DataFrame, lines: DataFrame | None = None) -> DataFrame:
        """doc_id, row, dropped: the positions of each row's lines to drop."""
        lines = line_keys(docs, self.shards) if lines is None else lines
        repeated, filters = self.repeated(), self.filters()
        sizes = checkpointed(lines.groupBy("shard").agg(F.count(F.lit(1)).alias("n")))
        share = min(GROUP_LINES, max(1000, int((sizes.agg(F.avg("n")).first()[0] or 0) * 1.5)))
        # one row per shard
        parts = F.broadcast(sizes.select("shard", F.ceil(F.col("n") / share).cast("int").alias("parts")))
        dealt = lines.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("doc_id", "row"), F.col("parts")).cast("int"))
        spread = filters.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        spread = spread.drop("parts").toDF("shard", "n_keys", "filter", "part")
        dealt = dealt.select("doc_id", "row", "pos", *KEY, "shard", "part").toDF("doc_id", "row", "pos", *KEY, "shard", "part")
        where = ["shard", "part"]
        maybe = dealt.groupBy(*where).cogroup(spread.groupBy(*where)).applyInPandas(_probe, "doc_id long, row long, pos int, h1 long, h2 long")
        sure = maybe.join(repeated.drop("shard"), KEY).filter("doc_id <> first_doc")
        return sure.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("dropped"))

    def dedupe(self, docs: DataFrame, lines: DataFrame | None = None) -> DataFrame:
        """The rows of docs with their repeated lines dropped from ``text``.

        Adds n_lines (before) and n_dropped, in place of columns of these
        names. Text without dropped lines is unchanged, but for null, which
        becomes empty.
        """
        # the columns of docs go under names of their own, so that none clashes
        names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
        doc_id, text = (F.col(names[c]) for c in ("doc_id", "text"))
        gone = self.dropped(docs, lines).toDF("doc", "row", "gone")
        joined = docs.toDF(*names.values()).join(gone, (doc_id.cast("long") == F.col("doc")) & (F.xxhash64(text) == F.col("row")), "left")
        cut = F.pandas_udf(_drop_lines, "string")
        # rows that keep all lines send no text to Python
        joined = joined.withColumn("kept", cut(F.when(F.col("gone").isNotNull(), text), F.col("gone")))
        own = {"n_lines": F.size(text_lines(text)).cast("long"), "n_dropped": F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")}
        return joined.select(
            *(F.col(n).alias(c) for c, n in names.items() if c != "text" and c not in own),
            *(v.alias(c) for c, v in own.items()),
            F.coalesce("kept", text, F.lit("")).alias("text"),
        )


def dedupe_lines(docs: DataFrame) -> DataFrame:
    """One batch into a new index, and the same documents without repeats."""
    spark = docs.sparkSession
    shards = partitions(spark)
    lines = checkpointed(line_keys(docs, shards))
    index = LineIndex(spark, scratch_folder(spark, "lines"), shards)
    index.add(docs, lines)
    return index.dedupe(docs, lines)
