"""MinHash near-dedup by fast similarity sketching.

A sketch has ``bins`` coordinates. Round ``i`` hashes every shingle to one
bin and a value in [0, 1) and offers ``i + value`` to that bin, which keeps
its minimum; after ``bins`` such rounds, round ``bins + j`` offers every
shingle to bin ``j``, so every coordinate is filled. A text stops at the
first round that leaves no bin empty, which for most texts is the first or
second. Equal coordinates have the Jaccard similarity as probability, with
the concentration of independent samples.

Texts with equal shingle sets are one class. Sketches are cut into bands;
classes that share a band are candidates. In every bucket each class is
first held against one hub, the member that shares buckets with most
others, so a bucket of thousands costs thousands of comparisons; a hub is
passed over only if the sketches agree in fewer than ``MAYBE`` coordinates,
over six standard deviations below the threshold. Links are confirmed on
full sets. Then the members of all buckets of one hub are a cell, and where
a cell still has several components, its members outside the largest one
are held against all its members, on full sets, in blocks. So every pair
that shares a band is either linked, connected otherwise, or refuted
exactly, and no pairs are ever stored.

Defined cases: null, empty or wordless texts have an empty set and link
with nothing; fewer than five words are one shingle; rows with one doc_id
count as one document; a null doc_id links with nothing and is kept; an
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlab.llm.common import checkpointed, give_back, partitions, ship
from churnlab.llm.components import components, forest
from churnlab.llm.shingles import mix64, shingle_sets

WORDS = 5
#: Banding: at similarity 0.75 a pair misses all bands with probability 5e-6.
BINS, ROWS = 128, 4
#: Coordinates of BINS that must agree before the exact check.
MAYBE = 64
#: Bytes of text handled at once inside a task.
CHUNK = 1 << 20
#: Ids broadcast at most; beyond, the ids are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Members and shingles of a block of a cell.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 200_000
#: Pairs of sets up to which a hash is counted pair by pair, and at once.
RARE, PAIRS = 1024, 1_000_000


def sketches(hashes: np.ndarray, offsets: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Sketch of each set as 32-bit fingerprints of ``round + value``; (n, bins).

    Empty sets have a row of zeros.
    """
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    best = np.full(n * bins, np.iinfo(np.uint64).max, np.uint64)
    live, owner, elems = sizes > 0, np.repeat(np.arange(n), sizes), hashes
    for i in range(2 * bins):
        if not len(elems):
            break
        with np.errstate(over="ignore"):
            x = mix64(elems + np.uint64(i + 1) * np.uint64(0x9E3779B97F4A7C15))
        column = (x >> np.uint64(32)) % np.uint64(bins) if i < bins else np.uint64(i - bins)
        # the round in the top bits orders values of earlier rounds first
        value = (np.uint64(i) << np.uint64(48)) | (mix64(x) >> np.uint64(16))
        np.minimum.at(best, owner * bins + column.astype(np.int64), value)
        full = (best.reshape(n, bins) != np.iinfo(np.uint64).max).all(axis=1)
        go = live & ~full
        keep = go[owner]
        if not keep.all():
            owner, elems = owner[keep], elems[keep]
    marks = (mix64(best) >> np.uint64(32)).astype(np.uint32).reshape(n, bins)
    marks[~live] = 0
    return marks.view(np.int32)


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes, or of one longer text."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t)
    if len(texts) > first:
        yield first, len(texts)


def _lists(values: np.ndarray, offsets: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def _byte_chunks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) in pieces; 256 rows at a time leave Arrow, null is empty."""
    give_back()
    for at in range(0, len(column), 256):
        texts = [t or b"" for t in column.slice(at, 256).cast(pa.large_binary()).to_pylist()]
        for a, b in chunks(texts):
            yield at + a, texts[a:b]


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, texts in _byte_chunks(batch.column(1)):
            b = a + len(texts)
            s, off = shingle_sets(texts, WORDS)
            marks = sketches(s, off)
            with np.errstate(over="ignore"):
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(s ^ np.uint64(0x5851F42D4C957F2D)))))
                more = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(s + np.uint64(0x14057B7EF767814F)))))
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0).slice(a, b - a),
                    "n_shingles": pa.array(np.diff(off), pa.int64()),
                    "s1": pa.array((sums[off[1:]] - sums[off[:-1]]).view(np.int64)),
                    "s2": pa.array((more[off[1:]] - more[off[:-1]]).view(np.int64)),
                    "sketch": _lists(marks.reshape(-1), np.arange(b - a + 1) * BINS, pa.int32()),
                }
            )


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, texts in _byte_chunks(batch.column(1)):
            b = a + len(texts)
            s, off = shingle_sets(texts, WORDS)
            yield pa.record_batch({"id": batch.column(0).slice(a, b - a), "elems": _lists(s.view(np.int64), off, pa.int64())})


def _agree(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs whose sketches agree in at least MAYBE coordinates."""
    left = marks.select(F.col("id").alias("a"), F.col("sketch").alias("ma"))
    right = marks.select(F.col("id").alias("b"), F.col("sketch").alias("mb"))
    same = F.size(F.filter(F.zip_with("ma", "mb", lambda x, y: x == y), lambda x: x))
    return pairs.join(left, "a").join(right, "b").filter(same >= MAYBE).select("a", "b")


def _sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, elems): the shingle hashes of the named documents."""
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id", "left_semi")
    return checkpointed(texts.mapInArrow(_set_batches, "id long, elems array<long>"))


def _confirm(pairs: DataFrame, docs: DataFrame, similarity: int) -> DataFrame:
    """Pairs with 100 * intersection >= similarity * union, on full sets."""
    pairs = checkpointed(pairs)
    ids = checkpointed(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct())
    sets = _sets(ids, docs)
    left = sets.select(F.col("id").alias("a"), F.col("elems").alias("ea"))
    right = sets.select(F.col("id").alias("b"), F.col("elems").alias("eb"))
    both = F.size(F.array_intersect("ea", "eb"))
    sizes = F.size("ea") + F.size("eb")
    return pairs.join(left, "a").join(right, "b").filter(100 * both >= similarity * (sizes - both)).select("a", "b")


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of a with each set of b.

    A hash that few sets hold is counted pair by pair, one that many hold
    by products of 0/1 columns, a thousand columns at a time.
    """
    sides = []
    for sets in (a, b):
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        sides.append((np.concatenate(sets) if len(sets) else np.zeros(0, np.int64), owner))
    common = np.intersect1d(sides[0][0], sides[1][0])
    columns = []
    for values, owner in sides:
        at = np.searchsorted(common, values)
        at[at == len(common)] = 0
        held = common[at] == values if len(common) else np.zeros(len(values), bool)
        at, owner = at[held], owner[held]
        order = np.argsort(at, kind="stable")
        columns.append((owner[order], np.bincount(at, minlength=len(common))))
    (own_a, n_a), (own_b, n_b) = columns
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    total = np.zeros(len(a) * len(b), np.float32)
    rare = np.flatnonzero(n_a * n_b <= RARE)
    step = np.cumsum(n_a[rare] * n_b[rare])
    for part in np.split(rare, np.searchsorted(step, np.arange(PAIRS, step[-1] if len(step) else 0, PAIRS))):
        pairs = n_a[part] * n_b[part]
        r = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        wide = np.repeat(n_b[part], pairs)
        x = own_a[np.repeat(first_a[part], pairs) + r // wide]
        y = own_b[np.repeat(first_b[part], pairs) + r % wide]
        total += np.bincount(x * len(b) + y, minlength=len(total)).astype(np.float32)
    total = total.reshape(len(a), len(b))
    frequent = np.flatnonzero(n_a * n_b > RARE)
    for i in range(0, len(frequent), 1024):
        part = frequent[i : i + 1024]
        ones = []
        for own, n, first, rows in ((own_a, n_a, first_a, len(a)), (own_b, n_b, first_b, len(b))):
            r = np.arange(n[part].sum()) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            table = np.zeros((rows, len(part)), np.float32)
            table[own[np.repeat(first[part], n[part]) + r], np.repeat(np.arange(len(part)), n[part])] = 1
            ones.append(table)
        total += ones[0] @ ones[1].T
    return total


def _link_cells(_, small: pd.DataFrame, large: pd.DataFrame, similarity: int) -> pd.DataFrame:
    """Spanning links between components, cell by cell."""
    places = large.groupby("hub").indices
    out = [pd.DataFrame({"a": [], "b": []}, dtype="int64")]
    for hub, few in small.groupby("hub"):
        if hub not in places:
            continue
        all_ = large.iloc[places[hub]]
        both = intersections(list(few["elems"]), list(all_["elems"]))
        sizes = few["elems"].map(len).to_numpy()[:, None] + all_["elems"].map(len).to_numpy()[None, :]
        apart = few["component"].to_numpy()[:, None] != all_["component"].to_numpy()[None, :]
        p, q = np.nonzero((100 * both >= similarity * (sizes - both)) & apart)
        if len(p):
            node, low = forest(few["id"].to_numpy()[p], all_["id"].to_numpy()[q])
            out.append(pd.DataFrame({"a": node, "b": low}))
    return pd.concat(out)


def _cell_links(inside: DataFrame, docs: DataFrame, similarity: int) -> DataFrame:
    """Links between the components that meet in a cell.

    ``inside``: hub, id, component, n_shingles. In every cell the members
    outside its largest component are held against all members, on full
    sets, in blocks of bounded rows and shingles; cells are dealt to tasks
    of about the same number of rows. A task returns a spanning forest of
    the links it finds, never the pairs.
    """
    parts = inside.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("n"))
    top = parts.groupBy("hub").agg(F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    mixed = inside.join(top.select("hub", F.col("top.component").alias("top")), "hub").withColumn("few", F.col("component") != F.col("top"))
    blocks = F.ceil(F.greatest(F.count("n") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    mixed = mixed.withColumn("n", F.col("n_shingles"))
    sides = mixed.groupBy("hub").agg(blocks.alias("j"), F.ceil(F.greatest(F.count(F.when(F.col("few"), 1)) / BLOCK_ROWS, F.sum(F.when(F.col("few"), F.col("n"))) / BLOCK_SHINGLES)).cast("int").alias("i"))
    mixed = checkpointed(mixed.join(sides, "hub").select("hub", "id", "component", "few", "i", "j"))
    tasks = max(1, -(-mixed.count() // BLOCK_ROWS), partitions(docs.sparkSession))
    sets = _sets(checkpointed(mixed.select("id").distinct()), docs)
    filled = mixed.join(sets, "id").withColumn("task", F.pmod(F.xxhash64("hub"), F.lit(tasks)).cast("int"))
    own = F.xxhash64("id", F.lit(1))
    few = filled.filter("few").withColumn("x", F.pmod(own, F.col("i")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("j") - 1)))
    all_ = filled.withColumn("y", F.pmod(own, F.col("j")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("i") - 1)))
    columns = ["task", "x", "y", "hub", "id", "component", "elems"]
    few, all_ = (side.select(*columns).toDF(*columns).groupBy("task", "x", "y") for side in (few, all_))
    return few.cogroup(all_).applyInPandas(partial(_link_cells, similarity=similarity), "a long, b long")


def near_groups(docs: DataFrame, similarity: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = checkpointed(rows.mapInArrow(_sketch_batches, "doc_id long, n_shingles long, s1 long, s2 long, sketch array<int>"))
    class_of = ["s1", "s2", "n_shingles"]
    full = marked.filter("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy(*class_of).agg(F.min("doc_id").alias("rep"))
    reps = checkpointed(full.join(classes, class_of).filter("doc_id = rep").select(F.col("rep").alias("id"), "n_shingles", "sketch").dropDuplicates(["id"]))

    bands = F.transform(F.sequence(F.lit(0), F.lit(BINS // ROWS - 1)), lambda i: F.xxhash64(F.slice("sketch", i * ROWS + 1, F.lit(ROWS)), i))
    members = reps.select("id", F.explode(bands).alias("bucket"))
    crowded = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = checkpointed(members.join(crowded, "bucket"))
    mass = members.groupBy("id").agg(F.sum("n").alias("mass"))
    members = checkpointed(members.join(mass, "id").select("id", "bucket", "mass"))

    # the hub of a bucket against every other member
    hubs = members.groupBy("bucket").agg(F.max(F.struct("mass", (-F.col("id")).alias("back"))).alias("hub"))
    stars = members.join(hubs, "bucket").select((-F.col("hub.back")).alias("a"), F.col("id").alias("b")).filter("a <> b").distinct()
    links = checkpointed(_confirm(_agree(stars, reps), rows, similarity))

    # the rest: a cell has the members of all buckets of one hub
    found = components(links)
    homes = hubs.select("bucket", (-F.col("hub.back")).alias("hub"))
    inside = checkpointed(members.join(homes, "bucket").select("hub", "id").distinct())
    sizes = reps.select("id", "n_shingles")
    inside = inside.join(found, "id", "left").join(sizes, "id").select("hub", "id", F.coalesce("component", "id").alias("component"), "n_shingles")
    links = links.unionAll(checkpointed(_cell_links(checkpointed(inside), rows, similarity)))
    found = components(links)

    grouped = classes.join(found, classes["rep"] == found["id"], "left").select(*class_of, F.coalesce("component", "rep").alias("component_id"))
    # one row per document: its class carries the component
    named = marked.drop("sketch").join(grouped, class_of, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = named.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), component))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
