"""Conversation prefix tries, built as burst tries over shards.

A conversation is the sequence of its turns; every distinct sequence of
first turns is a node, and conversations that begin with it are its members.
Conversations with the same sequence are put together first, so a sequence
that a third of all conversations repeat is one row with a count. The rows
then lie in containers of suffixes under trie heads, the first being the
root. A container of more than ``LIMIT`` sequences bursts: its head becomes a
chain of nodes (one for each turn that all its suffixes share), and its rows
go on to containers by their next turn id, round by round, until none is too
large. The containers that remain are dealt over shards, sorted, and swept
into nodes, one bounded container at a time; heads get the sums of the
containers below them.

Turn ids are MD5 digests of role and text. The ids of conversations that end
at one node are sorted in ranges and joined to pieces of at most ``PIECE``
ids, whatever number of them ends there; only the digest of the pieces is
taken in order by one task, holding one piece. A conversation is one record,
as a document is: about 40 bytes a turn, whole texts are never gathered.
There are as many rounds as places on one path where more than ``LIMIT``
different conversations branch.

Defined cases: turns come by ``turn`` (null first), ties by their digest;
null role and text are empty; rows without a conv_id take no part; repeated
rows are turns each; a conversation without turns is a member of the root;
an empty table gives no nodes. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlab.llm.common import checkpointed, ship, token_count

#: Sequences that a container holds before it bursts.
LIMIT = 256
#: Ids of one piece of a list of conversations.
PIECE = 65_536
#: Heads that burst in one round and are sent to all tasks (about 60 bytes
#: each); beyond it the round joins by a shuffle.
BROADCAST_HEADS = 100_000
SHARED_EVERY = 20
NOTHING = hashlib.sha256(b"").hexdigest()
#: Nodes of one Arrow batch of a sweep.
BATCH = 20_000

_TURNS = "array<struct<id:binary,words:bigint>>"
_NODE = {
    "conv_id": pa.int64(),
    "depth": pa.int64(),
    "parent_conv_id": pa.int64(),
    "n_convs": pa.int64(),
    "n_children": pa.int64(),
    "n_leaves": pa.int64(),
    "saved_tokens": pa.int64(),
    "ends_sha256": pa.string(),
    "heads": pa.list_(pa.binary()),
}
_NODE_SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, heads array<binary>"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


# -- conversations ----------------------------------------------------------


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: the turn ids and words of every conversation, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the length tells where the role ends
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("id"), token_count(text).alias("words"))
    # nulls sort first, then by turn, then by digest
    listed = F.sort_array(F.collect_list(F.struct("turn", "id", "words")))
    ordered = rows.filter("conv_id is not null").groupBy("conv_id").agg(listed.alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["words"].alias("words"))).alias("turns"))


def rebuilt(conversations: DataFrame, every: int = SHARED_EVERY) -> DataFrame:
    """Conversations whose first h turns are those of conversation c - c % ``every``.

    h is the unsigned crc32 of the decimal conv_id modulo 4; c's own turns
    follow after its first h.
    """
    own = checkpointed(sequences(conversations))
    first = own.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    # a base is met by at most ``every`` conversations
    met = own.withColumn("h", h).join(first, F.col("conv_id") - F.col("conv_id") % every == F.col("base"), "left")
    start = F.slice(F.coalesce("first", F.array().cast(_TURNS)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return met.select("conv_id", F.concat(start, rest).alias("turns"))


# -- copies: one row per sequence, with the digest of its conversations -----


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one sequence's sorted ids as text pieces."""
    key, first, held = None, 0, []

    def flush(out: list) -> None:
        if held:
            out.append((key, first, len(held), ",".join(map(str, held))))
            held.clear()

    for batch in batches:
        out: list[tuple[bytes, int, int, str]] = []
        for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key or len(held) >= PIECE:
                flush(out)
                key, first = k, conv
            held.append(conv)
        yield _piece_batch(out)
    out = []
    flush(out)
    yield _piece_batch(out)


def _piece_batch(rows: list[tuple[bytes, int, int, str]]) -> pa.RecordBatch:
    kinds = {"skey": pa.binary(), "rep": pa.int64(), "n": pa.int64(), "piece": pa.string()}
    return pa.record_batch({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(kinds.items())})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each sequence's pieces, which come in order."""
    key, rep, n, sha = None, 0, 0, None
    for batch in batches:
        out: list[tuple[int, int, str]] = []
        for k, first, count, piece in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if k != key:
                if sha is not None:
                    out.append((rep, n, sha.hexdigest()))
                key, rep, n, sha = k, first, 0, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(piece.encode())
            n += count
        yield _digest_batch(out)
    yield _digest_batch([] if sha is None else [(rep, n, sha.hexdigest())])


def _digest_batch(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    kinds = {"rep": pa.int64(), "n": pa.int64(), "sha": pa.string()}
    return pa.record_batch({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(kinds.items())})


def distinct_sequences(conversations: DataFrame) -> DataFrame:
    """rep (smallest conv_id), n, sha (of all conv_ids) and turns of each distinct sequence.

    Takes (conv_id, turns); conv_ids are distinct.
    """
    ship(conversations.sparkSession)
    whole = F.unhex(F.md5(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "")))
    keyed = checkpointed(conversations.withColumn("skey", whole))
    ids = keyed.select("skey", "conv_id")
    pieces = ids.repartitionByRange("skey", "conv_id").sortWithinPartitions("skey", "conv_id").mapInArrow(_pieces, "skey binary, rep long, n long, piece string")
    ended = pieces.repartition("skey").sortWithinPartitions("skey", "rep").mapInArrow(_digests, "rep long, n long, sha string")
    return ended.join(keyed.select(F.col("conv_id").alias("rep"), "turns"), "rep")


# -- the trie ---------------------------------------------------------------


def sweep_container(rows: list[tuple], top: int, top_words: int, parent: int | None, heads: list[bytes]) -> list[list]:
    """The nodes of one container of sorted distinct suffixes, columns of ``_NODE``.

    ``rows``: (rep, n, sha, ids, words) in the order of ids; the container's
    own node stands at depth ``top`` with ``top_words`` words in its turn.
    """
    conv, count, up, depth, words, sha = [None], [0], [-1], [top], [top_words], [NOTHING]
    path, previous = [0], []
    for rep, n, digest, ids, own_words in rows:
        same = 0
        for a, b in zip(previous, ids, strict=False):
            if a != b:
                break
            same += 1
        del path[same + 1 :]
        for k in range(same, len(ids)):
            conv.append(None)
            count.append(0)
            up.append(path[-1])
            depth.append(top + k + 1)
            words.append(own_words[k])
            sha.append(NOTHING)
            path.append(len(conv) - 1)
        conv[path[-1]], count[path[-1]], sha[path[-1]] = rep, n, digest
        previous = ids
    children, leaves, saved = ([0] * len(conv) for _ in range(3))
    for i in range(len(conv) - 1, -1, -1):  # a node comes after its parent
        saved[i] += (count[i] - 1) * words[i]
        leaves[i] = leaves[i] or 1
        p = up[i]
        if p >= 0:
            count[p] += count[i]
            conv[p] = conv[i] if conv[p] is None else min(conv[p], conv[i])
            children[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]
    parents = [parent] + [conv[p] for p in up[1:]]
    # the container's own node carries the heads above it
    return [conv, depth, parents, count, children, leaves, saved, sha, [heads] + [None] * (len(conv) - 1)]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    about: tuple | None = None
    out: list[list] = [[] for _ in _NODE]

    def close() -> None:
        if about is not None:
            for column, values in zip(out, sweep_container(held, *about[1:]), strict=True):
                column.extend(values)

    def batch_of() -> pa.RecordBatch:
        made = pa.record_batch({c: pa.array(v, t) for (c, t), v in zip(_NODE.items(), out, strict=True)})
        for column in out:
            column.clear()
        return made

    for batch in batches:
        for hkey, top, top_words, parent, heads, rep, n, sha, ids, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if about is None or hkey != about[0]:
                close()
                held, about = [], (hkey, top, top_words, parent, heads)
                if len(out[0]) >= BATCH:
                    yield batch_of()
            held.append((rep, n, sha, ids, words))
    close()
    yield batch_of()


def prefix_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of the trie of (conv_id, turns); columns ``COLUMNS``."""
    spark = conversations.sparkSession
    ship(spark)
    active = distinct_sequences(conversations).select(
        "rep",
        "n",
        "sha",
        F.col("turns").alias("rest"),
        F.unhex(F.md5(F.lit(""))).alias("hkey"),
        F.lit(0).cast("long").alias("top"),
        F.lit(0).cast("long").alias("top_words"),
        F.lit(None).cast("long").alias("parent"),
        F.array().cast("array<binary>").alias("heads"),
    )
    settled, burst = [], []
    while True:
        active = checkpointed(active)
        sizes = active.groupBy("hkey", "top", "top_words", "parent", "heads").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n_convs"), F.min("rep").alias("conv_id"))
        big = checkpointed(sizes.filter(F.col("m") > limit))
        found = big.count()
        if not found:
            settled.append(active)
            break
        marks = big.select("hkey", F.col("conv_id").alias("head_conv"))
        marked = active.join(F.broadcast(marks) if found <= BROADCAST_HEADS else marks, "hkey", "left")
        settled.append(marked.filter("head_conv is null").drop("head_conv"))
        inside = marked.filter("head_conv is not null")
        # what the first and the last suffix share, all between them share
        edges = inside.groupBy("hkey").agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
        shared = checkpointed(edges.select("hkey", F.expr("slice(low, 1, " + _COMMON + ")").alias("run")))
        runs = F.broadcast(shared) if found <= BROADCAST_HEADS else shared
        inside = inside.join(runs.withColumn("s", F.size("run")).drop("run"), "hkey")
        # at most one sequence ends where a head branches
        ends = inside.filter(F.size("rest") == F.col("s")).select("hkey", "sha")
        burst.append(big.join(shared, "hkey").join(ends, "hkey", "left"))
        going = inside.filter(F.size("rest") > F.col("s"))
        turn = F.element_at("rest", F.col("s") + 1)
        active = going.select(
            "rep",
            "n",
            "sha",
            F.expr("slice(rest, s + 2, greatest(size(rest) - s - 1, 0))").alias("rest"),
            F.unhex(F.md5(F.concat("hkey", turn["id"]))).alias("hkey"),
            (F.col("top") + F.col("s") + 1).alias("top"),
            turn["words"].alias("top_words"),
            F.col("head_conv").alias("parent"),
            F.concat("heads", F.array("hkey")).alias("heads"),
        )
    rows = settled[0]
    for more in settled[1:]:
        rows = rows.unionByName(more)
    rows = rows.select("hkey", "top", "top_words", "parent", "heads", "rep", "n", "sha", F.col("rest.id").alias("ids"), F.col("rest.words").alias("words"))
    swept = rows.repartition("hkey").sortWithinPartitions("hkey", "ids").mapInArrow(_sweep, _NODE_SCHEMA)
    if not burst:
        return swept.select(*COLUMNS)
    swept = checkpointed(swept)
    heads = burst[0]
    for more in burst[1:]:
        heads = heads.unionByName(more)
    return swept.select(*COLUMNS).unionByName(_head_nodes(checkpointed(heads), swept))


#: The number of turns that ``low`` and ``high`` begin with alike.
_COMMON = "ifnull(nullif(array_position(zip_with(low, high, (a, b) -> ifnull(a = b, false)), false), 0) - 1, least(size(low), size(high)))"


def _head_nodes(heads: DataFrame, swept: DataFrame) -> DataFrame:
    """The nodes of burst containers, with the sums of what lies below them.

    A head stands for a chain of nodes with the same members: the container's
    own, and one for each turn of the run that all its suffixes share.
    """
    words = F.concat(F.array("top_words"), F.col("run.words"))
    own = (F.col("n_convs") - 1) * F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + w)
    below = swept.filter("heads is not null").select("heads", "n_leaves", "saved_tokens")
    below = below.unionByName(heads.select("heads", F.lit(0).cast("long").alias("n_leaves"), own.alias("saved_tokens")))
    # a container adds to every head above it, and is a child of the last one
    spread = below.select(F.size("heads").alias("k"), "n_leaves", "saved_tokens", F.posexplode("heads").alias("at", "hkey"))
    sums = spread.groupBy("hkey").agg(
        F.sum(F.when(F.col("at") == F.col("k") - 1, 1).otherwise(0)).alias("kids"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below")
    )
    chain = heads.join(sums, "hkey").select("*", F.size("run").alias("s"), F.posexplode(words).alias("i", "w"))
    down = F.sum("w").over(Window.partitionBy("hkey").orderBy(F.desc("i")))
    last = F.col("i") == F.col("s")
    return chain.withColumn("down", down).select(
        "conv_id",
        (F.col("top") + F.col("i")).alias("depth"),
        F.when(F.col("i") == 0, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("below") + (F.col("n_convs") - 1) * F.col("down")).alias("saved_tokens"),
        F.when(last, F.coalesce("sha", F.lit(NOTHING))).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
    )
