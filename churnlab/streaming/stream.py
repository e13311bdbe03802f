"""Structured Streaming for the event log (STR1-STR5).

STR1  ``read_event_stream`` + ``with_event_time``: file-source ingest, raw
      logs mapped onto the canonical columns; optionally a watermark, and
      replays inside it are dropped.
STR2  ``page_hour_counts``: tumbling-window counts per page.
STR3  ``user_day_totals``: per (user, day window) activity totals, and
      ``user_session_totals``: per (user, session) flag totals of events
      that carry a session; ``SessionPieces`` finds the sessions of events
      that carry none, in any order of time.
STR4  ``MatrixUpkeep``: keeps the user matrix current. Adjacency, gaps and
      session means need a user's ordered history; it is kept as one
      mergeable row per user (sums, sessions counted, active days as bit
      blocks), so a micro-batch in any order of time is merged into the rows
      of the users it touches and no older events or days are read.
STR5  ``score_matrix_updates``: scores matrix rows as they change, run on a
      schedule with ``trigger(availableNow=True)``.

A watermark drops events that come later than it allows. Files of a landed
log come in no order of event time, so without an explicit watermark at
least as long as that disorder the operators keep their state (one row per
result row) and are complete for any order. The upkeep needs no watermark:
it keeps the keys of the events it has counted, by day, and counts none twice.

Every sink writes one partition per micro-batch (``epoch=<id>``) with
dynamic partition overwrite, so a micro-batch replayed after a failure
replaces its own output instead of duplicating it. Readers take the
latest value per key across epochs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlab.functions import event_date
from churnlab.operators.events import drop_blank_users, with_flags
from churnlab.operators.matrix import NO_SESSION, gender_pairs, max_gender, session_parts
from churnlab.schema import (
    DEFAULT_ROLES,
    EVENT_SCHEMA,
    FLAG_COLUMNS,
    MEAN_MEASURES,
    RAW_EVENT_SCHEMA,
    SESSION_MEASURES,
    TOTAL_MEASURES,
    USER_MATRIX_COLUMNS,
    PageRoles,
)
from churnlab.session import ensure_checkpoint_dir
from churnlab.sources.events import SESSION_GAP_US, to_events

EVENT_TIME = "event_time"
DEDUPE_KEYS = ("userId", "sessionId", "ts", "seq", "page")


# ------------------------------------------------------------------ STR1
def read_event_stream(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """STR1: a streaming frame of canonical events over files (fixed schema).

    ``parquet`` files hold canonical events; ``json`` files the raw log,
    whose ``itemInSession`` becomes ``seq``.
    """
    reader = spark.readStream.schema(RAW_EVENT_SCHEMA if fmt == "json" else EVENT_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.load(path)
    return to_events(stream) if fmt == "json" else stream


def with_event_time(stream: DataFrame, watermark: str | None = None, dedupe: bool = False) -> DataFrame:
    """STR1: event time from ``ts``; a watermark and replay removal within it.

    Events later than the watermark are dropped, so it must cover the
    disorder of the files; without one nothing is dropped.
    """
    s = stream.withColumn(EVENT_TIME, F.timestamp_millis("ts"))
    if watermark:
        s = s.withWatermark(EVENT_TIME, watermark)
    if dedupe:
        keys = [c for c in DEDUPE_KEYS if c in s.columns]
        s = s.dropDuplicatesWithinWatermark(keys) if watermark else s.dropDuplicates(keys)
    return s


# ------------------------------------------------------------------ STR2 / STR3
def page_hour_counts(stream: DataFrame, window: str = "1 hour") -> DataFrame:
    """STR2: events per page per tumbling window; ``window_start`` in epoch ms."""
    agg = stream.groupBy(F.window(EVENT_TIME, window).alias("w"), "page").agg(F.count(F.lit(1)).alias("n_events"))
    return agg.select(F.unix_millis(F.col("w.start")).alias("window_start"), "page", "n_events")


def user_day_totals(stream: DataFrame, roles: PageRoles = DEFAULT_ROLES) -> DataFrame:
    """STR3: per user and UTC day window: events, listens, listened flag.

    Keyed by an event-time window so a watermark, if there is one, can
    drop closed days from the state store.
    """
    listen = F.coalesce(F.col("page") == F.lit(roles.listen), F.lit(False)).cast("int")
    agg = drop_blank_users(stream).groupBy("userId", F.window(EVENT_TIME, "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(listen).cast("long").alias("n_listens")
    )
    return agg.select(
        "userId",
        F.date_from_unix_date(F.floor(F.unix_millis(F.col("w.start")) / F.lit(86_400_000)).cast("int")).alias("date"),
        "n_events",
        "n_listens",
        (F.col("n_listens") > 0).cast("int").alias("listen_flag"),
    )


def user_session_totals(stream: DataFrame, roles: PageRoles = DEFAULT_ROLES) -> DataFrame:
    """STR3: per user and session: the six flag totals (AGG7 on a stream)."""
    ev = with_flags(drop_blank_users(stream), roles)
    return ev.groupBy("userId", "sessionId").agg(
        *[F.sum(c).cast("long").alias(m) for c, m in zip(FLAG_COLUMNS, SESSION_MEASURES)]
    )


def session_pieces(events: DataFrame, gap_us: int = SESSION_GAP_US, roles: PageRoles = DEFAULT_ROLES) -> DataFrame:
    """STR3: ``(userId, bucket, first_us, last_us, totals)`` of events with ``event_time``.

    A bucket is as long as the gap, so a session never breaks inside one:
    pieces of the same bucket merge by minimum, maximum and sum in any order,
    and a hash aggregate makes them, partial per task, whatever a user's
    share of the events. Events without a time are in no session.
    """
    us = F.unix_micros(EVENT_TIME)
    ev = with_flags(drop_blank_users(events).where(F.col(EVENT_TIME).isNotNull()), roles)
    ev = ev.withColumns({"first_us": us, "last_us": us, "bucket": F.floor(us / F.lit(gap_us))})
    return _merged_pieces(ev.withColumnsRenamed(dict(zip(FLAG_COLUMNS, SESSION_MEASURES))))


def _merged_pieces(pieces: DataFrame) -> DataFrame:
    sums = [F.sum(m).cast("long").alias(m) for m in SESSION_MEASURES]
    return pieces.groupBy("userId", "bucket").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), *sums)


def sessions_of(pieces: DataFrame, gap_us: int = SESSION_GAP_US) -> DataFrame:
    """``(userId, sessionId, first_us, last_us, totals)``: the sessions that pieces make, numbered from 1 by time.

    A session ends where the user's next event is more than the gap later.
    The window runs over a user's buckets, bounded by the calendar.
    """
    ordered = Window.partitionBy("userId").orderBy("bucket")
    begins = F.coalesce(F.col("first_us") - F.lag("last_us").over(ordered) > F.lit(gap_us), F.lit(True))
    rows = _merged_pieces(pieces).withColumn("_begins", begins.cast("long"))
    rows = rows.withColumn("sessionId", F.sum("_begins").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sums = [F.sum(m).cast("long").alias(m) for m in SESSION_MEASURES]
    return rows.groupBy("userId", "sessionId").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), *sums)


class SessionPieces:
    """foreachBatch sink: each micro-batch's session pieces under ``base``.

    A batch reads nothing that was stored before, so its cost does not grow
    with history, late events extend or join sessions however late they come,
    and a replayed micro-batch replaces its own pieces. ``merge`` folds the
    epochs so far into one row per user and bucket.
    """

    def __init__(self, base: str, gap_us: int = SESSION_GAP_US, roles: PageRoles = DEFAULT_ROLES):
        self.base, self.gap_us, self.roles = base.rstrip("/"), gap_us, roles

    def __call__(self, batch: DataFrame, epoch_id: int) -> None:
        done = snapshot_generation(batch.sparkSession, self.base)
        if done is None or done < epoch_id:
            write_epoch(session_pieces(batch, self.gap_us, self.roles), f"{self.base}/pieces", epoch_id)

    def sessions(self, spark: SparkSession) -> DataFrame:
        return sessions_of(read_stored(spark, self.base, "pieces"), self.gap_us)

    def merge(self, spark: SparkSession) -> None:
        """Fold all epochs into a snapshot; readers take it once its marker is there. Not beside a running stream."""
        last = spark.read.parquet(f"{self.base}/pieces").agg(F.max("epoch")).first()[0]
        if last is None or last == snapshot_generation(spark, self.base):
            return
        _merged_pieces(read_stored(spark, self.base, "pieces")).write.mode("overwrite").parquet(f"{self.base}/snapshots/pieces/gen={last}")
        spark.range(1).write.mode("overwrite").parquet(f"{self.base}/snapshots/_done/gen={last}")


# ------------------------------------------------------------------ epoch-partitioned sinks
def write_epoch(df: DataFrame, path: str, epoch_id: int, partition_by: Sequence[str] = ()) -> None:
    """Write one micro-batch's rows as partition ``epoch=<id>``, idempotently.

    Dynamic partition overwrite replaces only the partitions this batch
    writes, so a replayed micro-batch overwrites its own earlier output.
    """
    (
        df.withColumn("epoch", F.lit(int(epoch_id)).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by, "epoch")
        .parquet(path)
    )


def latest_by_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Latest row per key across epochs (the value of the highest epoch)."""
    values = [c for c in df.columns if c not in (*keys, "epoch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("_v")).select(*keys, "_v.*")


def upsert_sink(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function writing update-mode output per epoch."""

    def sink(batch: DataFrame, epoch_id: int) -> None:
        write_epoch(batch, path, epoch_id)

    return sink


def run_available(stream_out: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Process everything available now, then stop (scheduled-run trigger)."""
    q = (
        stream_out.writeStream.outputMode(mode)
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if q.exception() is not None:  # pragma: no cover - surfaced to caller
        raise RuntimeError(str(q.exception()))


# ------------------------------------------------------------------ STR4
def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs_path(spark, path)
    return bool(fs.exists(p))


def snapshot_generation(spark: SparkSession, base: str) -> int | None:
    """Epoch through which the latest *completed* snapshot reaches (None if none).

    A snapshot counts only once its marker folder holds the ``_SUCCESS``
    file Spark writes when the marker job commits; the marker is written
    after the snapshot data, so a crash anywhere before leaves it unused.
    """
    root, fs = _fs_path(spark, f"{base.rstrip('/')}/snapshots/_done")
    if not fs.exists(root):
        return None
    gens = []
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if name.startswith("gen=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            gens.append(int(name.split("=", 1)[1]))
    return max(gens) if gens else None


def read_stored(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A stored table of the upkeep: latest snapshot plus the epochs after it.

    Snapshot rows get ``epoch`` = their generation, so ``latest_by_key``
    still prefers newer epochs.
    """
    base = base.rstrip("/")
    parts = spark.read.parquet(f"{base}/{name}")
    gen = snapshot_generation(spark, base)
    if gen is None:
        return parts
    snap = spark.read.parquet(f"{base}/snapshots/{name}/gen={gen}").withColumn("epoch", F.lit(gen).cast("long"))
    return parts.where(F.col("epoch") > gen).unionByName(snap)


def compact(spark: SparkSession, base: str, purge: bool = False) -> int | None:
    """Merge the upkeep's per-epoch files into one snapshot; returns its epoch.

    Run between scheduled upkeep runs. Steps: merge every stored table
    through the latest epoch E into ``snapshots/<table>/gen=E`` (overwrite,
    so a crashed attempt is simply redone), then write the marker
    ``snapshots/_done/gen=E``. Readers switch to the snapshot only when
    the marker exists. ``purge`` then deletes the epoch folders of the
    stored tables before E and older snapshots. The matrix rows per
    epoch stay, since scheduled scoring (STR5) streams from them;
    ``purge_scored`` deletes those that it has scored.
    """
    base = base.rstrip("/")
    if not path_exists(spark, f"{base}/seen"):
        return None
    last = spark.read.parquet(f"{base}/seen").agg(F.max("epoch").alias("e")).first().e  # complete epochs only
    if last is None or last == snapshot_generation(spark, base):
        return snapshot_generation(spark, base)
    # Rows keep the bucket the upkeep gave them (a function of userId), so
    # the upkeep's bucket pruning finds them in the snapshot too.
    for name in STORES:
        rows = read_stored(spark, base, name).where(F.col("epoch") <= last)
        merged = latest_by_key(rows, ["ubucket", "userId"]) if name == "users" else rows.drop("epoch")
        by_bucket(merged, STORES[name]).write.mode("overwrite").partitionBy("ubucket").parquet(f"{base}/snapshots/{name}/gen={last}")
    matrix = latest_by_key(read_stored(spark, base, "matrix").where(F.col("epoch") <= last), ["userId"])
    matrix.write.mode("overwrite").parquet(f"{base}/snapshots/matrix/gen={last}")
    spark.range(1).select(F.lit(last).cast("long").alias("epoch_through")).write.mode("overwrite").parquet(
        f"{base}/snapshots/_done/gen={last}"
    )
    if purge:
        _purge(spark, base, last)
    return last


def _purge(spark: SparkSession, base: str, gen: int) -> None:
    """Delete stored epochs before ``gen`` and snapshots older than ``gen``.

    The matrix epochs are left for the scoring stream. The files of epoch ``gen`` itself stay: readers already skip them, and
    they keep every table readable (parquet needs a file to infer from).
    """
    for name in (*STORES, "matrix"):
        root, fs = _fs_path(spark, f"{base}/{name}")
        for top in fs.listStatus(root) if name != "matrix" and fs.exists(root) else []:
            targets = [top] if top.getPath().getName().startswith("epoch=") else list(fs.listStatus(top.getPath()))
            for st in targets:
                label = st.getPath().getName()
                if label.startswith("epoch=") and int(label.split("=", 1)[1]) < gen:
                    fs.delete(st.getPath(), True)
        snaps, fs = _fs_path(spark, f"{base}/snapshots/{name}")
        if fs.exists(snaps):
            for st in fs.listStatus(snaps):
                label = st.getPath().getName()
                if label.startswith("gen=") and int(label.split("=", 1)[1]) < gen:
                    fs.delete(st.getPath(), True)


#: The upkeep's stored tables, and what their files are sorted by.
STORES = {"users": ["userId"], "sessions": ["userId", "sid"], "seen": ["date", "_k1"]}
#: Days of one block: the bits of a long.
BLOCK_DAYS = 64


def by_bucket(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """One sorted run per bucket, so a write makes at most one file of each."""
    return df.repartition("ubucket").sortWithinPartitions("ubucket", *order)


def day_blocks(events: DataFrame) -> DataFrame:
    """(userId, block, bits): active days as bits of blocks of 64 days.

    Blocks merge by ``bit_or`` in any order and any number of times. Events
    without a time give the block null.
    """
    day = F.unix_date(event_date("ts"))
    bit = F.expr("shiftleft(1L, cast(pmod(_day_no, 64) as int))")
    rows = events.select("userId", day.alias("_day_no")).withColumn("block", F.floor(F.col("_day_no") / BLOCK_DAYS).cast("int"))
    return rows.withColumn("bits", F.coalesce(bit, F.lit(0).cast("long"))).groupBy("userId", "block").agg(F.bit_or("bits").alias("bits"))


def block_maxima(blocks: DataFrame) -> DataFrame:
    """The day features of the matrix from a user's merged blocks.

    Per block: first and last day, the largest gap and the adjacent pairs
    inside; across blocks the last day before and the first day after.
    """
    inside = blocks.withColumn("d", F.expr("filter(sequence(0, 63), i -> shiftrightunsigned(bits, i) & 1 = 1)"))
    inside = inside.select(
        "userId",
        "block",
        (F.col("block") * BLOCK_DAYS + F.expr("get(d, 0)")).alias("first"),
        (F.col("block") * BLOCK_DAYS + F.expr("get(d, size(d) - 1)")).alias("last"),
        F.expr("array_max(zip_with(slice(d, 2, 64), slice(d, 1, greatest(size(d) - 1, 0)), (b, a) -> b - a))").alias("gap"),
        F.expr("bit_count(bits & shiftrightunsigned(bits, 1))").alias("pairs"),
    )
    step = F.col("first") - F.lag("last").over(Window.partitionBy("userId").orderBy("block"))
    return inside.withColumn("step", step).groupBy("userId").agg(
        F.coalesce(F.greatest(F.max("gap"), F.max("step")), F.lit(0)).cast("int").alias("most_days_since_last_listen"),
        (F.sum("pairs") + F.coalesce(F.sum((F.col("step") == 1).cast("int")), F.lit(0))).cast("long").alias("most_days_consec_listen"),
    )


class MatrixUpkeep:
    """foreachBatch function that keeps the user matrix current.

    Layout under ``base``, every table partitioned by a hash bucket of userId
    and by epoch, one sorted file per bucket and epoch at most:

    ``users``     one row per user touched in the epoch, merged over all time:
                  the sums, listens, churn, gender, the number of sessions and
                  the active days as blocks of 64 bits
    ``sessions``  the keys of sessions that the epoch saw first
    ``seen``      the keys (two 64-bit hashes) of the events it counted, by
                  date; written last, it marks the epoch complete
    ``matrix``    the matrix rows of the touched users (by epoch only)

    An event counts once, however often it is delivered: a micro-batch is held
    against the seen keys of its own buckets and range of dates. Then it reads
    the latest row of each touched user, merges its own sums and days into it
    and derives the matrix row. What is read of a user is one row for each
    epoch since the last compaction that touched the user, however long the
    history: days merge as bits, and sessions only have to be known or new.
    ``compact_every`` epochs the stored tables are merged into a snapshot.
    """

    def __init__(self, base: str, roles: PageRoles = DEFAULT_ROLES, buckets: int = 16, compact_every: int | None = 16):
        self.base = base.rstrip("/")
        self.roles = roles
        self.buckets = buckets
        self.compact_every = compact_every

    def part(self, name: str) -> str:
        return f"{self.base}/{name}"

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64("userId"), F.lit(self.buckets)).cast("int")

    def stored(self, spark: SparkSession, name: str, epoch_id: int, hot: list[int]) -> DataFrame | None:
        """What earlier epochs stored in the touched buckets."""
        if not path_exists(spark, self.part(name)):
            return None
        return read_stored(spark, self.base, name).where((F.col("epoch") < epoch_id) & F.col("ubucket").isin(hot))

    def write(self, df: DataFrame, name: str, epoch_id: int) -> None:
        write_epoch(by_bucket(df, STORES[name]), self.part(name), epoch_id, ["ubucket"])

    def fresh(self, once: DataFrame, epoch_id: int, hot: list[int]) -> DataFrame:
        """The batch's events that no earlier epoch has counted."""
        seen = self.stored(once.sparkSession, "seen", epoch_id, hot)
        if seen is None:
            return once
        span = once.agg(F.min("_day").alias("a"), F.max("_day").alias("b"), F.max(F.col("_day").isNull()).alias("n")).first()
        # literals reach the scan, which skips row groups of other dates
        near = F.lit(False) if span.a is None else F.col("date").between(span.a, span.b)
        seen = seen.where(near | F.col("date").isNull() if span.n else near)
        return once.join(seen.select("_k1", "_k2"), ["_k1", "_k2"], "left_anti")

    def merged(self, ev: DataFrame, epoch_id: int, hot: list[int]) -> DataFrame:
        """The touched users' rows with this batch merged in; stores new sessions."""
        spark = ev.sparkSession
        parts = session_parts(ev, self.roles).withColumn("sid", F.coalesce("sessionId", F.lit(NO_SESSION)))
        new = parts.select("userId", "sid")
        known = self.stored(spark, "sessions", epoch_id, hot)
        if known is not None:
            new = new.join(known.select("userId", "sid"), ["userId", "sid"], "left_anti")
        self.write(new.withColumn("ubucket", self.bucket()), "sessions", epoch_id)
        new = spark.read.parquet(self.part("sessions")).where((F.col("epoch") == epoch_id) & F.col("ubucket").isin(hot))
        sums = [*SESSION_MEASURES, "_listens"]
        delta = (
            parts.groupBy("userId").agg(*[F.sum(c).cast("long").alias(c) for c in sums], F.max("_churn").alias("_churn"))
            .join(max_gender(gender_pairs(ev)), "userId")
            .join(new.groupBy("userId").agg(F.count(F.lit(1)).alias("n_sessions")), "userId", "left")
        )
        blocks = day_blocks(ev)
        users = self.stored(spark, "users", epoch_id, hot)
        if users is not None:
            touched = delta.select("userId")
            old = latest_by_key(users.drop("ubucket").join(touched, "userId", "left_semi"), ["userId"])
            delta = delta.unionByName(old.drop("days"))
            blocks = blocks.unionByName(old.select("userId", F.inline("days")))
            blocks = blocks.groupBy("userId", "block").agg(F.bit_or("bits").alias("bits"))
        totals = delta.groupBy("userId").agg(
            *[F.sum(c).cast("long").alias(c) for c in sums],
            F.max("_churn").alias("_churn"),
            F.max("gender").alias("gender"),
            F.sum(F.coalesce("n_sessions", F.lit(0))).cast("long").alias("n_sessions"),
        )
        return totals.join(blocks.groupBy("userId").agg(F.sort_array(F.collect_list(F.struct("block", "bits"))).alias("days")), "userId")

    def __call__(self, batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        done = snapshot_generation(spark, self.base)
        if done is not None and done >= epoch_id:
            return  # a replay of an epoch that a snapshot holds whole
        keys = [F.xxhash64(*DEDUPE_KEYS).alias("_k1"), F.xxhash64(F.lit(1), *DEDUPE_KEYS).alias("_k2")]
        once = drop_blank_users(batch).dropDuplicates(list(DEDUPE_KEYS)).select("*", event_date("ts").alias("_day"), self.bucket().alias("ubucket"), *keys).persist()
        hot = [r.ubucket for r in once.select("ubucket").distinct().collect()]  # <= self.buckets values
        ev = self.fresh(once, epoch_id, hot).persist()
        state = None
        try:
            if not ev.limit(1).count():
                return  # nothing but replays
            state = self.merged(ev, epoch_id, hot).persist()
            self.write(state.withColumn("ubucket", self.bucket()), "users", epoch_id)
            days = block_maxima(state.select("userId", F.inline("days")))
            rows = state.join(days, "userId").select(
                "*",
                F.col("_churn").alias("churn"),
                F.col("_listens").cast("int").alias("most_listens_one_month"),
                *[F.col(m).alias(t) for m, t in zip(SESSION_MEASURES, TOTAL_MEASURES)],
                *[(F.col(m) / F.col("n_sessions")).alias(a) for m, a in zip(SESSION_MEASURES, MEAN_MEASURES)],
            )
            write_epoch(rows.select(*USER_MATRIX_COLUMNS), self.part("matrix"), epoch_id)
            # last: a crash before leaves the epoch uncounted, and its replay redoes it
            self.write(ev.select("ubucket", F.col("_day").alias("date"), "_k1", "_k2"), "seen", epoch_id)
        finally:
            for df in (once, ev, state):
                if df is not None:
                    df.unpersist()
        if self.compact_every and (epoch_id + 1) % self.compact_every == 0:
            compact(spark, self.base, purge=True)


def current_matrix(spark: SparkSession, base: str) -> DataFrame:
    """The user matrix kept by ``MatrixUpkeep``: latest row per user."""
    return latest_by_key(read_stored(spark, base, "matrix"), ["userId"]).select(*USER_MATRIX_COLUMNS)


def keep_matrix_current(stream: DataFrame, base: str, checkpoint: str, roles: PageRoles = DEFAULT_ROLES) -> None:
    """STR4: run the upkeep over everything available now."""
    run_available(stream, MatrixUpkeep(base, roles), checkpoint, mode="append")


# ------------------------------------------------------------------ STR5
def score_matrix_updates(spark: SparkSession, model, matrix_base: str, out: str, checkpoint: str) -> None:
    """STR5: score matrix rows written since the last run, then stop.

    ``model`` is a fitted PipelineModel / classifier that reads the matrix
    columns (for example preparation + classifier). Scores land per epoch
    under ``out``; ``latest_by_key(..., ['userId'])`` gives current scores.
    """
    src = f"{matrix_base.rstrip('/')}/matrix"
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).parquet(src).select("*", F.col("_metadata.file_path").alias("_file"))

    def sink(batch: DataFrame, epoch_id: int) -> None:
        # what purge_scored may delete once this micro-batch is committed
        write_epoch(batch.select("_file").distinct(), scored_files(out), epoch_id)
        latest = latest_by_key(batch.drop("_file"), ["userId"])
        scored = model.transform(latest).select("userId", F.col("prediction").alias("predicted_churn"))
        write_epoch(scored, out, epoch_id)

    run_available(stream, sink, checkpoint, mode="append")


def scored_files(out: str) -> str:
    return f"{out.rstrip('/')}_files"


def purge_scored(spark: SparkSession, matrix_base: str, out: str, checkpoint: str) -> list[int]:
    """STR5: delete the matrix epochs that are in a snapshot and wholly scored; returns them.

    An epoch goes when a completed snapshot holds its rows and micro-batches
    that the scoring ``checkpoint`` has committed read every one of its
    files; one that was read by an uncommitted micro-batch stays for its
    replay. Run between scheduled runs, after ``compact``. A scoring job with
    a checkpoint of its own starts from ``current_matrix``.
    """
    base = matrix_base.rstrip("/")
    gen = snapshot_generation(spark, base)
    commits, fs = _fs_path(spark, f"{checkpoint.rstrip('/')}/commits")
    if gen is None or not fs.exists(commits) or not path_exists(spark, scored_files(out)):
        return []
    committed = max((int(s.getPath().getName()) for s in fs.listStatus(commits) if s.getPath().getName().isdigit()), default=-1)
    files = spark.read.parquet(scored_files(out)).where(F.col("epoch") <= committed)
    of = F.regexp_extract("_file", r"epoch=(\d+)/[^/]+$", 1).cast("long")
    # one row an epoch
    read = {r.of: r.n for r in files.groupBy(of.alias("of")).agg(F.count_distinct("_file").alias("n")).collect()}
    root, fs = _fs_path(spark, f"{base}/matrix")
    gone = []
    for folder in fs.listStatus(root):
        label = folder.getPath().getName()
        epoch = int(label.split("=", 1)[1]) if label.startswith("epoch=") else gen
        # the files of epoch gen itself keep the table readable
        if epoch < gen and epoch in read:
            held = sum(f.getPath().getName().endswith(".parquet") for f in fs.listStatus(folder.getPath()))
            if held == read[epoch] and fs.delete(folder.getPath(), True):
                gone.append(epoch)
    return sorted(gone)


# ------------------------------------------------------------------ helpers for registered queries
def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's checkpoint folder (shared on clusters)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/churnlab-{name}-{uuid.uuid4().hex[:12]}"


def land_events(events: DataFrame, path: str) -> str:
    """Write canonical events as parquet files a stream can read."""
    cols = [
        F.col(f.name) if f.name in events.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in EVENT_SCHEMA.fields
    ]
    events.select(*cols).write.mode("errorifexists").parquet(path)
    return path


def kept_result(df: DataFrame, base: str) -> DataFrame:
    """Store a query's result with the session's checkpoints and delete its scratch folder."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    path, fs = _fs_path(df.sparkSession, base)
    fs.delete(path, True)
    return out


def streamed_page_hour_counts(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """STR1 + STR2 end to end over a stream of events: the final counts."""
    base = scratch(spark, "str2")
    run_available(page_hour_counts(with_event_time(stream)), upsert_sink(f"{base}/out"), f"{base}/checkpoint")
    return kept_result(latest_by_key(spark.read.parquet(f"{base}/out"), ["window_start", "page"]), base)


def streamed_user_day_totals(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """STR1 + STR3 end to end: the totals per user and day."""
    base = scratch(spark, "str3")
    run_available(user_day_totals(with_event_time(stream)), upsert_sink(f"{base}/out"), f"{base}/checkpoint")
    return kept_result(latest_by_key(spark.read.parquet(f"{base}/out"), ["userId", "date"]), base)


def landed(spark: SparkSession, events: DataFrame, base: str, files: int, per_trigger: int) -> DataFrame:
    """Events written by the tasks that made them, read as a stream of several batches.

    What fewer than ``files`` tasks wrote is small and is dealt again to
    that many. ``per_trigger`` of ``files`` files, and the same share of
    more, are a batch.
    """
    path = land_events(events, f"{base}/landing")
    found = len(spark.read.schema(EVENT_SCHEMA).parquet(path).inputFiles())
    if found < files:
        path = land_events(spark.read.schema(EVENT_SCHEMA).parquet(path).repartition(files), f"{base}/dealt")
        found = files
    batches = max(2, files // per_trigger)
    return read_event_stream(spark, path, max_files_per_trigger=max(1, found // batches))


def streamed_user_session_totals(spark: SparkSession, stream: DataFrame, gap_us: int = SESSION_GAP_US) -> DataFrame:
    """STR1 + STR3 end to end over a stream of events with ``event_time``: the totals per user and session."""
    base = scratch(spark, "str3s")
    pieces = SessionPieces(f"{base}/out", gap_us)
    run_available(stream, pieces, f"{base}/checkpoint", mode="append")
    return kept_result(pieces.sessions(spark).select("userId", "sessionId", *SESSION_MEASURES), base)


def streamed_user_matrix(spark: SparkSession, events: DataFrame, files: int = 4, per_trigger: int = 2) -> DataFrame:
    """STR1 + STR4 end to end, over several micro-batches."""
    base = scratch(spark, "str4")
    keep_matrix_current(landed(spark, events, base, files, per_trigger), f"{base}/state", f"{base}/checkpoint")
    return kept_result(current_matrix(spark, f"{base}/state"), base)


def streamed_scores(spark: SparkSession, events: DataFrame, model, files: int = 4, per_trigger: int = 2) -> DataFrame:
    """STR4 + STR5 end to end: keep the matrix current, then score the changed rows."""
    base = scratch(spark, "str5")
    keep_matrix_current(landed(spark, events, base, files, per_trigger), f"{base}/state", f"{base}/checkpoint-upkeep")
    score_matrix_updates(spark, model, f"{base}/state", f"{base}/scores", f"{base}/checkpoint-scores")
    return kept_result(latest_by_key(spark.read.parquet(f"{base}/scores"), ["userId"]), base)
