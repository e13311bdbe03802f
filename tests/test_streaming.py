"""Streaming: stream = batch, late data, idempotent epochs, scheduled scoring."""

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer

from churnlab.operators import matrix as M
from churnlab.plans import model as ML
from churnlab.plans.catalog import events as adapted_events
from churnlab.sources.events import SESSION_GAP_US, stream_events
from churnlab.streaming import stream as STR
from conftest import SF001
from fixtures import frame


def test_streamed_matrix_equals_batch(spark):
    ev = adapted_events(spark, SF001)
    streamed = STR.streamed_user_matrix(spark, ev, per_trigger=1)
    batch = M.user_matrix(ev)
    assert sorted(streamed.collect()) == sorted(batch.collect())


def test_late_events_beyond_watermark_are_dropped(spark, tmp_path):
    base = str(tmp_path)
    on_time = frame(spark, [("a", 1, "2018-10-10 10:00", "NextSong", "M", "X, CA")] * 3)
    late = frame(spark, [("a", 1, "2018-10-01 10:00", "NextSong", "M", "X, CA")])
    STR.land_events(on_time, f"{base}/in/part1")
    counts = STR.page_hour_counts(STR.with_event_time(STR.read_event_stream(spark, f"{base}/in/*", max_files_per_trigger=1), watermark="2 hours"))
    STR.run_available(counts, STR.upsert_sink(f"{base}/out"), f"{base}/ckpt")
    STR.land_events(late, f"{base}/in/part2")
    STR.run_available(counts, STR.upsert_sink(f"{base}/out"), f"{base}/ckpt")
    got = STR.latest_by_key(spark.read.parquet(f"{base}/out"), ["window_start", "page"]).collect()
    assert [(r.page, r.n_events) for r in got] == [("NextSong", 3)]


def test_epoch_rewrite_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    STR.write_epoch(df, path, 0)
    STR.write_epoch(df, path, 0)  # replay of the same micro-batch
    STR.write_epoch(spark.createDataFrame([("a", 2)], "k string, v int"), path, 1)
    assert spark.read.parquet(path).count() == 2
    assert STR.latest_by_key(spark.read.parquet(path), ["k"]).first().v == 2


def test_scheduled_scoring_matches_batch_scoring(spark, tmp_path):
    ev = adapted_events(spark, SF001)
    base = str(tmp_path)
    STR.land_events(ev, f"{base}/landing")
    STR.keep_matrix_current(STR.read_event_stream(spark, f"{base}/landing"), f"{base}/state", f"{base}/ckpt1")
    matrix = M.user_matrix(ev)
    model = Pipeline(stages=[ML.preparation(), LogisticRegression(maxIter=10, featuresCol="features",
                                                                  labelCol="churn")]).fit(matrix)
    STR.score_matrix_updates(spark, model, f"{base}/state", f"{base}/scores", f"{base}/ckpt2")
    streamed = {r.userId: r.predicted_churn for r in STR.latest_by_key(spark.read.parquet(f"{base}/scores"), ["userId"]).collect()}
    batch = {r.userId: r.prediction for r in model.transform(matrix).collect()}
    assert streamed == batch


def test_replayed_events_counted_once(spark, tmp_path):
    base = str(tmp_path)
    ev = frame(spark, [("a", 1, "2018-10-10 10:00", "NextSong", "M", "X, CA"),
                       ("a", 1, "2018-10-10 10:05", "NextSong", "M", "X, CA")])
    STR.land_events(ev, f"{base}/in/part1")
    STR.land_events(ev, f"{base}/in/part2")  # the same events delivered twice
    counts = STR.page_hour_counts(STR.with_event_time(STR.read_event_stream(spark, f"{base}/in/*", max_files_per_trigger=1), watermark="2 hours", dedupe=True))
    STR.run_available(counts, STR.upsert_sink(f"{base}/out"), f"{base}/ckpt")
    got = STR.latest_by_key(spark.read.parquet(f"{base}/out"), ["window_start", "page"]).collect()
    assert [(r.page, r.n_events) for r in got] == [("NextSong", 2)]


def test_raw_json_keeps_different_events_of_one_instant(spark, tmp_path):
    import json

    rows = [{"userId": "a", "sessionId": 1, "ts": 1538388000000, "page": p} for p in ("NextSong", "Home", "Thumbs Up")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "log.json").write_text("\n".join(json.dumps(r) for r in rows + rows))
    stream = STR.with_event_time(STR.read_event_stream(spark, str(tmp_path / "in"), fmt="json"), dedupe=True)
    STR.run_available(STR.page_hour_counts(stream), STR.upsert_sink(str(tmp_path / "out")), str(tmp_path / "ckpt"))
    got = STR.latest_by_key(spark.read.parquet(str(tmp_path / "out")), ["window_start", "page"]).collect()
    assert sorted((r.page, r.n_events) for r in got) == [("Home", 1), ("NextSong", 1), ("Thumbs Up", 1)]


def test_counts_are_complete_over_files_in_any_order(spark, tmp_path):
    ev = adapted_events(spark, SF001, attrs=False)
    STR.land_events(ev.repartition(6), str(tmp_path / "in"))
    stream = lambda: STR.read_event_stream(spark, str(tmp_path / "in"), max_files_per_trigger=1)
    hours = STR.streamed_page_hour_counts(spark, stream()).collect()
    assert sum(r.n_events for r in hours) == ev.count()
    days = STR.streamed_user_day_totals(spark, stream()).collect()
    assert sum(r.n_events for r in days) == ev.count() and len(days) == len({(r.userId, r.date) for r in days})


def test_replays_do_not_change_the_matrix(spark, tmp_path):
    base, ev = str(tmp_path), adapted_events(spark, SF001)
    STR.land_events(ev, f"{base}/in/part1")
    STR.land_events(ev.limit(100), f"{base}/in/part2")
    stream = lambda: STR.read_event_stream(spark, f"{base}/in/*", max_files_per_trigger=1)
    STR.keep_matrix_current(stream(), f"{base}/state", f"{base}/ckpt")
    STR.land_events(ev, f"{base}/in/part3")  # the whole log again, in a later run
    STR.keep_matrix_current(stream(), f"{base}/state", f"{base}/ckpt")
    assert sorted(STR.current_matrix(spark, f"{base}/state").collect()) == sorted(M.user_matrix(ev).collect())


def test_purge_leaves_every_user_to_scoring(spark, tmp_path):
    base, (ev, first, second) = str(tmp_path), _halves(spark)
    stream = lambda: STR.read_event_stream(spark, f"{base}/in/*", max_files_per_trigger=2)
    for part, rows in (("part1", first), ("part2", second)):
        STR.land_events(rows, f"{base}/in/{part}")
        STR.keep_matrix_current(stream(), f"{base}/state", f"{base}/ckpt")
    STR.compact(spark, f"{base}/state", purge=True)
    rule = SQLTransformer(statement="SELECT *, CAST(total_listens < 10 AS DOUBLE) AS prediction FROM __THIS__")
    STR.score_matrix_updates(spark, rule, f"{base}/state", f"{base}/scores", f"{base}/ckpt2")
    got = {r.userId: r.predicted_churn for r in STR.latest_by_key(spark.read.parquet(f"{base}/scores"), ["userId"]).collect()}
    assert got == {r.userId: float(r.total_listens < 10) for r in M.user_matrix(ev).collect()}


def test_scratch_folders_are_deleted(spark):
    import os

    from churnlab.session import ensure_checkpoint_dir

    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = {d for d in os.listdir(root) if d.startswith("churnlab-")}
    STR.streamed_user_session_totals(spark, stream_events(spark, SF001)).count()
    assert {d for d in os.listdir(root) if d.startswith("churnlab-")} == before


def _halves(spark):
    from pyspark.sql import functions as F

    ev = adapted_events(spark, SF001)
    cut = 1707955200000  # 2024-02-15 00:00 UTC in the stretched time of the adapter
    return ev, ev.where(F.col("ts") < cut), ev.where(F.col("ts") >= cut)


def test_compaction_between_runs_keeps_the_matrix_exact(spark, tmp_path):
    base = str(tmp_path)
    ev, first, second = _halves(spark)
    STR.land_events(first, f"{base}/landing/part1")
    stream = lambda: STR.read_event_stream(spark, f"{base}/landing/*", max_files_per_trigger=2)
    STR.keep_matrix_current(stream(), f"{base}/state", f"{base}/ckpt")
    gen = STR.compact(spark, f"{base}/state", purge=True)
    assert gen is not None and STR.snapshot_generation(spark, f"{base}/state") == gen
    STR.land_events(second, f"{base}/landing/part2")
    STR.keep_matrix_current(stream(), f"{base}/state", f"{base}/ckpt")
    got = sorted(STR.current_matrix(spark, f"{base}/state").collect())
    assert got == sorted(M.user_matrix(ev).collect())


def test_snapshot_without_marker_is_ignored(spark, tmp_path):
    base = str(tmp_path)
    ev, first, second = _halves(spark)
    STR.land_events(first, f"{base}/landing/part1")
    stream = lambda: STR.read_event_stream(spark, f"{base}/landing/*", max_files_per_trigger=2)
    STR.keep_matrix_current(stream(), f"{base}/state", f"{base}/ckpt")
    gen = STR.compact(spark, f"{base}/state")
    # simulate a crash after the snapshot data but before the marker
    p, fs = STR._fs_path(spark, f"{base}/state/snapshots/_done/gen={gen}")
    fs.delete(p, True)
    assert STR.snapshot_generation(spark, f"{base}/state") is None
    STR.land_events(second, f"{base}/landing/part2")
    STR.keep_matrix_current(stream(), f"{base}/state", f"{base}/ckpt")
    assert sorted(STR.current_matrix(spark, f"{base}/state").collect()) == sorted(M.user_matrix(ev).collect())


def test_landing_has_as_many_files_as_its_input_has_parts(spark, tmp_path):
    rows = [(f"u{i}", 1, "2018-10-10 10:00", "NextSong", "M", "X, CA") for i in range(240)]
    for parts, files in ((12, 12), (1, 4)):
        stream = STR.landed(spark, frame(spark, rows).repartition(parts), str(tmp_path / f"in{parts}"), 4, 2)
        query = stream.writeStream.format("memory").queryName(f"landed{parts}").trigger(availableNow=True).start()
        query.awaitTermination()
        found = [p for p in (tmp_path / f"in{parts}").glob("*/part-*.parquet") if files == 12 or p.parent.name == "dealt"]
        assert len(found) == files and spark.table(f"landed{parts}").count() == 240
        assert sum(p["numInputRows"] > 0 for p in query.recentProgress) >= 2


def _deal(spark, base, ev, n):
    """The log in n files, each a random share of the events in no order of time."""
    from pyspark.sql import functions as F

    cols = ev.withColumn("share", F.pmod(F.xxhash64("seq", "userId"), F.lit(n)))
    for i in range(n):
        STR.land_events(cols.where(F.col("share") == (i * 5) % n).drop("share").coalesce(1), f"{base}/in/part{i}")


def test_nine_batches_in_any_order_equal_the_batch_matrix(spark, tmp_path):
    base, ev = str(tmp_path), adapted_events(spark, SF001).cache()
    _deal(spark, base, ev, 9)
    stream = STR.read_event_stream(spark, f"{base}/in/*", max_files_per_trigger=1)
    STR.run_available(stream, STR.MatrixUpkeep(f"{base}/state", buckets=4, compact_every=4), f"{base}/ckpt", mode="append")
    assert sorted(STR.current_matrix(spark, f"{base}/state").collect()) == sorted(M.user_matrix(ev).collect())
    assert STR.snapshot_generation(spark, f"{base}/state") == 7
    # a user is one row in the snapshot and one for each epoch after it
    users = STR.read_stored(spark, f"{base}/state", "users").groupBy("userId").count()
    assert users.agg({"count": "max"}).first()[0] <= 2
    # one file of each table per bucket and epoch at most, and only epochs since the compaction
    for name in STR.STORES:
        files = list((tmp_path / "state" / name).glob("ubucket=*/epoch=*/part-*.parquet"))
        assert files and len(files) == len({f.parent for f in files}) <= 4 * 2


def test_replayed_epochs_change_nothing(spark, tmp_path):
    base, (ev, first, second) = str(tmp_path), _halves(spark)
    upkeep = STR.MatrixUpkeep(f"{base}/state", buckets=4)
    upkeep(first, 0)
    upkeep(second, 1)
    upkeep(second, 1)  # after a crash before the commit
    want = sorted(M.user_matrix(ev).collect())
    assert sorted(STR.current_matrix(spark, f"{base}/state").collect()) == want
    STR.compact(spark, f"{base}/state", purge=True)
    upkeep(second, 1)  # the snapshot already holds it
    upkeep(first, 2)  # all of it again, as a new epoch
    assert sorted(STR.current_matrix(spark, f"{base}/state").collect()) == want


def test_day_blocks_equal_day_windows(spark):
    import random

    from churnlab.operators.days import day_user_maxima, user_days

    rng = random.Random(8)
    day = 86_400_000
    rows = [(f"u{u}", day * (rng.randrange(-200, 400) if u % 3 else 60 + rng.randrange(12)), "NextSong") for u in range(30) for _ in range(rng.randrange(1, 25))]
    rows += [("late", None, "NextSong"), ("late", 5 * day, "Home"), ("none", None, "Home"), ("edge", 63 * day, "Home"), ("edge", 64 * day, "Home"), ("edge", -day, "Home"), ("edge", 0, "Home")]
    ev = spark.createDataFrame(rows, "userId string, ts long, page string")
    got, want = STR.block_maxima(STR.day_blocks(ev)), day_user_maxima(user_days(ev))
    assert sorted(got.collect()) == sorted(want.collect())
    assert [f.dataType for f in got.schema] == [f.dataType for f in want.schema]


def _timed(spark, rows, path):
    """Events (user, microseconds, page) as files of a stream, one row of ``rows`` a file."""
    schema = "userId string, event_time timestamp, page string"
    for n, events in enumerate(rows):
        df = spark.createDataFrame([(u, t, p) for u, t, p in events], "userId string, us long, page string")
        df.selectExpr("userId", "timestamp_micros(us) AS event_time", "page").coalesce(1).write.parquet(f"{path}/part{n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(f"{path}/*")


def _plain_sessions(events, gap):
    out = {}
    for user in sorted({u for u, _, _ in events if u}):
        last, number = None, 0
        for t, page in sorted((t, p) for u, t, p in events if u == user and t is not None):
            if last is None or t - last > gap:
                number += 1
            last = t
            out.setdefault((user, number), []).append(page)
    return sorted((u, n, sum(p == "NextSong" for p in pages), sum(p == "Error" for p in pages)) for (u, n), pages in out.items())


def test_sessions_merge_over_batches_in_any_order(spark, tmp_path):
    import random

    rng = random.Random(5)
    gap = SESSION_GAP_US
    events = [("a", 0, "NextSong"), ("a", gap, "Error"), ("a", 2 * gap + 1, "NextSong"), ("b", -5 * gap, "NextSong"), ("b", -5 * gap, "NextSong"), ("", 3, "Error"), ("c", None, "Error")]
    events += [(rng.choice("bcd"), rng.randrange(40 * gap), rng.choice(["NextSong", "Error", "Home"])) for _ in range(300)]
    # one user holds a third of the events
    events += [("hot", rng.randrange(90 * gap), "NextSong") for _ in range(150)]
    rng.shuffle(events)
    stream = _timed(spark, [events[i::9] for i in range(9)], str(tmp_path / "in"))
    pieces = STR.SessionPieces(str(tmp_path / "out"))
    STR.run_available(stream, pieces, str(tmp_path / "ckpt"), mode="append")
    assert spark.read.parquet(str(tmp_path / "out/pieces")).select("epoch").distinct().count() == 9
    want = _plain_sessions(events, gap)

    def got():
        return sorted((r.userId, r.sessionId, r.sess_listens, r.sess_err) for r in pieces.sessions(spark).collect())

    assert got() == want
    # a replayed micro-batch replaces its own pieces, before and after a merge
    batch = spark.createDataFrame([(u, t, p) for u, t, p in events[0::9]], "userId string, us long, page string").selectExpr("userId", "timestamp_micros(us) AS event_time", "page")
    parts = {r.epoch: r.n for r in spark.read.parquet(str(tmp_path / "out/pieces")).groupBy("epoch").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    pieces.merge(spark)
    pieces.merge(spark)
    assert got() == want
    pieces(batch, max(parts))
    assert got() == want
    # a bridge that comes last joins two sessions
    late = [("a", gap + gap // 2, "Home")]
    pieces(spark.createDataFrame(late, "userId string, us long, page string").selectExpr("userId", "timestamp_micros(us) AS event_time", "page"), 20)
    assert got() == _plain_sessions(events + late, gap)


def test_streamed_sessions_of_the_given_table_equal_batch(spark):
    from churnlab.operators.sessions import session_totals

    streamed = STR.streamed_user_session_totals(spark, stream_events(spark, SF001))
    assert sorted(streamed.collect()) == sorted(session_totals(adapted_events(spark, SF001, attrs=False)).collect())


def test_a_batch_of_session_pieces_reads_no_history(spark, tmp_path):
    base = str(tmp_path)
    pieces = STR.SessionPieces(base)
    rows = [("u", i * SESSION_GAP_US * 2, "NextSong") for i in range(50)]
    df = spark.createDataFrame(rows, "userId string, us long, page string").selectExpr("userId", "timestamp_micros(us) AS event_time", "page")
    for epoch in range(5):
        pieces(df.limit(3), epoch)
    assert spark.read.parquet(f"{base}/pieces").where("epoch = 4").count() == 3
    plan = STR.session_pieces(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "parquet" not in plan


def test_purge_scored_deletes_what_scoring_has_committed(spark, tmp_path):
    import os

    base = str(tmp_path)
    state, out, ckpt = f"{base}/state", f"{base}/scores", f"{base}/score-ckpt"
    rule = SQLTransformer(statement="SELECT *, CAST(total_listens < 2 AS DOUBLE) AS prediction FROM __THIS__")

    def land(name, users):
        STR.land_events(frame(spark, [(u, 1, f"2018-10-10 1{ord(name) - ord('a')}:00", "NextSong", "M", "X, CA") for u in users]), f"{base}/in/{name}")
        stream = STR.read_event_stream(spark, f"{base}/in/*", max_files_per_trigger=1)
        STR.run_available(stream, STR.MatrixUpkeep(state, buckets=4, compact_every=0), f"{base}/ckpt", mode="append")

    def epochs():
        return sorted(int(x.split("=")[1]) for x in os.listdir(f"{state}/matrix") if x.startswith("epoch="))

    def score():
        STR.score_matrix_updates(spark, rule, state, out, ckpt)

    assert STR.purge_scored(spark, state, out, ckpt) == []
    land("a", ["u1", "u2"])
    score()
    land("b", ["u3"])
    land("c", ["u1", "u4"])
    before = epochs()
    assert len(before) >= 3
    STR.compact(spark, state, purge=True)
    # only what was scored goes; nothing is lost for the next run
    gone = STR.purge_scored(spark, state, out, ckpt)
    assert gone and set(gone) < set(before) and epochs() == [e for e in before if e not in gone]
    assert STR.current_matrix(spark, state).count() == 4
    score()
    land("d", ["u5"])
    score()
    STR.compact(spark, state, purge=True)
    # a micro-batch whose commit is missing keeps its epochs
    last = max(int(x) for x in os.listdir(f"{ckpt}/commits") if x.isdigit())
    kept = f"{ckpt}/commits/{last}"
    content = open(kept, "rb").read()
    unread = {r.e for r in spark.read.parquet(STR.scored_files(out)).where(f"epoch = {last}").selectExpr("CAST(regexp_extract(_file, 'epoch=([0-9]+)/', 1) AS INT) AS e").collect()}
    os.rename(kept, f"{base}/held")
    held = STR.purge_scored(spark, state, out, ckpt)
    assert not set(held) & unread
    os.rename(f"{base}/held", kept)
    assert open(kept, "rb").read() == content
    STR.purge_scored(spark, state, out, ckpt)
    assert epochs() == [STR.snapshot_generation(spark, state)]
    scores = STR.latest_by_key(spark.read.parquet(out), ["userId"])
    assert {r.userId: r.predicted_churn for r in scores.collect()} == {"u1": 0.0, "u2": 1.0, "u3": 1.0, "u4": 1.0, "u5": 1.0}
    assert STR.current_matrix(spark, state).count() == 5
