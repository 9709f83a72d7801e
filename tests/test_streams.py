"""Streams and stores under faults, disorder, null keys and clients that never pause."""

import datetime as dt
import random
import time
from collections import deque

import pytest
from pyspark.sql import functions as F

from leafmill.operators import pages as P
from leafmill.operators.folds import fold_by_key
from leafmill.streaming import sessions as Z
from leafmill.streaming.admission import rate_admission
from leafmill.streaming.history import replay_history_stream
from leafmill.streaming.store import SessionStore

BASE = dt.datetime(2024, 1, 1)


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


def source(spark, tmp_path, name, schema, batches):
    """A stream with a micro-batch for each list of rows."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name / f"b{k:05d}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / name))


# folds


def test_folds_keep_null_keys_and_long_integers(spark):
    big = 2**60
    rows = [(None, i, big + i) for i in range(7)] + [(big, 0, None), (big + 1, 1, big)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(4)
    got = fold_by_key(df, ["k"], ["i"], lambda r: [r.k, []], lambda s, r: s[1].append(r.v), tuple, "k long, vs array<long>").collect()
    assert {r.k: r.vs for r in got} == {None: [big + i for i in range(7)], big: [None], big + 1: [big]}
    assert fold_by_key(df.limit(0), ["k"], ["i"], lambda r: [r.k], lambda s, r: None, tuple, "k long").count() == 0


def test_page_operations_that_cannot_be_done_are_errors(spark):
    counts = spark.createDataFrame([(1, 3), (2, 0), (4, 2)], "doc_id long, n_pages long")
    log = [(1, 0, "delete", 0), (1, 1, "delete", None), (1, 2, None, 1), (1, 3, "turn", 1), (2, 0, "delete", 0), (3, 0, "delete", 0), (None, 0, "delete", 0), (4, 0, "to_front", None)]
    done, errors = P.replay_page_ops(counts, spark.createDataFrame(log, "doc_id long, seq long, kind string, arg long"))
    assert {r.doc_id: r.pages for r in done.collect()} == {1: [1, 2], 4: [0, 1]}
    assert {(r.doc_id, r.seq): r.error for r in errors.collect()} == {(1, 1): "no argument", (1, 2): "unknown operation", (1, 3): "unknown operation", (2, 0): "unknown document", (3, 0): "unknown document", (None, 0): "unknown document", (4, 0): "no argument"}


def test_replays_stay_whole_when_their_join_is_planned_anew(spark, tmp_path):
    """A join by shuffles, of which the run makes a broadcast join that reads the shuffled log by its writers, leaves each document's log in one task."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "4k", "spark.sql.files.maxPartitionBytes": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    spark.range(2000).selectExpr("id % 20 as doc_id", "cast(id div 20 as int) as page_no", "repeat(uuid(), 5) as text").write.parquet(str(tmp_path / "pages"))
    kind = F.when(F.col("id") % 3 == 0, "delete").when(F.col("id") % 3 == 1, "duplicate").otherwise("to_front")
    spark.range(0, 6000, 1, 8).select((F.col("id") % 20).alias("doc_id"), F.xxhash64("id").alias("seq"), kind.alias("kind"), (F.col("id") % 97).alias("arg")).write.parquet(str(tmp_path / "log"))
    pages, log = (spark.read.parquet(str(tmp_path / x)) for x in ("pages", "log"))
    want = {d: list(range(100)) for d in range(20)}
    for op in sorted(log.collect(), key=lambda op: op.seq):
        ids = want[op.doc_id]
        k = op.arg % len(ids)
        if op.kind == "delete":
            ids[k : k + 1] = []
        else:
            ids.insert(*((k, ids[k]) if op.kind == "duplicate" else (0, ids.pop(k))))
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = P.replay_page_ops(P.page_counts(pages), log)[0].collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted((r.doc_id, r.pages) for r in got) == sorted(want.items())


def test_history_of_a_null_session(spark):
    log = [(None, i, "edit", 2**60 + i) for i in range(4)] + [(None, 4, "undo", None), (5, 0, "edit", None)]
    got = P.replay_history(spark.createDataFrame(log, "session long, seq long, kind string, state long")).collect()
    assert {r.session: tuple(r)[1:] for r in got} == {None: (4, 2, 2**60 + 2), 5: (1, 0, None)}


# admission


def sequential(rows, limit, window):
    held, out = {}, {}
    for c, ts, i in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        now = held.setdefault(c, deque())
        while now and now[0] <= ts - dt.timedelta(seconds=window):
            now.popleft()
        ok = len(now) < limit
        if ok:
            now.append(ts)
        out[i] = (c, ts, ok, limit - len(now))
    return out | {i: (c, None, None, None) for c, ts, i in rows if ts is None}


@pytest.mark.parametrize(("limit", "window", "slice_rows"), [(3, 60, 10**6), (3, 60, 150), (1, 7, 40), (20, 300, 333)])
def test_admission_equals_the_sequential_fold(spark, limit, window, slice_rows):
    """A client that never pauses (a third of all requests), null clients and stamps, ties, bursts at spans' ends."""
    rng = random.Random(limit)
    rows = [("busy", at(i * 2), i) for i in range(900)]
    rows += [(rng.choice([None, "a", "b", "c"]), at(rng.choice([rng.randrange(4000), 60 * rng.randrange(40), 1000])), 1000 + i) for i in range(900)]
    rows += [("bursts", at(300 * (i // 30) + (i % 30) * rng.choice([0, 1, 2])), 3000 + i) for i in range(600)] + [(None, None, 5000), ("a", None, 5001)]
    df = spark.createDataFrame(rows, "client string, ts timestamp_ntz, id long").repartition(5)
    got = {r.id: (r.client, r.ts, r.admitted, r.remaining) for r in rate_admission(df, limit, window, slice_rows).collect()}
    assert got == sequential(rows, limit, window)


def test_null_clients_are_limited(spark):
    rows = [(None, at(i), i) for i in range(6)] + [(1, at(i), 10 + i) for i in range(6)]
    got = rate_admission(spark.createDataFrame(rows, "client long, ts timestamp_ntz, id long"), 3, 60).where("admitted").groupBy("client").count().collect()
    assert {r.client: r["count"] for r in got} == {None: 3, 1: 3}


def test_trailing_counts_over_the_ends_of_spans(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", None]), at(rng.choice([rng.randrange(300), 60, 120, 119])), i) for i in range(200)] + [("a", None, 900)]
    got = {r.id: r.n_window for r in Z.rate_trailing(spark.createDataFrame(rows, "client string, ts timestamp_ntz, id long"), 60).collect()}
    want = {i: None if ts is None else sum(c == d and u is not None and ts - dt.timedelta(seconds=60) < u <= ts for d, u, _ in rows) for c, ts, i in rows}
    assert got == want


def test_trailing_counts_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), at(i * 7 + rng.randrange(60)), i) for i in range(200)]
    late = [("a", at(0), 900), ("b", at(1), 901)]
    schema = "client string, ts timestamp, id long"
    batches = [rows[k : k + 40] for k in range(0, 200, 40)] + [late, [("end", at(90_000), 999)], [("end", at(90_001), 998)]]
    seen = Z.LateRows.watch(spark)
    q = Z.rate_windows(source(spark, tmp_path, "trail", schema, batches), 60, 20, late="2 minutes").writeStream.outputMode("append").format("memory").queryName("trail").option("checkpointLocation", str(tmp_path / "trail-c")).start()
    q.processAllAvailable()
    q.stop()
    want = {(r.client, r.at): r.n for r in Z.rate_windows(spark.createDataFrame(rows, schema), 60, 20).collect()}
    got = {(r.client, r.at): r.n for r in spark.table("trail").collect() if r.client != "end"}
    for _ in range(600):
        if seen.of(q) >= 2:
            break
        time.sleep(0.1)
    assert got == want and seen.of(q) >= 2
    for (client, end), n in list(want.items())[:50]:
        assert n == sum(c == client and end - dt.timedelta(seconds=60) <= ts < end for c, ts, _ in rows)


def test_late_rows_of_more_batches_than_a_query_remembers(spark, tmp_path):
    schema = "ts timestamp, path string, status int, duration double"
    batches = [[(at(k), "/", 200, 1.0)] for k in (0, 90_000, 90_001)] + [[(at(k), "/", 200, 1.0)] for k in range(15)]
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "4")  # of 100, so that fewer batches do
    seen = Z.LateRows.watch(spark)
    try:
        q = Z.request_metrics(source(spark, tmp_path, "many", schema, batches), "1 hour").writeStream.outputMode("append").format("noop").option("checkpointLocation", str(tmp_path / "many-c")).start()
        q.processAllAvailable()
        q.stop()
        for _ in range(600):  # the listener hears of the last batches a little later
            if seen.of(q) == 15:
                break
            time.sleep(0.1)
        remembered = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
        assert seen.of(q) == 15 > remembered
    finally:
        spark.streams.removeListener(seen)
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")


# history


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_history_of_shuffled_micro_batches_equals_the_table(spark, tmp_path, rocks):
    rng = random.Random(1)
    schema = "session long, ts timestamp, seq long, kind string, state long"
    rows = [(rng.choice([1, 2, None, 2**60 + 1]), at(i * 20), i, rng.choice(["edit", "edit", "edit", "undo", "redo", "x"]), rng.choice([i + 2**60, None])) for i in range(240)]
    want = {r.session: tuple(r)[1:] for r in P.replay_history(spark.createDataFrame(rows, schema), keep=5).collect()}
    order = sorted(rows, key=lambda r: (r[2] // 25, rng.random()))
    batches = [order[k : k + 40] for k in range(0, 240, 40)] + [[(99, at(2 * 86_400), 1, "edit", 7)], [(1, at(3), 500, "edit", 8)], [(99, at(40 * 86_400), 2, "edit", 9)], [(99, at(40 * 86_400 + 1), 3, "edit", 10)]]
    q = replay_history_stream(source(spark, tmp_path, "undo", schema, batches), keep=5, ttl_hours=24 * 30).writeStream.outputMode("update").format("memory").queryName("undo").option("checkpointLocation", str(tmp_path / "undo-c")).start()
    q.processAllAvailable()
    q.stop()
    got = {}
    for r in spark.table("undo").collect():
        got[r.session] = tuple(r)[1:]
    assert {k: v for k, v in got.items() if k != 99} == want and max(v[0] for v in want.values()) == 5
    steps = [op for p in q.recentProgress for op in p["stateOperators"]]
    assert sum(op["numRowsDroppedByWatermark"] for op in steps) == 1
    # two list states and a value of each session at most, of which rows that wait go with their time and the rest with the TTL
    assert steps[-1]["numRowsTotal"] < min(op["numRowsTotal"] for op in steps[2:6])


def test_a_history_begins_anew_after_its_time(spark, tmp_path, rocks):
    schema = "session string, ts timestamp, seq long, kind string, state string"
    batches = [[("s", at(0), 0, "edit", "a"), ("s", at(1), 1, "edit", "b")], [("s", at(2 * 86_400), 2, "undo", None), ("s", at(2 * 86_400 + 1), 3, "edit", "c")], [("t", at(3 * 86_400), 0, "edit", "x")], [("t", at(3 * 86_400), 1, "edit", "y")]]
    q = replay_history_stream(source(spark, tmp_path, "anew", schema, batches), ttl_hours=24).writeStream.outputMode("update").format("memory").queryName("anew").option("checkpointLocation", str(tmp_path / "anew-c")).start()
    q.processAllAvailable()
    q.stop()
    rows = [tuple(r)[1:] for r in spark.table("anew").where("session = 's'").collect()]
    assert rows[0] == (2, 1, "b") and rows[-1] == (1, 0, "c")


# the store of sessions

STATE = "session_id string, ts timestamp, deleted boolean, filename string"
EPOCHS = [[("a", at(0), False, "x"), ("b", at(1), False, "y")], [("a", at(5), False, "x2"), ("c", at(6), False, "z")], [("b", at(9), True, None)], [("d", at(12), False, "w"), ("a", at(11), False, "x3")], [("c", at(14), True, None), ("e", at(15), False, "v")]]
WANT = {"a": "x3", "d": "w", "e": "v"}


def stored(spark, path):
    schema = spark.createDataFrame([], STATE).schema
    return {r.session_id: r.filename for r in Z.stored_sessions(spark, str(path), schema).collect()}


class Killed(Exception):
    pass


@pytest.mark.parametrize("step", ["write", "read", "commit", "clean", "after"])
@pytest.mark.parametrize("epoch", [1, 3])
@pytest.mark.parametrize("late", [False, True])
def test_a_store_killed_at_any_point_is_right_after_the_retry(spark, tmp_path, monkeypatch, step, epoch, late):
    """Killed before or after each step of an epoch with or without a merge, the epoch is tried again, and so are committed ones."""
    path = str(tmp_path / "store")
    frames = [spark.createDataFrame(rows, STATE) for rows in EPOCHS]

    def killed(self, *a, **b):
        if late:
            real(self, *a, **b)
        raise Killed

    before = {}
    for e, df in enumerate(frames):
        store = SessionStore(spark, path, merge_every=2)
        if e == epoch:
            before = stored(spark, path)
            if step != "after":
                real = getattr(SessionStore, step)
                with monkeypatch.context() as m:
                    m.setattr(SessionStore, step, killed)
                    try:
                        store.apply(df, e)
                    except Killed:
                        committed = step == "clean" or step == "commit" and late
                        assert (stored(spark, path) == before) != committed  # one whole version or the other
            else:
                store.apply(df, e)
        store.apply(df, e)
        store.apply(frames[max(0, e - 1)], max(0, e - 1))
    assert stored(spark, path) == WANT
    listed = {name for e in store.epochs()[-2:] for name, _ in store.tables(e)}
    assert set(store._names("data")) == listed and len(store.epochs()) == 2


def test_readers_keep_their_version_during_a_merge(spark, tmp_path):
    path, schema = str(tmp_path / "read"), spark.createDataFrame([], STATE).schema
    store = SessionStore(spark, path, merge_every=1)
    assert Z.stored_sessions(spark, path, schema).count() == 0
    store.apply(spark.createDataFrame(EPOCHS[0], STATE), 0)
    reader = Z.stored_sessions(spark, path, schema)
    store.apply(spark.createDataFrame(EPOCHS[1], STATE), 1)  # merges
    assert {r.session_id: r.filename for r in reader.collect()} == {"a": "x", "b": "y"}
    assert stored(spark, path) == {"a": "x2", "b": "y", "c": "z"}


def test_merges_leave_large_tables_and_keep_deletions_above_them(spark, tmp_path):
    path = str(tmp_path / "tiers")
    store = SessionStore(spark, path, merge_every=3)
    store.apply(spark.createDataFrame([(f"s{i}", at(0), False, "old") for i in range(100)], STATE), 0)
    first = store.tables(0)[0]
    for e in range(1, 12):
        store.apply(spark.createDataFrame([(f"s{e}", at(e), e % 2 == 0, f"v{e}")], STATE), e)
    tables = store.tables(11)
    assert tables[0] == first and len(tables) <= 4 and sum(n for _, n in tables[1:]) == 11
    got = stored(spark, path)
    assert len(got) == 95 and got["s3"] == "v3" and "s4" not in got and got["s50"] == "old"


def test_a_stream_stopped_and_started_again_goes_on(spark, tmp_path):
    stream = source(spark, tmp_path, "src", STATE, EPOCHS[:3])
    run = lambda s: Z.upsert_stream(s, str(tmp_path / "kept"), str(tmp_path / "ck"), merge_every=2).start()
    q = run(stream)
    q.processAllAvailable()
    q.stop()
    # the commit log of the last micro-batch is lost, as when the stream dies right after the merge
    (last,) = sorted(p for p in (tmp_path / "ck" / "commits").iterdir() if p.name.isdigit())[-1:]
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    for k, rows in enumerate(EPOCHS[3:]):
        spark.createDataFrame(rows, STATE).coalesce(1).write.parquet(str(tmp_path / "src" / f"b9{k}"))
    q = run(stream)
    q.processAllAvailable()
    q.stop()
    assert stored(spark, tmp_path / "kept") == WANT
    want = {r.session_id: r.filename for r in Z.session_upsert(spark.createDataFrame([r for e in EPOCHS for r in e], STATE)).select("session_id", F.col("filename")).collect()}
    assert want == WANT


def test_streamed_admission_of_null_clients(spark, tmp_path):
    rows = [(None, at(i), i) for i in range(6)] + [(2**60 + 1, at(i), 10 + i) for i in range(6)]
    schema = "client long, ts timestamp, id long"
    q = Z.rate_admission_stream(source(spark, tmp_path, "nulls", schema, [rows[k::3] for k in range(3)]), 3, 3600).writeStream.outputMode("append").format("memory").queryName("nulls").option("checkpointLocation", str(tmp_path / "nulls-c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("nulls").where("admitted").groupBy("client").count().collect()
    assert {r.client: r["count"] for r in got} == {None: 3, 2**60 + 1: 3}
