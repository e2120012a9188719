"""Streams: final state equals the batch, order and repeats do not matter."""

import json
import random
from pathlib import Path

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import Window
from pyspark.sql import functions as F

from inkmirror.operators import requests
from inkmirror.operators.decide import fold_actions
from inkmirror.sources.index_store import IndexStore
from inkmirror.streaming import feed as streams
from inkmirror.streaming import replay, state
from inkmirror.streaming import requests as request_stream

FEED = "doc_id STRING, seq BIGINT, t BIGINT, ok BOOLEAN"


def rows_of(seed, n=120):
    rng = random.Random(seed)
    return [(f"d{rng.randrange(15)}", i, rng.randrange(0, 30), rng.random() < 0.7) for i in range(n)]


def batch_state(spark, rows):
    changes = streams.as_index_changes(spark.createDataFrame(rows, FEED), "root", "now")
    folded = fold_actions(changes).where("action <> 'skip' AND ok")
    last = folded.groupBy("doc_id").agg(F.max_by("update_time", "seq").alias("u"))
    return {r["doc_id"]: r["u"] for r in last.collect()}


def test_state_does_not_depend_on_arrival(spark, tmp_path):
    rows = rows_of(1)
    want = batch_state(spark, rows)
    shuffled = spark.createDataFrame(rows, FEED).withColumn("arrival", F.col("seq") * 37 % len(rows))
    feed = streams.as_index_changes(shuffled, "root", "now")
    store = IndexStore(spark, str(tmp_path / "index"))
    source = replay.as_stream(feed, "arrival", batches=3)
    streams.keep_newest(source, store, str(tmp_path / "cp")).awaitTermination()
    assert {r["doc_id"]: r["update_time"] for r in store.load().collect()} == want
    batch = streams.newest_entries(feed)
    assert {r["doc_id"]: r["update_time"] for r in batch.collect()} == want


def test_actions_restart_and_repeat(spark, tmp_path):
    rows = rows_of(2)
    feed = streams.as_index_changes(spark.createDataFrame(rows, FEED), "root", "now")
    store = IndexStore(spark, str(tmp_path / "index"))
    actions, checkpoint = str(tmp_path / "actions"), str(tmp_path / "cp")
    source = replay.as_stream(feed, "seq", batches=2)
    streams.sync_feed(source, store, actions, checkpoint, group_rows=5).awaitTermination()
    want = [r["action"] for r in fold_actions(feed).orderBy("seq").collect()]
    assert [r["action"] for r in spark.read.parquet(actions).orderBy("seq").collect()] == want
    runs = store.last_run()
    streams.sync_feed(source, store, actions, checkpoint).awaitTermination()  # nothing new arrived
    assert store.last_run() == runs and spark.read.parquet(actions).count() == len(rows)
    assert {r["doc_id"]: r["update_time"] for r in store.load().collect()} == batch_state(spark, rows)


def test_quota_stops_after_commit(spark, tmp_path):
    rows = [(*row, row[1] == 70) for row in rows_of(3, 100)]
    feed = streams.as_index_changes(spark.createDataFrame(rows, FEED + ", quota BOOLEAN"), "root", "now")
    store = IndexStore(spark, str(tmp_path / "index"))
    called = []
    source = replay.as_stream(feed, "seq", batches=2)
    query = streams.sync_feed(source, store, str(tmp_path / "actions"), str(tmp_path / "cp"), on_quota=lambda: called.append(1))
    with pytest.raises(StreamingQueryException):
        query.awaitTermination()
    done = spark.read.parquet(str(tmp_path / "actions"))
    assert called and done.agg(F.max("seq")).first()[0] == 69 and done.count() == 70
    assert {r["doc_id"]: r["update_time"] for r in store.load().collect()} == batch_state(spark, [r[:4] for r in rows[:70]])


def test_restart_begins_with_the_event_that_met_the_quota(spark, tmp_path):
    """Answers in the middle of a batch, next to each other and at the first event; every event counts once."""
    for name, hits in {"middle": {5}, "first": {0}, "both": {0, 3, 4, 61}}.items():
        plain = rows_of(5, 90)
        rows = [(*row, row[1] in hits) for row in plain]
        feed = streams.as_index_changes(spark.createDataFrame(rows, FEED + ", quota BOOLEAN"), "root", "now")
        store = IndexStore(spark, str(tmp_path / name / "index"))
        actions, checkpoint = str(tmp_path / name / "actions"), str(tmp_path / name / "cp")
        source = replay.as_stream(feed, "seq", batches=3)
        for _ in hits:
            with pytest.raises(StreamingQueryException):
                streams.sync_feed(source, store, actions, checkpoint).awaitTermination()
        streams.sync_feed(source, store, actions, checkpoint).awaitTermination()
        want = fold_actions(streams.as_index_changes(spark.createDataFrame(plain, FEED), "root", "now"))
        got = spark.read.parquet(actions).orderBy("seq").select("seq", "action").collect()
        assert got == want.orderBy("seq").select("seq", "action").collect(), name
        assert {r["doc_id"]: r["update_time"] for r in store.load().collect()} == batch_state(spark, plain)


def test_answers_to_the_repeated_request(spark, tmp_path):
    """It meets the quota again, then fails: the stream waits there, then the event counts as failed."""
    rows = [("a", 0, 5, True, False), ("a", 1, 9, True, True), ("b", 2, 7, True, False)]
    feed = streams.as_index_changes(spark.createDataFrame(rows, FEED + ", quota BOOLEAN"), "root", "now")
    store = IndexStore(spark, str(tmp_path / "index"))
    source, answers = replay.as_stream(feed, "seq", batches=1), []

    def start():
        table = spark.createDataFrame(answers, "seq BIGINT, ok BOOLEAN, quota BOOLEAN")
        streams.sync_feed(source, store, str(tmp_path / "a"), str(tmp_path / "cp"), answers=lambda: table).awaitTermination()

    for again in (False, True):
        answers[:] = [(1, True, True)] if again else []
        with pytest.raises(StreamingQueryException):
            start()
        assert {r["seq"] for r in spark.read.parquet(str(tmp_path / "a")).collect()} == {0}
    answers[:] = [(1, False, False)]
    start()
    done = {r["seq"]: (r["action"], r["ok"]) for r in spark.read.parquet(str(tmp_path / "a")).collect()}
    assert done == {0: ("create", True), 1: ("update", False), 2: ("create", True)}
    assert {r["doc_id"]: r["update_time"] for r in store.load().collect()} == {"a": "5", "b": "7"}


def test_an_empty_stream(spark, tmp_path):
    feed = streams.as_index_changes(spark.createDataFrame([], FEED), "root", "now")
    store = IndexStore(spark, str(tmp_path / "index"))
    streams.keep_newest(replay.as_stream(feed, "seq", batches=3), store, str(tmp_path / "cp")).awaitTermination()
    assert store.load().count() == 0


def test_a_store_that_is_in_use(spark, tmp_path):
    """Earlier runs and other streams take no batch away; an older event changes nothing."""
    feed = streams.as_index_changes(
        spark.createDataFrame([("d0", 0, 100, True), ("d1", 1, 100, True), ("d2", 2, 950, True)], FEED), "root", "now"
    )
    held = streams.as_index_changes(spark.createDataFrame([("d0", 0, 900, True), ("d2", 1, 900, True)], FEED), "root", "then")
    for name, start in (
        ("state", lambda source, store, cp: streams.keep_newest(source, store, cp)),
        ("fold", lambda source, store, cp: streams.sync_feed(source, store, f"{cp}-actions", cp)),
    ):
        store = IndexStore(spark, str(tmp_path / name))
        store.append(held, 0)
        for n in range(2):  # the second stream starts anew on what the first has left
            start(replay.as_stream(feed, "seq", batches=2), store, str(tmp_path / f"{name}-cp{n}")).awaitTermination()
            assert {r["doc_id"]: r["update_time"] for r in store.load().collect()} == {"d0": "900", "d1": "100", "d2": "950"}
        store.append(held.where("doc_id = 'd0'"), store.last_run() + 1)
        assert store.load().count() == 3


def test_schedule():
    assert streams.schedule_trigger(3, "minutes") == {"processingTime": "300000 milliseconds"}
    assert streams.schedule_trigger(2, "hours") == {"processingTime": "7200000 milliseconds"}


def test_one_active_run(spark, tmp_path):
    feed = streams.as_index_changes(spark.createDataFrame(rows_of(4, 10), FEED), "root", "now")
    source = replay.as_stream(feed, "seq", batches=1)
    store = IndexStore(spark, str(tmp_path / "index"))
    checkpoint = str(tmp_path / "cp")
    trigger = streams.schedule_trigger(1, "hours")
    first = streams.keep_newest(source, store, checkpoint, trigger)
    try:
        second = streams.keep_newest(source, store, checkpoint, trigger)
        # the session lets only one query with this checkpoint go on
        assert second.id == first.id and not first.isActive
        second.stop()
    except Exception as error:
        assert "concurrent" in str(error).lower() or "already" in str(error).lower()
    finally:
        first.stop()


def test_seeded_state_does_not_depend_on_arrival(spark, tmp_path):
    """Over an index with older, newer and untimed entries, one document with a third of the events."""
    rows = [("hot" if i % 3 == 0 else d, i, t, ok) for d, i, t, ok in rows_of(6, 150)]
    feed = streams.as_index_changes(spark.createDataFrame(rows, FEED), "root", "now").withColumn("title", F.col("seq").cast("string"))
    held = streams.as_index_changes(
        spark.createDataFrame([("d0", 0, 5, True), ("d1", 1, 900, True), ("d2", 2, 0, True), ("hot", 3, 20, True), ("x", 4, 1, True)], FEED), "root", "then"
    )
    shared = IndexStore(spark, str(tmp_path / "shared"))
    shared.append(held, 0)
    streams.keep_newest(replay.as_stream(feed, "seq", batches=3), shared, str(tmp_path / "cp0")).awaitTermination()
    want = sorted(map(tuple, shared.load().collect()))
    for name, order in {"in order": "seq", "shuffled": "arrival"}.items():
        store = IndexStore(spark, str(tmp_path / name))
        store.append(held, 0)
        source = replay.as_stream(feed.withColumn("arrival", F.col("seq") * 37 % len(rows)), order, batches=3)
        state.keep_newest_from(source, store, str(tmp_path / f"cp {name}")).awaitTermination()
        assert sorted(map(tuple, store.load().collect())) == want, name


def test_requests_close_by_answer_or_timer(spark, tmp_path):
    """Answers, exhausted retries, requests that break off, attempts after the end, one far behind."""
    log = [
        (1, 1, "success", 0), (2, 1, "retryable", 0), (2, 2, "fatal", 1), (2, 3, "success", 3),
        (3, 1, "retryable", 0), (3, 2, "retryable", 1), (3, 3, "retryable", 3), (3, 4, "retryable", 7), (3, 5, "success", 15),
        (4, 1, "retryable", 2), (4, 2, "retryable", 4), (5, 2, "success", 9), (6, 1, "quota", 5), (6, 2, "success", 6),
        (7, 1, "retryable", 4000), (7, 2, "success", 4002),
    ]
    bodies = {"success": (200, '{"code":0}'), "fatal": (403, '{"code":1}'), "retryable": (503, None), "quota": (429 - 29, '{"code":200005}')}
    rows = [(r, a, *bodies[o], 1_700_000_000 + s) for r, a, o, s in log] + [(-1, 1, 200, '{"code":0}', 1_700_100_000)]
    frame = spark.createDataFrame(rows, "request_id BIGINT, attempt INT, status INT, payload STRING, s BIGINT")
    timed = frame.select("request_id", "attempt", "status", "payload", F.timestamp_seconds("s").alias("ts"), "s")
    want = {r["request_id"]: tuple(r) for r in requests.resolve(requests.classify(timed)).collect() if r["request_id"] >= 0}
    assert want[4][1] == "failed" and want[5][1] == "success" and want[3][1:3] == ("failed", 4)
    source = replay.as_stream(timed, "s", batches=2)
    resolved = request_stream.resolve_stream(source, "ts")
    out = str(tmp_path / "out")
    resolved.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(out).where("request_id >= 0").collect()]
    assert len(got) == len(want) and {r[0]: r for r in got} == want


@pytest.mark.parametrize("groups", [1, 7])
def test_requests_share_state_and_timers(spark, tmp_path, groups):
    """Random logs over several micro-batches, also requests without an id: the state has a row per group,
    an answer closes its request before the timer, and all is forgotten in the end."""
    rng, rows = random.Random(groups), []
    codes = [(200, '{"code":0}'), (403, '{"code":1}'), (503, None), (429, None), (500, None)]
    for request in [None, *range(200)]:
        at = 1_700_000_000 + rng.randrange(0, 600) * (request is not None)
        for attempt in range(1, rng.randrange(1, 6) + 1):
            if rng.random() < 0.9:
                rows.append((request, attempt, *rng.choice(codes), at))
            at += min(2 ** (attempt - 1), 8)
    rows += [(-1, 1, 200, '{"code":0}', 1_700_100_000), (-2, 1, 200, '{"code":0}', 1_700_200_000)]
    frame = spark.createDataFrame(rows, "request_id BIGINT, attempt INT, status INT, payload STRING, s BIGINT")
    timed = frame.select("request_id", "attempt", "status", "payload", F.timestamp_seconds("s").alias("ts"), "s")
    want = {r["request_id"]: tuple(r) for r in requests.resolve(requests.classify(timed)).where("request_id >= 0 OR request_id IS NULL").collect()}
    # numbers by time, so that each micro-batch has a part of the log
    order = timed.withColumn("n", F.row_number().over(Window.orderBy("s", "request_id", "attempt")))
    source = replay.as_stream(order, "n", batches=4)
    resolved = request_stream.resolve_stream(source, "ts", groups=groups)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    query = resolved.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(out).where("request_id >= 0 OR request_id IS NULL").collect()]
    assert len(got) == len(want) and {r[0]: r for r in got} == want
    # a row and a timer (with its index) per group, and two for requests without an id
    kept = [p["stateOperators"][0] for p in query.recentProgress]
    assert max(k["numRowsTotal"] for k in kept) <= 3 * (groups + 1)
    # the first micro-batch closes by answers alone
    assert kept[0]["customMetrics"]["numExpiredTimers"] == 0
    first = spark.read.parquet(out).where(F.input_file_name().isin(_files_of_batch(spark, out, 0))).count()
    assert first > 0


def _files_of_batch(spark, out, number):
    entries = [json.loads(line) for line in Path(f"{out}/_spark_metadata/{number}").read_text().splitlines()[1:]]
    return [e["path"] for e in entries]


def test_attempts_are_folded_in_order_of_arrival():
    """The first attempt that ends a request counts, of the same attempt the first that arrived."""
    columns = ["request_id", "seen", "terminal", "deadline", "outcome", "closed"]
    big = 2**62 + 1
    rows = [(big, 1, 0, 5, "", False), (3, 4, 3, 9, "fatal", False), (big, 2, 2, 4, "success", False), (3, 2, 2, 7, "quota", True), (3, 2, 2, 8, "fatal", False)]
    got = request_stream.fold(pd.DataFrame(rows, columns=columns))
    assert [tuple(r) for r in got[columns].itertuples(index=False)] == [(3, 6, 2, 9, "quota", True), (big, 3, 2, 5, "success", False)]
    assert request_stream.fold(pd.DataFrame([], columns=columns)).empty


def test_seeded_state_is_native_and_takes_the_index_once(spark, tmp_path):
    """No Python call per document; a batch appends changed documents only, a restart reads no index."""
    held = streams.as_index_changes(spark.createDataFrame([("a", 0, 50, True), ("b", 1, 5, True), ("c", 2, 7, True)], FEED), "root", "then")
    rows = [("a", 0, 10, True), ("b", 1, 20, True), ("n", 2, 1, True), ("b", 3, 15, True), ("n", 4, 9, False), ("c", 5, 7, True)]
    feed = streams.as_index_changes(spark.createDataFrame(rows, FEED), "root", "now")
    store, checkpoint = IndexStore(spark, str(tmp_path / "index")), str(tmp_path / "cp")
    store.append(held, 0)
    source = replay.as_stream(feed, "seq", batches=2)
    assert source.isStreaming and "python" not in state.newest_from(feed, held)._jdf.queryExecution().executedPlan().toString().lower()
    state.keep_newest_from(source, store, checkpoint).awaitTermination()

    def appended():
        return [sorted(r["doc_id"] for r in spark.read.parquet(f"{store.root}/{f}").collect()) for f in store.state().changes]

    assert appended() == [["a", "b", "c"], ["b", "n"], []]  # the run before, then the two batches
    state.keep_newest_from(source, store, checkpoint).awaitTermination()  # nothing new arrived
    assert len(appended()) == 3
    assert {r["doc_id"]: r["update_time"] for r in store.load().collect()} == {"a": "50", "b": "20", "c": "7", "n": "1"}
