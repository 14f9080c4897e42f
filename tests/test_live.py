"""Statuses and ranks that are kept while streams run."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from loglattice import LogView
from loglattice.operators.querylog import correlation_status
from loglattice.streaming import streams
from loglattice.streaming.status import BUCKETS, STATE_STORE, stream_status
from loglattice.streaming.streams import rank_stream, rank_windows, read_ranks, stream_logs, stream_top_values

T0 = dt.datetime(2024, 1, 1)
VIEW = LogView(timestamp="ts", severity="sev", row_id=("id",))


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STATE_STORE)
    yield
    spark.conf.set(key, before)


ROOTS = "root_id long, start_time timestamp, tagged boolean"
LOGGED = "trace_id long, event_time timestamp"


def _run(spark, path, batches, budget=60):
    """(batch, root, status, rows, settled) of one file of roots and of log rows a batch."""
    for i, (roots, logged) in enumerate(batches):
        spark.createDataFrame(roots, ROOTS).coalesce(1).write.parquet(f"{path}/r/b{i:02d}")
        spark.createDataFrame(logged, LOGGED).coalesce(1).write.parquet(f"{path}/q/b{i:02d}")
        os.utime(f"{path}/r", None)
    r = stream_logs(spark, f"{path}/r/*", ROOTS, batch_files=1)
    q = stream_logs(spark, f"{path}/q/*", LOGGED, batch_files=1)
    got = []

    def save(batch, number):
        got.extend((number, *row) for row in batch.collect())

    changes = stream_status(r, q, budget, "30 seconds", F.col("tagged"))
    writer = changes.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", f"{path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return sorted(got, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[4]))


BATCHES = [
    ([(1, at(0), True), (2, at(1), True), (3, at(2), False), (None, at(3), True)], [(1, at(5)), (9, at(1)), (4, at(3)), (3, at(4)), (9, None)]),
    ([(4, at(40), True), (2, at(41), True)], [(2, at(31)), (1, at(32))]),
    ([(5, at(100), True), (6, at(101), True)], [(5, at(102)), (5, at(103)), (None, at(104))]),
    ([(7, at(500), True)], [(70, at(500))]),
    ([(8, at(900), True)], [(70, at(900))]),
]


def test_a_root_is_pending_then_settled_in_its_time(spark, tmp_path, rocks):
    assert _run(spark, str(tmp_path), BATCHES) == [
        (0, None, "pending", 0, False), (0, 1, "ok", 1, False), (0, 2, "pending", 0, False), (0, 3, "not-tagged", 0, True),
        (1, 2, "ok", 1, False), (1, 4, "ok", 1, False),
        (2, None, "ok", 1, False), (2, 5, "ok", 2, False), (2, 6, "pending", 0, False),
        (3, None, "ok", 1, True), (3, 1, "ok", 2, True), (3, 2, "ok", 1, True), (3, 7, "pending", 0, False),
        (4, 4, "ok", 1, True), (4, 5, "ok", 2, True), (4, 6, "no-data", 0, True), (4, 8, "pending", 0, False),
        (5, 7, "no-data", 0, True),
    ]


def test_settled_rows_equal_the_batch_operator(spark, tmp_path, rocks):
    got = {r[1]: (r[2], r[3]) for r in _run(spark, str(tmp_path), BATCHES) if r[4]}
    spans = spark.createDataFrame([r for b in BATCHES for r in b[0]], ROOTS)
    qlog = spark.createDataFrame([r for b in BATCHES for r in b[1]], LOGGED)
    batch = {r.root_id: (r.status, r.n_log_rows) for r in correlation_status(spans, qlog, F.col("tagged")).collect()}
    settled = {1, 2, 4, 5, 6, 7}
    assert {k: got[k] for k in settled} == {k: batch[k] for k in settled}
    assert 8 not in got and got[3][0] == batch[3][0]


def test_a_root_is_settled_at_the_watermark_and_ids_stay_exact_beside_a_null(spark, tmp_path, rocks):
    big = 2**53
    batches = [
        ([(big, at(0), True), (big + 1, at(0), True), (None, at(0), True)], [(big + 1, at(90))]),
        ([(5, at(90), True)], [(5, at(90))]),  # leaves the watermark at 60, when the first are due
    ]
    assert _run(spark, str(tmp_path), batches) == [
        (0, None, "pending", 0, False), (0, big, "pending", 0, False), (0, big + 1, "ok", 1, False), (1, 5, "ok", 1, False),
        (2, None, "no-data", 0, True), (2, big, "no-data", 0, True), (2, big + 1, "ok", 1, True),
    ]


def test_state_and_timers_are_set_once_a_bucket_and_not_once_a_root(spark, tmp_path, rocks):
    count = 3 * BUCKETS
    ids = spark.range(count).select(F.when(F.col("id") > 0, F.timestamp_micros("id")).alias("id"), F.col("id").alias("k"))
    time = F.lit(at(0)).cast("timestamp")
    ids.select(F.col("id").alias("root_id"), time.alias("start_time")).write.parquet(f"{tmp_path}/r")
    ids.filter("k % 3 = 1").select(F.col("id").alias("trace_id"), time.alias("event_time")).write.parquet(f"{tmp_path}/q")
    r = stream_logs(spark, f"{tmp_path}/r", "root_id timestamp, start_time timestamp")
    q = stream_logs(spark, f"{tmp_path}/q", "trace_id timestamp, event_time timestamp")
    got = []
    writer = stream_status(r, q, 60).withColumn("k", F.unix_micros("root_id")).drop("root_id").writeStream
    writer = writer.foreachBatch(lambda batch, _: got.extend(map(tuple, batch.collect()))).outputMode("update")
    query = writer.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((k or 0, status, n, settled) for status, n, settled, k in got) == [
        (k, "ok" if k % 3 == 1 else "pending", int(k % 3 == 1), False) for k in range(count)
    ]
    states = [p["stateOperators"][0] for p in query.recentProgress]
    assert 0 < sum(p["customMetrics"]["numRegisteredTimers"] for p in states) <= BUCKETS + 1
    assert max(p["numRowsTotal"] for p in states) <= 3 * (BUCKETS + 1)  # an entry and its timer in two orders


# --- ranks --------------------------------------------------------------------------------------

EVENTS = "id int, ts timestamp, sev string"
FILES = [
    [(1, at(5), "a"), (2, at(65), "b"), (3, at(70), "b"), (4, at(90000), "c")],
    [(5, at(6), "b"), (6, at(7), "b"), (7, at(66), None)],
    [(8, at(90010), "d"), (9, at(90020), "d"), (10, at(90020), "a")],
]


def _counts(spark, path):
    for i, rows in enumerate(FILES):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{path}/b{i:02d}")
    return stream_logs(spark, f"{path}/*", EVENTS, batch_files=1)


def test_ranks_follow_every_batch(spark, tmp_path, monkeypatch):
    seen, merge = [], streams._merge_ranks

    def watched(batch, path, limit):
        batch = batch.sparkSession.createDataFrame(batch.collect(), batch.schema)
        merge(batch, path, limit)
        first = sorted(map(tuple, read_ranks(spark, path).collect()))
        merge(batch, path, limit)  # the same batch again
        assert sorted(map(tuple, read_ranks(spark, path).collect())) == first
        changed = {f: os.path.getmtime(f"{path}/ranks/{f}") for f in os.listdir(f"{path}/ranks") if f.startswith("day=")}
        seen.append((first, changed))

    monkeypatch.setattr(streams, "_merge_ranks", watched)
    counts = stream_top_values(_counts(spark, str(tmp_path / "in")), VIEW, "sev", "1 minute", "1 minute", late="3 days")
    out = str(tmp_path / "out")
    rank_stream(counts, out, str(tmp_path / "state"), 1, trigger={"availableNow": True}).awaitTermination()
    rows = spark.createDataFrame([r for f in FILES for r in f], EVENTS).filter("sev IS NOT NULL")
    batch = rows.groupBy(F.window("ts", "1 minute").alias("w"), F.col("sev").alias("value")).agg(F.count("*").alias("count"))
    want = rank_windows(batch.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "value", "count"), 1)
    assert seen[-1][0] == sorted(map(tuple, want.collect()))
    assert [r[2:] for r in seen[0][0]] == [("a", 1, 1), ("b", 2, 1), ("c", 1, 1)]
    first, second = sorted(seen[2][1])
    assert seen[2][1][first] == seen[1][1][first] and seen[2][1][second] > seen[1][1][second]  # the untouched day stays
