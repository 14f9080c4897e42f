import datetime as dt

from pyspark.sql import functions as F

import pytest

from loglattice import LogView, P, filter_logs
from loglattice.operators.rules import tag_matches
from loglattice.operators.volume import volume
from loglattice.catalog import streams
from loglattice.catalog.streams import drain_append, drain_updates
from loglattice.streaming.streams import (
    ingest, rank_windows, stream_correlate, stream_dedupe, stream_logs, stream_top_values, stream_volume,
)

T0 = dt.datetime(2024, 1, 1)
VIEW = LogView(timestamp="ts", body="body", severity="sev", row_id=("id",))
SCHEMA = "id int, ts timestamp, body string, sev string"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def files(spark, path, batches, schema=SCHEMA):
    """One file per batch, read one file per micro-batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/b{i:02d}")
    return stream_logs(spark, f"{path}/*", schema, maxFilesPerTrigger=1)


BATCHES = [
    [(1, at(5), "a one", "E"), (2, at(65), "b", "I")],
    [(3, at(70), "a two", "I"), (4, at(10), "late but fine", "E")],
    [(5, at(4000), "a far", "E")],
    [(6, at(5000), "z", None)],
]


def test_stream_volume_equals_batch(spark, tmp_path):
    s = files(spark, tmp_path, BATCHES)
    got = drain_updates(stream_volume(s, VIEW, "minute"), ["time", "level"], "count", "t")
    want = volume(spark.read.schema(SCHEMA).parquet(f"{tmp_path}/*"), VIEW, "minute", by="severity")
    assert sorted(map(tuple, got.select("time", "level", "count").collect())) == sorted(map(tuple, want.select("time", "level", "count").collect()))


def test_rows_after_the_watermark_are_dropped(spark, tmp_path):
    late = [*BATCHES, [(7, at(1), "too late", "E"), (8, at(5001), "now", "I")]]
    got = drain_updates(stream_volume(files(spark, tmp_path, late), VIEW, "minute", by=None), ["time", "level"], "count", "t")
    assert sum(r["count"] for r in got.collect()) == 7


def test_live_filter_and_tags(spark, tmp_path):
    s = files(spark, tmp_path, BATCHES)
    tail = drain_append(tag_matches(filter_logs(s, VIEW, P.term("a")), VIEW, {"e": P.eq("sev", "E")}).select("id", "rules"), "t")
    assert sorted((r.id, tuple(r.rules)) for r in tail.collect()) == [(1, ("e",)), (3, ()), (4, ("e",)), (5, ("e",))]


def test_ingest_writes_everything_once(spark, tmp_path):
    s = files(spark, tmp_path / "in", BATCHES)
    for _ in range(2):
        ingest(s, str(tmp_path / "out"), str(tmp_path / "ck"), trigger={"availableNow": True}).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 4, 5, 6]


def test_ingest_partitions_by_day(spark, tmp_path):
    s = files(spark, tmp_path / "in", BATCHES)
    ingest(s, str(tmp_path / "out"), str(tmp_path / "ck"), VIEW, trigger={"availableNow": True}).awaitTermination()
    df = spark.read.parquet(str(tmp_path / "out"))
    view = VIEW.with_(partition_col="event_date", partition_by="day")
    got = filter_logs(df, view, P.time_range(T0, at(3600)))
    assert "PartitionFilters: [isnotnull(event_date" in got._jdf.queryExecution().executedPlan().toString()
    given = spark.createDataFrame([r for b in BATCHES for r in b], SCHEMA)
    assert df.count() == given.count() and got.count() == given.filter(F.col("ts").between(T0, at(3600))).count()


def test_top_values(spark, tmp_path):
    counts = stream_top_values(files(spark, tmp_path, BATCHES), VIEW, "sev", "2 minutes", "1 minute")
    got = drain_updates(counts, ["window_start", "window_end", "value"], "count", "t")
    first = {r.window_start: (r.value, r["count"]) for r in rank_windows(got, 1).collect()}
    assert first[T0] == ("E", 2) and first[at(60)] == ("I", 2)


def test_dedupe(spark, tmp_path):
    again = [[(1, at(5), "x", "E")], [(2, at(5), "x", "E"), (3, at(5), "y", "E")], [(4, at(6), "x", "E")]]
    got = drain_append(stream_dedupe(files(spark, tmp_path, again), VIEW).select("id"), "t")
    assert sorted(r.id for r in got.collect()) == [1, 3, 4]


def test_correlate_gives_matched_and_unmatched_spans(spark, tmp_path):
    spans = files(
        spark, tmp_path / "s",
        [[("r", "a", at(0)), ("r", "b", at(1)), ("r", "c", at(2))], [("z", "flush", at(900))], [("z", "flush2", at(1800))]],
        "root_id string, id string, start_time timestamp",
    )
    log = files(
        spark, tmp_path / "q",
        [[("r", "a", at(8), 5)], [("r", "b", at(60), 6), ("z", "x", at(900), 0)], [("z", "y", at(1800), 0)]],
        "trace_id string, span_id string, event_time timestamp, ms int",
    )
    got = drain_append(stream_correlate(spans, log).select("id", "ms"), "t")
    rows = {r.id: r.ms for r in got.collect()}
    assert rows["a"] == 5 and rows["b"] is None and rows["c"] is None


def test_event_time_of_ntz_columns(spark, tmp_path):
    schema = "id int, ts timestamp_ntz, body string, sev string"
    s = files(spark, tmp_path, BATCHES, schema)
    got = drain_updates(stream_volume(s, VIEW, "minute"), ["time", "level"], "count", "t")
    assert sum(r["count"] for r in got.collect()) == 6
    with pytest.raises(ValueError):
        stream_volume(s, VIEW, "month")


def test_registered_correlation_gives_spans_without_log_rows(spark):
    got = streams.QUERIES["st_correlate_outer"](spark, "/root/testdata/sf0.001").collect()
    matched = streams.QUERIES["st_correlate"](spark, "/root/testdata/sf0.001").count()
    assert sum(r.event_time is not None for r in got) == matched < len(got)
