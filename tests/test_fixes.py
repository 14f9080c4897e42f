"""Cases that comparing with SQL over the given tables does not reach."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loglattice.functions.text import redact_words, strip_literals
from loglattice.operators import predicates as P
from loglattice.operators.filters import Filter, apply_filters
from loglattice.operators.predicates import filter_logs
from loglattice.operators.querylog import split_server_time
from loglattice.operators.traces import action_summary, otel_spans, span_tree, waterfall
from loglattice.operators.volume import volume
from loglattice.plans.durable import checkpoint_root
from loglattice.view import LogView

T0 = dt.datetime(2024, 1, 5)
NOON = dt.datetime(2024, 1, 5, 12)


@pytest.mark.parametrize("test, days", [(P.lt, [4, 5]), (P.lte, [4, 5]), (P.gt, [6]), (P.gte, [6])])
def test_a_time_of_day_against_dates(spark, test, days):
    df = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (4, 5, 6)], "d date")
    view = LogView(timestamp="d")
    assert sorted(r.d.day for r in filter_logs(df, view, test("d", NOON)).collect()) == days
    got = filter_logs(df, view, P.time_range(NOON, NOON + dt.timedelta(days=1)))
    assert [r.d.day for r in got.collect()] == [6]


def test_lists_on_containers_and_booleans(spark):
    df = spark.createDataFrame([(1, {"a": "x"}, ["p"], "true"), (2, {"a": "y"}, ["q"], "True")], "id int, m map<string,string>, l array<string>, s string")
    df = df.withColumn("v", F.parse_json(F.concat(F.lit('{"k":'), F.col("id").cast("string"), F.lit("}"))))
    view = LogView(row_id=("id",))
    ids = lambda out: [r.id for r in out.select("id").collect()]
    assert ids(apply_filters(df, view, [Filter("v", "one_of", values=('{"k":2}',))])) == [2]
    assert ids(apply_filters(df, view, [Filter("l", "one_of", values=('["p"]',))])) == [1]
    assert ids(apply_filters(df, view, [Filter("m", "not_one_of", values=("nothing",))])) == [1, 2]
    assert ids(filter_logs(df, view, P.values("v", '{"k":1}', ("or", '{"k":3}')))) == [1]
    assert ids(filter_logs(df, view, P.values("s", True, ("or", "no")))) == ids(filter_logs(df, view, P.eq("s", True))) == [1]
    assert ids(filter_logs(df, view, P.eq("id", 2.0))) == [2]


def test_minutes_of_a_day_and_rows_without_a_time(spark):
    df = spark.createDataFrame([(T0,), (T0 + dt.timedelta(minutes=3),), (None,)], "ts timestamp")
    view = LogView(timestamp="ts")
    assert volume(df, view, "minute", time=(T0, T0 + dt.timedelta(days=1))).count() == 2
    with pytest.raises(ValueError):
        volume(df, view, "minute", time=(T0, T0 + dt.timedelta(days=1)), max_buckets=1000)
    assert [r["count"] for r in volume(df, view, "month").collect()] == [2]


def test_calendar_buckets_do_not_follow_the_session_zone(spark):
    df = spark.createDataFrame([(1704067200,)], "s long").select(F.timestamp_seconds("s").alias("ts"))
    view, got = LogView(timestamp="ts"), []
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got.append(volume(df, view, "month").select(F.unix_seconds("time").alias("t")).first().t)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [1704067200] * 3


def test_redaction_keeps_every_other_character(spark):
    text = " 'a'  -- c\n1 'sql'"
    got = spark.range(1).select(strip_literals(F.lit(text)).alias("t")).first().t
    assert got == " '<redacted>'   \n1 'sql'"
    say = lambda t, *words: spark.range(1).select(redact_words(F.lit(t), words).alias("t")).first().t
    assert say("db redacted x", "db", "redacted") == "<redacted> <redacted> x"
    assert say("a.b a", "a", "a.b") == "<redacted> <redacted>"


SPAN = "root_id string, id string, parent_id string, kind string, start_ms double, end_ms double, status string"


def test_trees_with_ids_that_come_again_and_lost_parents(spark):
    rows = [
        ("t1", "1", "", "a", 0.0, 9.0, "ok"), ("t1", "2", "1", "b", 1.0, 5.0, "ok"), ("t2", "1", None, "a", 0.0, 4.0, "ok"),
        ("t2", "2", "1", "b", 2.0, 3.0, "ok"), ("t2", "3", "9", "b", 2.0, 3.0, "ok"), ("t2", "4", "5", "b", 2.0, 3.0, "ok"), ("t2", "5", "4", "b", 2.0, 3.0, "ok"),
    ]
    spans = spark.createDataFrame(rows, SPAN)
    got = {(r.root_id, r.id): (r.depth, r.reachable) for r in span_tree(spans, order=["id"]).collect()}
    assert len(got) == 7 and span_tree(spans, order=["id"]).count() == 7
    assert got["t1", "2"] == got["t2", "2"] == (1, True) and got["t1", "1"] == (0, True)
    assert got["t2", "3"] == got["t2", "4"] == got["t2", "5"] == (None, False)
    assert {r.total_ms for r in waterfall(spans).collect()} == {9.0, 4.0}
    assert {r.root_id: r.duration_ms for r in action_summary(spans, F.lit(True)).collect()} == {"t1": 9.0, "t2": 4.0}


def test_server_part_ends_at_the_decoding_of_its_own_trace(spark):
    rows = [("t1", "1", "", "q", 0.0, 9.0, "ok"), ("t2", "1", "", "q", 0.0, 9.0, "ok"), ("t2", "2", "1", "decode", 6.0, 9.0, "ok")]
    spans = spark.createDataFrame(rows, SPAN).withColumn("server_query_duration_ms", F.when(F.col("kind") == "q", 3))
    got = {r.root_id: r.end_ms for r in split_server_time(spans).filter("kind = 'server'").collect()}
    assert got == {"t1": 9.0, "t2": 6.0}


def test_otel_table_as_spans(spark):
    df = spark.createDataFrame(
        [(T0, "t", "a", "", 2_500_000, "STATUS_CODE_ERROR", {"k": "v"}), (T0, "t", "b", "a", None, "Ok", None)],
        "Timestamp timestamp, TraceId string, SpanId string, ParentSpanId string, Duration long, StatusCode string, SpanAttributes map<string,string>",
    )
    a, b = otel_spans(df).orderBy("id").collect()
    assert (a.parent_id, a.end_ms - a.start_ms, a.status, a.attrs, a.name) == (None, 2.5, "error", {"k": "v"}, None)
    assert (b.parent_id, b.end_ms, b.status, b.attrs) == ("a", None, "running", {})


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(Session())
