import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from loglattice.functions.text import KEPT_LITERALS, findings, last_limit, redact_words, strip_literals, truncated
from loglattice.operators.querylog import (
    audit_sql, correlate, correlation_status, efficiency_report, parse_tag, query_log_for, split_server_time, warnings,
)

NOW = dt.datetime(2024, 1, 1, 12)
QLOG = """log_comment string, query_id string, type string, event_time timestamp, query_duration_ms bigint, read_rows bigint,
    result_rows bigint, exception_code int, exception string"""


def brute_strip(text):
    kept = "|".join(KEPT_LITERALS)
    rx = re.compile(rf"'((?:[^'\\]|\\.)*)'|--[^\n]*|/\*[\s\S]*?\*/")

    def swap(m):
        if not m[0].startswith("'"):
            return " "
        return m[0] if re.fullmatch(kept, m[1]) else "'<redacted>'"

    return rx.sub(swap, text)


TEXTS = [
    "m = 'break' and x = 'secret'", "x = 'secret' and m = 'break'", "a = 'it\\'s' -- tail\nb", "a /* x\n'y' */ b", "msg = '-- no comment' AND y = 'z'",
    "'a''b'", "'throw''any'", "''", "no quotes", "open ' quote", "-- 'x'\n'y'", "'/*' 'secret' '*/'", "'any' -- x\n 'Table'", "/* 'a", "x--", "'sql '",
    "a '\\\\' b 'c'", "weird '''any'", "", None, "'" + "x" * 50000 + "\\n" * 5000 + "' done",
]


def test_strip_literals_equals_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").select("id", strip_literals(F.col("t")).alias("t"))
    got = {r.id: r.t for r in df.collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == (None if t is None else brute_strip(t)), t


def test_redact_words(spark):
    df = spark.createDataFrame([("FROM prod_db.events JOIN events_x a.b",)], "t string")
    got = df.select(redact_words(F.col("t"), ["prod_db", "events", "a.b", ""]).alias("t")).first().t
    assert got == "FROM <redacted>.<redacted> JOIN events_x <redacted>"


@pytest.mark.parametrize(
    "sql, limit",
    [
        ("SELECT 1 FROM t LIMIT 500", 500), ("SELECT 1 FROM t limit 500 OFFSET 1000", 500), ("SELECT 1 FROM t", None),
        ("WITH s AS (SELECT 1 LIMIT 500) SELECT 1 FROM s LIMIT 10", 10), ("SELECT 1 WHERE m = 'LIMIT 999'", None), ("x LIMIT 5 -- LIMIT 7", 5),
    ],
)
def test_limits(spark, sql, limit):
    clean = strip_literals(F.lit(sql))
    r = spark.range(1).select(last_limit(clean).alias("n"), truncated(clean, F.lit(10)).alias("t")).first()
    assert r.n == limit
    assert r.t == (None if limit is None else 10 >= limit)


@pytest.mark.parametrize(
    "sql, found",
    [
        ("SETTINGS timeout_overflow_mode = 'break'", ["overflowBreak"]), ("read_overflow_mode='break'", ["overflowBreak"]),
        ("RESULT_OVERFLOW_MODE = 'break', group_by_overflow_mode = 'any' SAMPLE 0.1", ["overflowBreak", "groupByAny", "sample"]),
        ("timeout_overflow_mode = 'throw'", []), ("m LIKE '%sample%'", []), ("SELECT 1", []), ("resample", []),
    ],
)
def test_findings(spark, sql, found):
    assert spark.range(1).select(findings(strip_literals(F.lit(sql)))).first()[0] == found


def row(tag, qid, kind="QueryFinish", minutes=1, ms=840, read=1000, result=10, code=0, exc=None):
    return (tag, qid, kind, NOW - dt.timedelta(minutes=minutes), ms, read, result, code, exc)


@pytest.fixture(scope="module")
def qlog(spark):
    return spark.createDataFrame(
        [
            row("app|r1|q1|logs", "a"), row("app|r1|q1|logs", "b", minutes=2, ms=20), row("app|r1|q9|volume", "c", kind="QueryStart"),
            row("app|r2|q2|logs", "d", kind="ExceptionWhileProcessing", code=241, exc="memory"), row("app|r3||logs", "e"), row("other|r1|q1|x", "f"),
            row("", "g"), row("app|r1|q1|logs", "h", minutes=11), row("app|r4", "i"), row("app|r5|q5|logs", "j", ms=10_000),
        ],
        QLOG,
    )


def picked(df):
    return [r.query_id for r in df.collect()]


def test_query_log_for(spark, qlog):
    assert picked(query_log_for(qlog, ["r1", "r2"], NOW, "app")) == ["a", "d", "b"]
    assert picked(query_log_for(qlog, ["r1", "r2"], NOW, "app", limit=1)) == ["a"]
    assert picked(query_log_for(qlog, [], NOW, "app")) == []
    assert sorted(picked(query_log_for(qlog, None, NOW, "app"))) == ["a", "b", "d", "j"]
    frame = spark.createDataFrame([("r1",), ("r1",), ("r9",)], "trace_id string")
    assert picked(query_log_for(qlog, frame, NOW, "app")) == ["a", "b"]


@pytest.fixture(scope="module")
def spans(spark):
    schema = "id string, parent_id string, root_id string, name string, kind string, start_ms double, end_ms double, status string"
    rows = [
        ("r1", None, "r1", "Search", "action", 0.0, 1000.0, "ok"), ("q1", "r1", "r1", "logs", "logs", 0.0, 1000.0, "ok"),
        ("d1", "q1", "r1", "decode", "decode", 950.0, 1000.0, "ok"), ("d2", "q1", "r1", "decode", "decode", 960.0, 1000.0, "ok"),
        ("r2", None, "r2", "Search", "action", 0.0, 10.0, "ok"), ("q2", "r2", "r2", "logs", "logs", 0.0, None, "running"),
        ("r5", None, "r5", "Search", "action", 0.0, 10.0, "ok"), ("q5", "r5", "r5", "logs", "logs", 2.0, 10.0, "ok"),
        ("r6", None, "r6", "Search", "action", 0.0, 10.0, "ok"),
    ]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def joined(spans, qlog):
    return correlate(spans, query_log_for(qlog, None, NOW, "app", limit=None))


def test_correlate_takes_the_earliest_row_of_a_span(joined):
    got = {r.id: r for r in joined.collect()}
    assert len(got) == 9
    assert (got["q1"].matched, got["q1"].server_query_id, got["q1"].server_query_duration_ms) == (True, "b", 20)
    assert got["q2"].server_exception == "memory" and not got["d1"].matched and got["d1"].server_query_id is None


def test_correlation_status(spans, qlog):
    log = query_log_for(qlog, None, NOW, "app", limit=None)
    got = {r.root_id: (r.status, r.n_log_rows) for r in correlation_status(spans, log, F.col("root_id") != "r5").collect()}
    assert got == {"r1": ("ok", 2), "r2": ("ok", 1), "r5": ("not-tagged", 1), "r6": ("no-data", 0)}


def test_split_server_time_clamps_to_the_window(joined):
    got = sorted((r.parent_id, r.kind, r.start_ms, r.end_ms) for r in split_server_time(joined).collect())
    assert got == [("q1", "server", 930.0, 950.0), ("q1", "transport", 0.0, 930.0), ("q5", "server", 2.0, 10.0)]


def test_split_is_not_repeated(joined):
    parts = split_server_time(joined).withColumns({"id": F.concat("parent_id", F.lit("-"), "kind"), "name": F.col("kind"), "status": F.lit("ok")})
    again = joined.unionByName(parts, allowMissingColumns=True)
    assert split_server_time(again).count() == 0


def test_parse_tag(spark):
    df = spark.createDataFrame([("app|a|b|c",), ("app||b",), ("x",)], "t string")
    got = [tuple(r) for r in df.select(*parse_tag(F.col("t")).values()).collect()]
    assert got == [("a", "b", "c"), (None, "b", None), (None, None, None)]


def test_efficiency(spark):
    df = spark.createDataFrame([("a", 1, 1000, 5), ("a", 1, 1000, 500), ("a", 1, 0, 5), ("b", 1, 0, 0)], "op string, h int, read_rows bigint, result_rows bigint")
    got = {r.op: (r.n_queries, r.n_low, r.efficiency_pct) for r in efficiency_report(df, F.col("op"), F.col("h")).collect()}
    assert got == {"a": (3, 1, 25.5), "b": (1, 0, None)}


def test_warnings(spark):
    schema = """id string, root_id string, name string, kind string, status string, error string, sql string, executed_sql string,
        truncated boolean, server_exception_code int, server_exception string"""
    rows = [
        ("s1", "r", "clean", "logs", "ok", None, "SELECT 1", None, False, 0, None),
        ("s2", "r", "cut", "logs", "ok", None, "SELECT 1", "x read_overflow_mode = 'break' SAMPLE 1", None, None, None),
        ("s3", "r", "keys", "mapKeys", "ok", None, "SELECT 1", None, True, None, None),
        ("s4", "r", "page", "logs", "ok", None, "SELECT 1", None, True, None, None),
        ("s5", "r", "bad", "logs", "error", "boom", "SELECT 1", None, None, 241, "mem"),
        ("s6", "r", "hidden", "logs", "ok", None, "SELECT 1", None, None, 241, "mem"),
        ("s7", "r", "render", "render", "error", None, None, "SAMPLE", None, None, None),
        ("s8", "r", "gone", "logs", "cancelled", None, "SELECT 1", None, None, None, None),
    ]
    got = {(r.span_id, r.severity, r.finding, r.detail) for r in warnings(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        ("s2", "warning", "overflowBreak", None), ("s2", "info", "sample", None), ("s3", "info", "truncated", None),
        ("s5", "error", "failed", "boom"), ("s6", "error", "serverException", "mem"), ("s7", "error", "failed", None),
    }


def test_audit(spark):
    df = spark.createDataFrame([("a", "SAMPLE 1"), ("a", "x SAMPLE 2"), ("b", "SELECT 'sample'")], "op string, q string")
    assert [tuple(r) for r in audit_sql(df, "q", F.col("op")).collect()] == [("a", "sample", 2)]
