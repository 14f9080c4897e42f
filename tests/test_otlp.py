"""Collector payloads against the rows they were made of."""

import base64
import datetime as dt
import json

import pytest

from loglattice.sources.otlp import otlp_logs, otlp_malformed, otlp_spans

T0 = 1544712660300000


def value(x):
    """A Python value in wire form."""
    if isinstance(x, bool):
        return {"boolValue": x}
    if isinstance(x, int):
        return {"intValue": str(x)}
    if isinstance(x, float):
        return {"doubleValue": x}
    if isinstance(x, bytes):
        return {"bytesValue": base64.b64encode(x).decode()}
    if isinstance(x, list):
        return {"arrayValue": {"values": [value(y) for y in x]}}
    if isinstance(x, dict):
        return {"kvlistValue": {"values": pairs(x)}}
    return {} if x is None else {"stringValue": x}


def pairs(d):
    return [{"key": k, "value": value(x)} for k, x in d.items()]


def text(x):
    if isinstance(x, str):
        return x
    if x is None:
        return ""
    if isinstance(x, bytes):
        return base64.b64encode(x).decode()
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False)


VALUES = {
    "s": 'quote " and \\ and é', "empty": "", "n": -3, "big": 2**62, "t": True, "f": False, "d": 1.5, "none": None, "bytes": b"\x00\xff",
    "list": ["a", 2, True, None, 0.25], "deep": [["x", {"k": "v"}], []], "map": {"a.b": {"c": "q\"q", "d": [False]}, "e": {}}, "no": [],
}


def request(kind, items, records, resource=None, scope=None):
    return json.dumps({f"resource{kind}": [{"resource": {"attributes": pairs(resource or {})}, "schemaUrl": "r", f"scope{kind}": [
        {"scope": scope or {}, "schemaUrl": "s", items: records}]}]})


def lines(spark, *given):
    return spark.createDataFrame([(g, 1) for g in given], "value string, ServiceName int")


def test_values_become_the_text_of_the_attribute_maps(spark):
    record = {"timeUnixNano": str(T0 * 1000 + 999), "severityNumber": 9, "severityText": "INFO", "body": value(VALUES["map"]), "attributes": pairs(VALUES),
              "traceId": "ab", "spanId": "cd", "flags": 1}
    got = otlp_logs(lines(spark, request("Logs", "logRecords", [record], {"service.name": "pay", **VALUES}, {"name": "n", "version": "1", "attributes": pairs(VALUES)}))).collect()
    (row,) = got
    want = {k: text(x) for k, x in VALUES.items()}
    assert row.LogAttributes == row.ScopeAttributes == want and row.ResourceAttributes == {"service.name": "pay", **want}
    assert (row.Body, row.ServiceName, row.ScopeName, row.ScopeVersion, row.ResourceSchemaUrl, row.ScopeSchemaUrl) == (want["map"], "pay", "n", "1", "r", "s")
    assert row.Timestamp == dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=T0) and row.TimestampTime == row.Timestamp.replace(microsecond=0)
    assert (row.TraceId, row.SpanId, row.TraceFlags, row.SeverityText, row.SeverityNumber) == ("ab", "cd", 1, "INFO", 9)


def test_what_is_missing_and_what_comes_again(spark):
    records = [
        {}, {"timeUnixNano": "0", "observedTimeUnixNano": str(T0 * 1000)}, {"severityNumber": "x", "attributes": pairs({"a": 1}) + pairs({"a": 2})},
        {"body": value("again")}, {"body": value("again")}, {"attributes": [{"value": value("no key")}]},
    ]
    rows = otlp_logs(lines(spark, request("Logs", "logRecords", records), '{"resourceLogs":[{"scopeLogs":[{}]},{}]}')).collect()
    assert len(rows) == 6 and sum(r.Body == "again" for r in rows) == 2
    assert all(r.ServiceName == "" and r.TraceId == "" and r.ResourceAttributes == {} for r in rows)
    assert sorted(str(r.Timestamp) for r in rows) == ["2018-12-13 14:51:00.300000"] + ["None"] * 5
    assert [r.LogAttributes for r in rows if r.LogAttributes] == [{"a": "1"}]


def test_lists_below_the_depth_keep_their_wire_form(spark):
    given = lines(spark, request("Logs", "logRecords", [{"body": value([[["x"]]])}]))
    assert otlp_logs(given, depth=3).collect()[0].Body == '[[["x"]]]'
    assert json.loads(otlp_logs(given, depth=2).collect()[0].Body) == [[{"values": [{"stringValue": "x"}]}]]


def test_spans(spark):
    span = {"traceId": "t", "spanId": "s", "parentSpanId": "p", "traceState": "x=1", "name": "op", "kind": 3, "startTimeUnixNano": str(T0 * 1000),
            "endTimeUnixNano": str(T0 * 1000 + 1234567), "attributes": pairs({"k": [1]}), "status": {"code": 2, "message": "bad"},
            "events": [{"timeUnixNano": str(T0 * 1000), "name": "e", "attributes": pairs({"n": 1})}],
            "links": [{"traceId": "lt", "spanId": "ls", "attributes": pairs({"m": {}})}]}
    named = {"kind": "SPAN_KIND_SERVER", "status": {"code": "STATUS_CODE_OK"}, "startTimeUnixNano": str(T0 * 1000)}
    one, two, three = otlp_spans(lines(spark, request("Spans", "spans", [span, named, {}], {"service.name": "pay"})).coalesce(1)).collect()
    assert (one.TraceId, one.SpanId, one.ParentSpanId, one.TraceState, one.SpanName, one.SpanKind) == ("t", "s", "p", "x=1", "op", "Client")
    assert (one.Duration, one.StatusCode, one.StatusMessage, one.SpanAttributes, one.ServiceName) == (1234567, "Error", "bad", {"k": "[1]"}, "pay")
    assert one.Events[0].Name == "e" and one.Events[0].Attributes == {"n": "1"} and one.Links[0].TraceId == "lt" and one.Links[0].Attributes == {"m": "{}"}
    assert (two.SpanKind, two.StatusCode, two.Duration) == ("Server", "Ok", None)
    assert (three.SpanKind, three.StatusCode, three.Timestamp, three.Events) == ("Unspecified", "Unset", None, [])


def test_malformed_payloads_give_no_rows_and_are_listed(spark):
    bad = ["not json", None, "{}", '{"resourceLogs":{}}', "[]", ""]
    good = [request("Logs", "logRecords", [{}]), request("Spans", "spans", [{}]), '{"resourceLogs":[]}']
    given = lines(spark, *bad, *good)
    assert otlp_logs(given).count() == 1 and otlp_spans(given).count() == 1
    assert {r.value for r in otlp_malformed(given).collect()} == set(bad)
    assert otlp_logs(given.limit(0)).count() == 0


def test_payloads_are_read_once_without_python(spark, plan):
    p = plan(otlp_logs(lines(spark, request("Logs", "logRecords", [{}]))))
    assert p.count("Scan ") == 1 and "Python" not in p and "Exchange" not in p
