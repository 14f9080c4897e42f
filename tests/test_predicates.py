import datetime as dt

import pytest

from loglattice import Filter, LogView, P, apply_filters, filter_logs
from loglattice.functions.fields import Scope, UnresolvedField
from loglattice.operators.predicates import phrase_pattern

BODIES = [
    "payment failed", "PAYMENT failed", "req-59 ok", "req-592 ok", "100% done", "100x done", "a_b", "axb",
    "it's fine", "what?", "", None,
]
SCHEMA = """id int, ts timestamp, body string, sev string, svc string, n bigint, d decimal(10,2), ok boolean,
    attrs map<string,string>, payload string, tup struct<a: struct<x: struct<y: int, z: string>, w: string>>"""
VIEW = LogView(timestamp="ts", body="body", severity="sev", service="svc", row_id=("id",), json_columns=("payload",))


@pytest.fixture(scope="module")
def logs(spark):
    latency = ["999", "1500", "abc", None]
    rows = []
    for i, body in enumerate(BODIES):
        attrs = {"http.method": "GET" if i % 2 else "POST", "region": "eu"}
        if latency[i % 4] is not None:
            attrs["response_time_ms"] = latency[i % 4]
        rows.append(
            (
                i, dt.datetime(2024, 1, 1, 0, i), body, "ERROR" if i % 2 else "info", f"svc{i % 3}", i * 10, None, i % 2 == 0,
                attrs, '{"user":{"id":%d,"name":"u%d"}}' % (i, i % 2), (((i, f"z{i}"), "w"),),
            )
        )
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def ids(logs):
    def of(pred, view=VIEW, df=None):
        return sorted(r.id for r in filter_logs(df or logs, view, pred).select("id").collect())

    return of


def having(test):
    return [i for i, b in enumerate(BODIES) if b is not None and test(b)]


@pytest.mark.parametrize(
    "pred, expected",
    [
        (P.term("payment"), [0, 1]),
        (P.term("req-59"), [2, 3]),
        (P.phrase("req-59"), [2]),
        (P.phrase("REQ-59"), [2]),
        (P.phrase("it's fine"), [8]),
        (P.phrase("a_b"), [6]),
        (P.phrase("failed"), [0, 1]),
        (P.phrase("fail"), []),
        (P.wildcard("pay*"), [0, 1]),
        (P.wildcard("*ok"), [2, 3]),
        (P.wildcard("*"), list(range(11))),
        (P.wildcard("a_*"), [6]),
        (P.wildcard("what?"), [9]),
        (P.term("100%"), [4]),
        (P.term("a_b"), [6]),
        (P.term("?"), [9]),
        (P.term("\\"), []),
        (P.exists("body"), list(range(10))),
        (P.eq("body", "FAILED"), [0, 1]),
        (P.eq("body", "req-59", quoted=True), [2]),
        (P.eq("body", "null"), []),
        (P.eq("sev", "error"), []),
        (P.eq("sev", "ERROR"), [1, 3, 5, 7, 9, 11]),
        (P.eq("n", "30"), [3]),
        (P.eq("ok", "true"), [0, 2, 4, 6, 8, 10]),
        (P.eq("ok", "false"), [1, 3, 5, 7, 9, 11]),
        (P.eq("d", "null"), list(range(12))),
        (P.eq("d", None), list(range(12))),
        (P.wildcard("e*R", "sev"), [1, 3, 5, 7, 9, 11]),
        (P.phrase("ERROR", "sev"), [1, 3, 5, 7, 9, 11]),
        (P.gt("attrs.response_time_ms", 1000), [1, 5, 9]),
        (P.gt("attrs['response_time_ms']", "1000"), [1, 5, 9]),
        (P.gte("payload.user.id", 10), [10, 11]),
        (P.lt("n", 20), [0, 1]),
        (P.lte("n", "20"), [0, 1, 2]),
        (P.gt("sev", "a"), [0, 2, 4, 6, 8, 10]),
        (P.gte("ts", "2024-01-01 00:10:00"), [10, 11]),
        (P.eq("tup.a.x.y", 4), [4]),
        (P.eq("a.x.z", "z5"), [5]),
        (P.eq("TUP.A.X.Y", 4), [4]),
        (P.exists("attrs"), list(range(12))),
        (P.exists("attrs.gone"), []),
        (~P.eq("attrs.gone", "x"), list(range(12))),
        (P.any_field("s*", lambda f: P.eq(f, "svc1")), [1, 4, 7, 10]),
        (P.any_field("nope*", lambda f: P.eq(f, "x")), []),
        (~P.any_field("nope*", lambda f: P.eq(f, "x")), list(range(12))),
        (P.any_field("*", lambda f: P.eq(f, "30")), [3]),
        (P.values("svc", "svc0", ("or", "svc1")), [0, 1, 3, 4, 6, 7, 9, 10]),
        (P.values("body", "failed", ("and", "payment"), ("or", "done")), [0, 1, 4, 5]),
        (P.values("body", "done", ("or", "failed"), ("and", "payment")), [0, 1]),
        (P.values("body", "req", ("and", P.negate_value("592"))), [2]),
        (P.values("n", 10, ("or", "20")), [1, 2]),
        (P.values("body", P.quoted_value("req-59"), ("or", P.quoted_value("fail"))), [2]),
        (P.values("svc", P.quoted_value("svc1"), ("or", "svc2*")), [1, 2, 4, 5, 7, 8, 10, 11]),
        (P.term("ok") & ~P.term("592"), [2]),
        (P.term("done") | P.term("fine") & P.eq("sev", "ERROR"), [4, 5]),
        (P.eq("http", "x", on_unresolved="body"), []),
        (P.eq("req", "59", on_unresolved="body"), []),
    ],
)
def test_matches(ids, pred, expected):
    assert ids(pred) == expected


def test_body_fallback_searches_the_raw_text(spark, ids):
    df = spark.createDataFrame([(1, "GET http://x/y"), (2, "nothing")], "id int, body string")
    view = LogView(body="body")
    assert ids(P.eq("http", "//x", on_unresolved="body"), view, df) == [1]
    assert ids(P.wildcard("//x*", "*GET http", on_unresolved="body"), view, df) == [1]
    with pytest.raises(UnresolvedField):
        ids(P.eq("http", "//x"), view, df)


def test_predicate_negation_and_null_cover_everything(ids):
    for p in (P.term("a"), P.phrase("done"), P.eq("sev", "ERROR"), P.gt("attrs.response_time_ms", 1000), P.wildcard("*o*")):
        yes, no = set(ids(p)), set(ids(~p))
        assert not yes & no
        assert set(range(12)) - yes - no <= {11, 2, 3, 6, 7, 10}  # only rows whose value is NULL or no number


def test_bare_terms_without_a_body_are_ignored(ids):
    view = LogView(timestamp="ts")
    assert len(ids(P.term("x"), view)) == 12
    assert len(ids(~P.term("x"), view)) == 12
    assert len(ids(P.phrase("x") & P.wildcard("y*"), view)) == 12


def test_literals_are_checked_while_the_plan_is_built(ids):
    with pytest.raises(ValueError):
        ids(P.eq("n", "abc"))


@pytest.mark.parametrize("text, phrase", [("Straße KİNG ſilk", "straße"), ("ÉCOLE x", "école"), ("pasſ it", "pass it"), ("1 K 2", "1 k")])
def test_phrase_prefilter_loses_no_match(spark, ids, text, phrase):
    df = spark.createDataFrame([(1, text)], "id int, body string")
    by_regex = [r.id for r in df.filter(df.body.rlike(phrase_pattern(phrase))).collect()]
    assert ids(P.phrase(phrase), LogView(body="body"), df) == by_regex == [1]


def test_time_range_is_inclusive(ids):
    assert ids(P.time_range("2024-01-01 00:02:00", "2024-01-01 00:04:00")) == [2, 3, 4]
    assert ids(P.time_range("2024-01-01 00:02:00", "2024-01-01 00:04:00", closed=False)) == [2, 3]
    assert ids(P.time_range("2024-01-01T01:02:00+01:00", None)) == list(range(2, 12))
    assert len(ids(P.time_range("2030-01-01", None), LogView(body="body"))) == 12


@pytest.mark.parametrize(
    "filters, expected",
    [
        ([Filter("body", "contains", "a_b")], [6, 7]),
        ([Filter("body", "contains", "100\\%")], [4]),
        ([Filter("body", "contains", "\\")], []),
        ([Filter("body", "=", " REQ-59 ")], [2, 3]),
        ([Filter("body", "!=", "req-59")], [0, 1, 4, 5, 6, 7, 8, 9, 10]),
        ([Filter("sev", "=", "ERROR")], [1, 3, 5, 7, 9, 11]),
        ([Filter("sev", "not_contains", "err")], [0, 2, 4, 6, 8, 10]),
        ([Filter("svc", "one_of", values=["svc0", "svc1"])], [0, 1, 3, 4, 6, 7, 9, 10]),
        ([Filter("svc", "not_one_of", values=["svc0", "svc1"])], [2, 5, 8, 11]),
        ([Filter("svc", "one_of", "svc2")], [2, 5, 8, 11]),
        ([Filter("svc", "one_of")], []),
        ([Filter("svc", "not_one_of")], list(range(12))),
        ([Filter("n", "one_of", values=["10", "20"])], [1, 2]),
        ([Filter("body", "exists")], list(range(10))),
        ([Filter("body", "not_exists")], [10, 11]),
        ([Filter("attrs.gone", "!=", "x")], list(range(12))),
        ([Filter("n", "contains", "10")], [1, 10, 11]),
        ([Filter("svc", "!=", "svc0"), Filter("svc", "!=", "svc1")], [2, 5, 8, 11]),
        ([Filter("svc", "=", "svc0", disabled=True)], list(range(12))),
        ([Filter("svc", "=", "svc0"), Filter("svc", "=", "svc0", disabled=True)], list(range(12))),
    ],
)
def test_filters(logs, filters, expected):
    got = apply_filters(logs, VIEW, filters).select("id").collect()
    assert sorted(r.id for r in got) == expected


def test_every_filter_has_an_exact_opposite(logs):
    for f in (
        Filter("svc", "=", "svc1"), Filter("sev", "contains", "rr"), Filter("svc", "one_of", values=["svc0"]), Filter("body", "exists"),
        Filter("svc", "one_of"),
    ):
        a = {r.id for r in apply_filters(logs, VIEW, [f]).collect()}
        b = {r.id for r in apply_filters(logs, VIEW, [f.opposite()]).collect()}
        assert a | b == set(range(12)) and not a & b
        assert f.opposite().opposite() == f


def test_first_field_of_a_name_wins(spark):
    df = spark.createDataFrame([(1, ((2,),), {"x": "m"})], "x int, s struct<x: struct<x: int>>, m map<string,string>")
    scope = Scope(df, LogView())
    assert scope.get("x").field.source == "column"
    assert scope.get("s.x.x").field.source == "struct"
    assert scope.get("m.x").kind == "map"
    assert scope.resolve("y") is None


def test_longest_map_name_wins(spark):
    df = spark.createDataFrame([({"b.k": "1"}, {"k": "2"})], "a map<string,string>, `a.b` map<string,string>")
    assert df.select(Scope(df, LogView()).get("a.b.k").column).first()[0] == "2"


def test_roles_resolve_by_name(logs):
    assert Scope(logs, VIEW).get("severity").field.display == "sev"
    assert Scope(logs, VIEW).get("__body").kind == "text"


def test_variant_columns(spark):
    df = spark.sql("""SELECT 1 AS id, parse_json('{"user":{"id":7},"user-id":"x"}') AS p UNION ALL SELECT 2, parse_json('{"user":{"id":"n"}}')""")
    view = LogView(row_id=("id",))
    assert [r.id for r in filter_logs(df, view, P.gt("p.user.id", 5)).collect()] == [1]
    assert [r.id for r in filter_logs(df, view, P.eq("p.user-id", "x")).collect()] == [1]
