import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from loglattice import LogView, P
from loglattice.operators.flatten import flatten_json, flatten_map, flatten_rows, normalize_attrs, normalize_report
from loglattice.operators.profile import json_paths, json_schema, map_key_counts, map_keys, profile, semantic_fields, top_values

VIEW = LogView(row_id=("id",), json_columns=("p",))


def leaves(value, prefix=""):
    """Brute force: dotted leaves of a parsed object."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in leaves(v, f"{prefix}.{k}" if prefix else k)]
    if not prefix:
        return []
    if value is None:
        return [(prefix, "")]
    if isinstance(value, bool):
        return [(prefix, str(value).lower())]
    if isinstance(value, list):
        return [(prefix, json.dumps(value, separators=(",", ":")))]
    return [(prefix, str(value))]


TEXTS = [
    '{"user":{"id":42,"name":"alice"},"request":{"method":"GET","tags":["a","b"]},"flags":{"debug":true}}',
    '{"a":null,"e":{},"s":"{\\"not\\":1}","f":1.5,"n":{"x":{"y":{"z":[{"q":1}]}}}}',
    "5", '"text"', "[1,2]", "{bad", "", None, "null", "{}",
    '{"d1":{"d2":{"d3":{"d4":{"d5":{"d6":{"d7":{"d8":{"d9":{"d10":{"d11":1}}}}}}}}}}}',
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, p string")


def expected(i, depth=None):
    try:
        return sorted(leaves(json.loads(TEXTS[i])))
    except (ValueError, TypeError):
        return []


def test_flatten_json_equals_brute_force(docs):
    got = {}
    for r in flatten_json(docs, VIEW, "p", max_depth=12).collect():
        got.setdefault(r.id, []).append((r.key, r.value))
    for i in range(len(TEXTS)):
        assert sorted(got.get(i, [])) == expected(i), TEXTS[i]


def test_depth_comes_from_the_data(spark):
    rows = [(n, "".join(f'{{"d{i}":' for i in range(n)) + "1" + "}" * n) for n in (1, 7, 13, 25)]
    df = spark.createDataFrame(rows, "id int, p string")
    got = {r.id: r.key for r in flatten_json(df, VIEW, "p").collect()}
    assert got == {n: ".".join(f"d{i}" for i in range(n)) for n, _ in rows}
    assert {r.path for r in json_paths(df, "p").collect()} == set(got.values())


def test_objects_below_a_given_depth_stay_whole(docs):
    deep = flatten_json(docs.filter("id = 10"), VIEW, "p", max_depth=10).collect()
    assert [(r.key, r.value) for r in deep] == [("d1.d2.d3.d4.d5.d6.d7.d8.d9.d10", '{"d11":1}')]


def test_flatten_json_of_variant_columns(docs):
    v = docs.withColumn("p", F.try_parse_json("p"))
    a = flatten_json(docs, VIEW, "p").collect()
    assert sorted(a) == sorted(flatten_json(v, LogView(row_id=("id",)), "p").collect())


def test_json_paths_and_types(docs):
    got = {r.path: (r.type, r["count"]) for r in json_paths(docs, "p", 12).collect()}
    assert got["user.id"] == ("BIGINT", 1) and got["flags.debug"] == ("BOOLEAN", 1) and got["request.tags"] == ("ARRAY<STRING>", 1)
    assert set(got) == {k for i in range(len(TEXTS)) for k, _ in expected(i)}
    assert json_schema(docs.filter("id = 0"), "p").first().type.startswith("OBJECT<flags: OBJECT<debug: BOOLEAN>")


def test_normalize_attrs(spark):
    texts = ['{"a":"1","b":2,"c":{"d":[1]},"e":null}', "{'k':'v'}", "{}", "", None, "bad", "[1]", '{"a":'  , '  {"x":"y"}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, m string").withColumn("p", F.col("m"))
    out = normalize_attrs(df, maps=["m"], jsons=["p"], bad_flags=True).select("id", "m", F.to_json("p").alias("p"), "m_bad", "p_bad")
    rows = {r.id: r for r in out.collect()}
    assert rows[0].m == {"a": "1", "b": "2", "c": '{"d":[1]}', "e": ""}
    assert rows[1].m == {"k": "v"} and rows[8].m == {"x": "y"}
    assert all(rows[i].m == {} for i in range(2, 8))
    assert [i for i in rows if rows[i].m_bad] == [5, 6, 7]
    assert json.loads(rows[0].p)["c"] == {"d": [1]} and rows[4].p == "{}" and rows[6].p == "{}"
    assert out.filter("m IS NULL OR p IS NULL").count() == 0
    report = {r["column"]: (r.n_rows, r.n_present, r.n_bad) for r in normalize_report(df, ["m"], ["p"]).collect()}
    assert report["m"] == (9, 7, 3)
    assert report["p"][2] == len([i for i in rows if rows[i].p_bad])


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(1, dt.datetime(2024, 1, 1), "b", {"x.y": "1", "z": None}, {"q": "2"}, '{"u":{"v":3}}', [1, 2]), (2, None, None, {}, None, "junk", None)]
    return spark.createDataFrame(
        rows, "id int, ts timestamp, body string, m map<string,string>, o map<string,string>, p string, arr array<int>"
    )


def test_flatten_map(mixed):
    got = sorted((r.id, r["column"], r.key, r.value) for r in flatten_map(mixed, VIEW).collect())
    assert got == [(1, "m", "x.y", "1"), (1, "m", "z", ""), (1, "o", "q", "2")]


def test_flatten_rows(mixed):
    got = {}
    for r in flatten_rows(mixed, VIEW).collect():
        got.setdefault(r.id, {})[r.key] = (r.value, r.type)
    assert got[1] == {
        "id": ("1", "number"), "ts": ("2024-01-01 00:00:00", "time"), "body": ("b", "string"), "m.x.y": ("1", "string"),
        "m.z": ("", "string"), "o.q": ("2", "string"), "p.u.v": ("3", "string"), "arr": ("[1,2]", "array"),
    }
    assert got[2] == {"id": ("2", "number"), "ts": ("", "time"), "body": ("", "string"), "arr": ("", "array")}


def test_flatten_rows_scans_once(mixed, plan):
    assert plan(flatten_rows(mixed, VIEW)).count("Scan ") == 1


def test_top_values_sample_then_drop_then_total(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=i), ["a", "b", "", None, "{}", "null", "a"][i % 7]) for i in range(70)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, v string")
    view = LogView(timestamp="ts", row_id=("id",))
    got = {r.value: (r["count"], r.total, r.pct) for r in top_values(df, view, "v", sample=14).collect()}
    assert got == {"a": (4, 6, pytest.approx(66.667, abs=0.01)), "b": (2, 6, pytest.approx(33.333, abs=0.01))}
    assert {r.value: (r["count"], r.total) for r in top_values(df, view, "v", limit=1, sample=None).collect()} == {"a": (20, 30)}
    assert top_values(df, view, "v", sample=None, where=P.eq("v", "zz")).count() == 0


def test_profile_and_fields(spark, plan):
    df = spark.createDataFrame([(i, f"k{i % 3}", {"a": "b"}, float(i)) for i in range(10)], "id int, k string, m map<string,string>, d double")
    got = profile(df, LogView(), limit=2).collect()
    assert {(r.value, r["count"], r.total, r["rank"]) for r in got if r.field == "k"} == {("k0", 4, 10, 1), ("k1", 3, 10, 2)}
    assert "WindowGroupLimit" in plan(profile(df, LogView(), limit=2))
    kinds = {r.display: r.type for r in semantic_fields(df, LogView()).collect()}
    assert kinds == {"id": "number", "k": "string", "m": "map", "d": "number"}


def test_map_keys(spark):
    rows = [(i, dt.datetime(2024, 1, 1, 0, i), {"a": "1", f"k{i}": "2"}) for i in range(10)] + [(99, dt.datetime(2023, 1, 1), None)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, m map<string,string>")
    view = LogView(timestamp="ts", row_id=("id",))
    assert {(r.key, r.total) for r in map_keys(df, view, "m", sample=2).collect()} == {("a", 2), ("k8", 2), ("k9", 2)}
    assert {r.total for r in map_keys(df, view, "m", sample=None).collect()} == {11}
    assert {r.key: r["count"] for r in map_key_counts(df, "m").collect()}["a"] == 10


@pytest.mark.parametrize("text, depth", [
    ("{}", 1), ('{"a": 1}', 1), ('{"a": "{{{"}', 1), ('  {"a": {"b": 1}}', 2), ('{"a": "\\"{", "b": {"c": {}}}', 3), ('{"\\\\": {"x": "}"}}', 2),
    ("not json {{{", 3), ("", 1), ('{"a": [{"b": {"c": 1}}]}', 3), ('{"a":' * 40 + "1" + "}" * 40, 40),
])
def test_depth_is_read_from_the_text(spark, text, depth):
    from loglattice.operators.flatten import depth_of

    assert depth_of(spark.createDataFrame([(text,), (None,), ('{"z": 0}',)], "j string"), "j") == depth
