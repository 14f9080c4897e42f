import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loglattice import LogView, P
from loglattice.operators.compare import compare_rows, diff_within
from loglattice.operators.explore import (
    detail, duplicate_groups, explore, extract, full, grid, has_more, hydrate, page, page_after, surrounding, surrounding_many, with_row_key,
)
from loglattice.operators.rules import count_matches, tag_matches

T0 = dt.datetime(2024, 1, 1)
VIEW = LogView(timestamp="ts", body="body", severity="sev", service="svc", row_id=("id",))


@pytest.fixture(scope="module")
def logs(spark):
    rows = [
        (i, T0 + dt.timedelta(milliseconds=100 * i, microseconds=i), f"line {i % 7}", "E" if i % 3 else None, f"s{i % 2}", {"k": str(i)})
        for i in range(60)
    ]
    return spark.createDataFrame(rows, "id int, ts timestamp, body string, sev string, svc string, attrs map<string,string>")


def test_grid_names_roles_and_leaves_out_unmapped_ones(logs):
    assert grid(logs, VIEW).columns == ["__timestamp", "__body", "__severity", "__serviceName"]
    assert grid(logs, LogView(body="body"), ["attrs.k"]).columns == ["__body", "attrs.k"]
    assert grid(logs, LogView()).columns == logs.columns
    assert full(logs, VIEW, [("one", F.lit(1))]).columns == [*logs.columns, "one"]


def test_extract_reads_json_text_once(spark, plan):
    df = spark.createDataFrame([(1, '{"a":{"b":1.50,"c":"x"},"d":[1, 2]}'), (2, "junk"), (3, None)], "id int, p string")
    view = LogView(json_columns=("p",))
    out = extract(df, view, ["p.a.b", "p.a.c", "p.d", "p.none"])
    rows = {r["id"]: tuple(r)[2:] for r in out.collect()}
    assert rows == {1: ("1.5", "x", "[1,2]", None), 2: (None,) * 4, 3: (None,) * 4}
    assert plan(out).count("from_json") <= 1 or "get_json_object" not in plan(out)
    # a path inside another cannot share one parse and is read by itself
    both = extract(df, view, ["p.a", "p.a.c"]).filter("id = 1").first()
    assert both["p.a.c"] == "x" and both["p.a"] == '{"b":1.5,"c":"x"}'


def test_row_key_is_the_same_from_narrow_and_full_rows(logs):
    a = {r.row_key for r in with_row_key(logs, VIEW).collect()}
    b = {r.row_key for r in with_row_key(grid(logs, VIEW), VIEW).collect()}
    assert a == b and len(a) == 60


def test_row_key_tells_null_from_text_and_part_from_part(spark):
    rows = [(None, "x"), ("-", "x"), ("null", "x"), ("a", "bc"), ("ab", "c"), ("", "x"), ("1:a", ""), ("1", ":a")]
    df = spark.createDataFrame(rows, "body string, sev string")
    keyed = with_row_key(df, LogView(body="body", severity="sev"))
    assert keyed.select("row_key").distinct().count() == len(rows)
    assert keyed.filter("row_key IS NULL").count() == 0


def test_explore_sorts_limits_and_puts_nulls_last(logs):
    top = explore(logs, VIEW, P.eq("svc", "s0"), limit=3).collect()
    assert [r.id for r in top] == [58, 56, 54]
    by_sev = explore(logs, VIEW, sort="severity" and "__severity", descending=True, limit=60).collect()
    assert all(r.sev is None for r in by_sev[-20:])
    asc = explore(logs, VIEW, sort="sev", descending=False, limit=60, projection="grid").collect()
    assert asc[0]["__severity"] == "E" and asc[-1]["__severity"] is None


def test_pages_cover_everything_once(logs):
    seen = []
    for n in range(4):
        p = page(logs, VIEW, n, 17)
        assert has_more(p, 17) == (n < 3)
        seen += [r.id for r in p.collect()]
    assert seen == list(range(59, -1, -1))


def test_keyset_pages_cover_ties(spark):
    rows = [(i, T0 + dt.timedelta(seconds=i // 5)) for i in range(23)]
    df = spark.createDataFrame(rows, "id int, ts timestamp")
    view = LogView(timestamp="ts", row_id=("id",))
    first = explore(df, view, limit=4).collect()
    seen, last = [r.id for r in first], first[-1]
    while True:
        rows = page_after(df, view, {"ts": last.ts, "id": last.id}, 4).collect()
        if not rows:
            break
        seen, last = seen + [r.id for r in rows], rows[-1]
    assert seen == [r.id for r in df.orderBy(F.desc("ts"), "id").collect()]


def test_detail_uses_the_millisecond_and_the_content(logs):
    row = grid(logs, VIEW).filter("__body = 'line 3'").orderBy("__timestamp").first().asDict()
    row["__timestamp"] = row["__timestamp"].replace(microsecond=row["__timestamp"].microsecond // 1000 * 1000)
    assert detail(logs, VIEW, row).first().id == 3
    assert detail(logs, VIEW, {**row, "__body": "other"}).count() == 0
    null_sev = grid(logs, VIEW).filter("__severity IS NULL").orderBy("__timestamp").first().asDict()
    assert detail(logs, VIEW, null_sev).first().id == 0


def test_hydrate_gives_one_full_row_per_narrow_row(spark, logs):
    doubled = logs.unionByName(logs.withColumn("id", F.col("id") + 1000))
    narrow = grid(logs, VIEW).unionByName(grid(logs, VIEW).limit(1).withColumn("__body", F.lit("nowhere")))
    got = hydrate(doubled, narrow, VIEW).collect()
    assert len(got) == 61
    assert sorted(r.id for r in got if r.id is not None) == list(range(60))
    assert [r["__body"] for r in got if r.id is None] == ["nowhere"]
    assert all(r["__body"] == r.body for r in got if r.id is not None)


def test_duplicate_groups(spark):
    df = spark.createDataFrame([(1, T0, "a"), (2, T0, "a"), (3, T0, "b"), (4, None, None), (5, None, None)], "id int, ts timestamp, body string")
    got = duplicate_groups(df, LogView(timestamp="ts", body="body")).collect()
    assert sorted(r.n_rows for r in got) == [2, 2]


def test_surrounding_is_strict(logs):
    at = logs.filter("id = 30").first().ts
    assert [r.id for r in surrounding(logs, VIEW, at, 3, "before").collect()] == [29, 28, 27]
    assert [r.id for r in surrounding(logs, VIEW, at, 3, "after").collect()] == [31, 32, 33]
    assert surrounding(logs, LogView(timestamp="ts"), at, 2).first().body == ""


def brute_surrounding(rows, anchors, n):
    out = set()
    for aid, by, ts in anchors:
        group = sorted((t, i) for i, b, t in rows if b == by)
        before = [x for x in group if x[0] < ts][-n:]
        later = [x for x in group if x[0] > ts][:n]
        out |= {(aid, -(len(before) - k), i) for k, (_, i) in enumerate(before)}
        out |= {(aid, k + 1, i) for k, (_, i) in enumerate(later)}
    return out


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_surrounding_many_with_a_hot_group_ties_and_nulls(spark, partitions):
    rng = random.Random(3)
    groups = ["hot"] * 6 + ["a", "b", None]
    rows = [(i, rng.choice(groups), T0 + dt.timedelta(seconds=rng.randrange(60))) for i in range(400)]
    anchors = [(f"x{i}", b, t) for i, b, t in rng.sample(rows, 40)] + [("early", "hot", T0 - dt.timedelta(1)), ("late", "a", T0 + dt.timedelta(1)), ("none", "zzz", T0)]
    df = spark.createDataFrame(rows, "id int, svc string, ts timestamp")
    adf = spark.createDataFrame(anchors, "anchor_id string, svc string, ts timestamp")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = surrounding_many(df, LogView(timestamp="ts", row_id=("id",)), adf, n=3, by="svc").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {(r.anchor_id, r.offset, r.id) for r in got} == brute_surrounding(rows, anchors, 3)
    assert len(got) == len({tuple(r) for r in got})


def test_compare_flags_differences_to_the_reference(logs):
    got = compare_rows(logs.filter("id < 4"), VIEW, F.col("id") == 0).collect()
    flags = {(r.id, r.field): r.same for r in got}
    assert flags[(0, "body")] and not flags[(1, "body")]
    assert flags[(3, "sev")] and not flags[(1, "sev")]
    order = [r.field for r in sorted((r for r in got if r.id == 0), key=lambda r: r.field_order)]
    assert order == ["ts", "attrs", "body", "sev", "svc"]


def test_diff_within_counts_null_as_a_value(spark):
    df = spark.createDataFrame([("g", "a", 1), ("g", None, 1), ("h", "a", 2)], "g string, v string, w int")
    got = {(r.g, r.field): (r.n_values, r.differs) for r in diff_within(df, LogView(), "g").collect()}
    assert got == {("g", "v"): (2, True), ("g", "w"): (1, False), ("h", "v"): (1, False), ("h", "w"): (1, False)}


def test_rules(logs):
    rules = {"late": P.gte("ts", T0 + dt.timedelta(seconds=5)), "sev": P.eq("sev", "E"), "never": P.term("nope")}
    tags = {r.id: r.rules for r in tag_matches(logs, VIEW, rules).collect()}
    assert tags[0] == [] and tags[1] == ["sev"] and tags[59] == ["late", "sev"]
    assert {r.rule: r["count"] for r in count_matches(logs, VIEW, rules).collect()} == {"late": 10, "sev": 40, "never": 0}


def test_paging_by_key_reaches_rows_without_a_timestamp(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, T0), (4, T0)], "id int, ts timestamp")
    view = LogView(timestamp="ts", row_id=("id",))
    seen, last = [], {"ts": T0 + dt.timedelta(days=1), "id": 0}
    while (got := page_after(df, view, last, size=1).collect()):
        seen.append(got[0].id)
        last = {"ts": got[0].ts, "id": got[0].id}
    assert seen == [3, 4, 1, 2]


def test_a_path_reads_the_same_alone_and_with_others(spark):
    df = spark.createDataFrame([('{"a":1,"b":2,"a":3}',), ("{bad",), (None,)], "p string")
    view = LogView(json_columns=("p",))
    alone = [r[1] for r in extract(df, view, ["p.a"]).collect()]
    both = [r[1] for r in extract(df, view, ["p.a", "p.b"]).collect()]
    assert alone == both


@pytest.mark.parametrize("newest", [True, False])
@pytest.mark.parametrize("n", [1, 7, 30, 100])
def test_looking_at_timestamps_first_changes_nothing(spark, newest, n):
    rng = random.Random(9)
    # a third of the rows share one instant, some have no timestamp
    rows = [(i, None if i % 20 == 19 else T0 + dt.timedelta(seconds=60 if i % 3 == 0 else rng.randrange(600))) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, ts timestamp")
    view = LogView(timestamp="ts", row_id=("id",))
    plain, pruned = (
        [r.id for r in explore(df, view, P.gte("id", 3), descending=newest, limit=n, time_first=f).collect()] for f in (False, True)
    )
    assert plain == pruned and len(plain) == min(n, 87)


def test_hydrate_prunes_the_scan_by_the_page(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(hours=i), f"b{i}") for i in range(50)]
    spark.createDataFrame(rows, "id int, ts timestamp, body string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    view = LogView(timestamp="ts", body="body", row_id=("id",))
    out = hydrate(df, grid(explore(df, view, limit=5), view), view)
    assert sorted(r.id for r in out.collect()) == [45, 46, 47, 48, 49]
    assert "GreaterThanOrEqual(ts" in out._jdf.queryExecution().executedPlan().toString()


def test_time_first_prunes_partitions_and_row_groups(spark, tmp_path):
    from loglattice.sources.logs import write_logs

    rows = [(i, T0 + dt.timedelta(hours=i) if i else None, f"b{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, body string")
    view = write_logs(df, str(tmp_path / "t"), LogView(timestamp="ts", body="body", row_id=("id",)))
    out = explore(spark.read.parquet(str(tmp_path / "t")), view, limit=5, time_first=True)
    assert [r.id for r in out.collect()] == [99, 98, 97, 96, 95]
    wide = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x and "body" in x]
    assert wide and all("PartitionFilters: [((event_date" in x and "GreaterThanOrEqual(ts" in x for x in wide)
    assert explore(spark.read.parquet(str(tmp_path / "t")), view, limit=200, time_first=True).count() == 100
