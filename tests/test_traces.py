import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loglattice import LogView
from loglattice.operators.traces import (
    action_summary, collapse_runs, join_logs_traces, logs_of_trace, phase_breakdown, span_tree, trace_windows, tree_end, waterfall,
)

SPAN = "id string, parent_id string, root_id string, name string, kind string, start_ms double, end_ms double, status string"


def spans_of(spark, rows):
    return spark.createDataFrame(rows, SPAN)


@pytest.fixture(scope="module")
def small(spark):
    return spans_of(
        spark,
        [
            # a root outlived by its render span
            ("r1", None, "r1", "Search", "action", 0.0, 100.0, "ok"),
            ("q1", "r1", "r1", "logs", "logs", 10.0, 90.0, "ok"),
            ("t1", "q1", "r1", "transport", "transport", 10.0, 40.0, "ok"),
            ("s1", "q1", "r1", "server", "server", 40.0, 80.0, "ok"),
            ("d1", "q1", "r1", "decode", "decode", 80.0, 90.0, "ok"),
            ("n1", "r1", "r1", "render", "render", 100.0, 200.0, "ok"),
            # a child still running under an ended root
            ("r2", None, "r2", "Filters", "action", 0.0, 50.0, "ok"),
            ("q2", "r2", "r2", "logs", "logs", 5.0, None, "running"),
            # childless and instant
            ("r3", None, "r3", "Sort", "action", 7.0, 7.0, "ok"),
        ],
    )


def test_tree_end(small):
    got = {r.root_id: (r.tree_end_ms, r.has_running, r.n_rows) for r in tree_end(small).collect()}
    assert got == {"r1": (200.0, False, 6), "r2": (None, True, 2), "r3": (7.0, False, 1)}


@pytest.mark.parametrize("hot", [5_000_000, 1])
def test_waterfall(small, hot):
    got = {r.id: r for r in waterfall(small, hot_rows=hot).collect()}
    assert len(got) == 9
    s1, n1, r3, q2 = got["s1"], got["n1"], got["r3"], got["q2"]
    assert (s1.duration_ms, s1.total_ms, s1.pct, s1.offset_pct, s1.width_pct) == (40.0, 200.0, 20, 20.0, 20.0)
    assert (n1.offset_pct, n1.width_pct) == (50.0, 50.0)
    assert (r3.duration_ms, r3.total_ms, r3.width_pct) == (0.0, 1.0, 0.0)
    assert q2.duration_ms is None and q2.total_ms is None
    live = {r.id: r for r in waterfall(small, now_ms=105.0, hot_rows=hot).collect()}
    assert (live["q2"].duration_ms, live["q2"].total_ms) == (100.0, 105.0)


def test_phase_breakdown_shares_the_sum_of_phases(small):
    got = {(r.root_id, r.kind): (r.total_ms, r.share_pct) for r in phase_breakdown(small).collect()}
    assert got == {
        ("r1", "transport"): (30.0, pytest.approx(100 / 6)), ("r1", "server"): (40.0, pytest.approx(200 / 9)),
        ("r1", "decode"): (10.0, pytest.approx(50 / 9)), ("r1", "render"): (100.0, pytest.approx(500 / 9)),
    }


def test_action_summary(small):
    got = {r.root_id: r for r in action_summary(small, F.col("kind") == "logs", F.lit(5).cast("bigint")).collect()}
    assert (got["r1"].duration_ms, got["r1"].n_queries, got["r1"].read_rows, got["r1"].has_server_stats) == (200.0, 1, 5, True)
    assert got["r2"].duration_ms is None and got["r3"].n_queries == 0 and not got["r3"].has_server_stats


def brute_tree(rows):
    kids = {}
    for r in rows:
        kids.setdefault(r[1], []).append(r)
    out = []

    def visit(r, depth):
        out.append((r[0], depth))
        for c in sorted(kids.get(r[0], []), key=lambda c: (c[5], c[0])):
            visit(c, depth + 1)

    for r in sorted(kids.get(None, []), key=lambda r: r[2]):
        visit(r, 0)
    return out


@pytest.mark.parametrize("hot", [5_000_000, 3])
def test_span_tree_lists_depth_first(spark, hot):
    rng = random.Random(5)
    rows = []
    for t in range(4):
        ids = [f"t{t}-{i:03d}" for i in range(60)]
        for i, s in enumerate(ids):
            if i == 0:
                parent = None
            elif t == 0:
                parent = ids[i - 1]  # one long chain
            elif t == 1:
                parent = ids[1] if i > 1 else ids[0]  # one parent holds nearly all
            else:
                parent = ids[rng.randrange(i)]
            rows.append((s, parent, ids[0], "n", "k", float(rng.randrange(10)), None, "ok"))
    orphan = ("lost", "nobody", "t0-000", "n", "k", 0.0, None, "ok")
    got = span_tree(spans_of(spark, [*rows, orphan]), hot_rows=hot).orderBy("root_id", "path").collect()
    assert [(r.id, r.reachable) for r in got if r.depth is None] == [("lost", False)]
    got = [r for r in got if r.reachable]
    assert [(r.id, r.depth) for r in got] == brute_tree(rows)


def test_span_tree_keeps_loops_apart(spark):
    rows = [("r", None, "r", "n", "k", 0.0, None, "ok"), ("a", "b", "r", "n", "k", 0.0, None, "ok"), ("b", "a", "r", "n", "k", 0.0, None, "ok")]
    got = {r.id: (r.depth, r.reachable) for r in span_tree(spans_of(spark, rows)).collect()}
    assert got == {"r": (0, True), "a": (None, False), "b": (None, False)}


def brute_runs(rows):
    out, boring = {}, {}
    for g, o, name, ok in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        runs = out.setdefault(g, [])
        if ok and boring.get(g) and runs and runs[-1][0] == name:
            runs[-1][1] += 1
        else:
            runs.append([name, 1, o])
        boring[g] = ok
    return {(g, *map(lambda x: x, r)) for g, runs in out.items() for r in runs}


@pytest.mark.parametrize("partitions", ["1", "6"])
def test_collapse_runs_over_block_edges(spark, partitions):
    rng = random.Random(11)
    rows = [(rng.choice(["hot", "hot", "hot", "x", None]), i, rng.choice("ab"), rng.random() < 0.85) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, name string, ok boolean")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = collapse_runs(df, F.col("name"), F.col("ok"), ["g"], ["o"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {(r.g, r["name"], r.n, r.first_o) for r in got} == brute_runs(rows)
    assert sum(r.n for r in got) == 500


def test_blocks_are_spread_over_tasks(spark):
    from loglattice.plans.ordered import BLOCK, into_blocks

    df = spark.range(20000).select(F.lit("one").alias("g"), F.col("id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in into_blocks(df, ["g"], ["id"]).groupBy(BLOCK).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) > 1 and max(sizes) < 20000 * 0.7


def test_logs_of_trace_and_windows(spark):
    t = dt.datetime(2024, 1, 1, 12)
    m = lambda k: t + dt.timedelta(minutes=k)
    logs = spark.createDataFrame(
        [(1, "ab12", m(0)), (2, "ab12", m(-5)), (3, "ab12", m(-6)), (4, "ab12", m(13)), (5, "cd", m(0)), (6, None, m(0)), (7, "ab12", m(14.1))],
        "id int, tid string, ts timestamp",
    )
    view = LogView(timestamp="ts", trace_id="tid", row_id=("id",))
    assert sorted(r.id for r in logs_of_trace(logs, view, "ab12").collect()) == [1, 2, 3, 4, 7]
    with pytest.raises(ValueError):
        logs_of_trace(logs, view, "x' OR 1=1")
    spans = spark.createDataFrame([("ab12", m(0), m(9)), ("ab12", m(2), m(3)), ("ef", m(0), m(1))], "trace_id string, start timestamp, `end` timestamp")
    for hot in (5_000_000, 2):
        got = join_logs_traces(logs, view, trace_windows(spans), hot_rows=hot).collect()
        assert sorted(r.id for r in got) == [1, 2, 4]
