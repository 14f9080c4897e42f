import datetime as dt

import pytest
from pyspark.sql import functions as F

from loglattice import LogView, P
from loglattice.functions.buckets import auto_step, estimate_buckets, resolve_interval
from loglattice.operators.volume import (
    pivot_volume, rank_levels, severity_rank, volume, volume_totals, volume_vs_previous, zero_fill,
)

EPOCH = dt.datetime(1970, 1, 1)
VIEW = LogView(timestamp="ts", severity="sev", row_id=("id",))


def after(seconds):
    return EPOCH + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize(
    "span, step", [(60, 10), (3600, 60), (365 * 86400, 10 * 86400), (5 * 365 * 86400, 90 * 86400), (200 * 365 * 86400, 4 * 365 * 86400)]
)
def test_auto_step(span, step):
    assert auto_step(EPOCH, after(span)) == step


def test_interval_rules():
    assert estimate_buckets("minute", EPOCH, after(3600)) == 60
    assert 30 < estimate_buckets("auto", EPOCH, after(3600)) <= 60
    with pytest.raises(ValueError):
        resolve_interval("second", EPOCH, after(3600), max_buckets=1000)
    assert resolve_interval("second", EPOCH, after(3600)) == "second"
    with pytest.raises(ValueError):
        resolve_interval("fortnight")
    with pytest.raises(ValueError):
        resolve_interval("auto")


@pytest.fixture(scope="module")
def logs(spark):
    rows = [
        (1, after(0), "ERROR", "a"), (2, after(30), "error", "a"), (3, after(61), None, "b"), (4, after(125), "info", "a"),
        (5, after(130), "info", None), (6, after(299), "info", "c"), (7, after(-1), "info", "b"), (8, None, "info", "a"),
    ]
    return spark.createDataFrame(rows, "id int, ts timestamp, sev string, host string")


def counts(vol):
    return {(int((r["time"] - EPOCH).total_seconds()), r["level"]): r["count"] for r in vol.collect()}


def test_volume_by_severity_keeps_case_and_names_null(logs):
    assert counts(volume(logs, VIEW, "minute", by="severity")) == {
        (-60, "info"): 1, (0, "ERROR"): 1, (0, "error"): 1, (60, "unknown"): 1, (120, "info"): 2, (240, "info"): 1,
    }


def test_volume_without_breakdown_counts_every_timed_row(logs):
    assert sum(counts(volume(logs, VIEW, "minute")).values()) == 7
    assert set(counts(volume(logs, VIEW, "minute", time=(after(0), after(130))))) == {(0, ""), (60, ""), (120, "")}


def test_volume_needs_a_timestamp(logs):
    with pytest.raises(ValueError):
        volume(logs, LogView(), "minute")
    with pytest.raises(ValueError):
        volume(logs, LogView(timestamp="ts"), "minute", by="severity")


def test_null_takes_part_in_the_ranking_and_is_folded(spark):
    rows = [(after(i), None) for i in range(5)] + [(after(i), "x") for i in range(3)] + [(after(i), "y") for i in range(2)]
    df = spark.createDataFrame(rows, "ts timestamp, v string")
    view = LogView(timestamp="ts")
    assert counts(volume(df, view, "minute", by="v", top=2)) == {(0, "Other"): 7, (0, "x"): 3}


def test_ties_and_a_real_value_called_other(spark):
    rows = [(after(0), v) for v in ("b", "a", "Other", "Other", "c")]
    df = spark.createDataFrame(rows, "ts timestamp, v string")
    assert counts(volume(df, LogView(timestamp="ts"), "minute", by="v", top=2)) == {(0, "Other"): 4, (0, "a"): 1}


def test_zero_fill_stops_before_the_end(logs):
    vol = volume(logs, VIEW, "minute", by="severity", time=(after(0), after(300)))
    full = counts(zero_fill(vol, "minute", after(0), after(300)))
    assert {t for t, _ in full} == {0, 60, 120, 180, 240}
    assert {lv for _, lv in full} == {"ERROR", "error", "unknown", "info"}
    assert sum(full.values()) == 6
    assert full[(120, "info")] == 2 and full[(180, "info")] == 0
    given = counts(zero_fill(vol.limit(0), "minute", after(0), after(300), levels=["x"]))
    assert given == {(t, "x"): 0 for t in (0, 60, 120, 180, 240)}


def test_zero_fill_leaves_calendar_buckets(logs):
    vol = volume(logs, VIEW, "month")
    assert zero_fill(vol, "month", after(0), after(10**7)) is vol


def test_pivot_totals_and_ranks(logs):
    vol = volume(logs, VIEW, "minute", by="severity")
    wide = {r["time"]: r for r in pivot_volume(vol, ["ERROR", "info"]).collect()}
    assert (wide[after(120)]["info"], wide[after(120)]["ERROR"]) == (2, 0)
    totals = {(r["kind"], r["time"], r["level"]): r["total"] for r in volume_totals(vol).collect()}
    assert totals[("all", None, None)] == 7 and totals[("max", None, None)] == 2 and totals[("level", None, "info")] == 4
    ranks = [r.level for r in rank_levels(vol).orderBy("rank").collect()]
    assert ranks[0] == "info"


def test_severity_rank(spark):
    df = spark.createDataFrame([("Fatal",), ("WARN",), ("weird",), ("unknown",), ("critical",)], "s string")
    got = [r.s for r in df.orderBy(severity_rank(F.col("s"))).collect()]
    assert got == ["critical", "Fatal", "WARN", "unknown", "weird"]


def test_volume_vs_previous(logs):
    got = {r["time"]: (r["count"], r["previous"]) for r in volume_vs_previous(logs, VIEW, after(120), after(240), "minute").collect()}
    assert got == {after(120): (2, 2), after(180): (0, 1)}


def test_calendar_week_starts_on_monday_and_keeps_the_type(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-07 23:00:00' AS ts UNION ALL SELECT timestamp_ntz'2024-01-08 00:00:00'")
    vol = volume(df, LogView(timestamp="ts"), "week")
    assert dict(vol.dtypes)["time"] == "timestamp_ntz"
    assert sorted(r["time"].day for r in vol.collect()) == [1, 8]


def test_volume_sums_to_the_filtered_rows(logs):
    p = P.eq("sev", "info")
    n = sum(counts(volume(logs, VIEW, "minute", by="host", top=1, where=p)).values())
    assert n == 4


def test_one_scan_serves_ranking_and_counting(spark, plan):
    from loglattice.catalog.volumes import QUERIES

    text = plan(QUERIES["vol_field_top"](spark, "/root/testdata/sf0.001"))
    assert "ReusedExchange" in text and text.count("FileScan") == 1
