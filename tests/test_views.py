"""The same operators over tables that name their columns differently, or map none."""

import datetime as dt

import pytest

from loglattice import Filter, LogView, P, filter_logs
from loglattice.operators.explore import explore, grid, surrounding, with_row_key
from loglattice.operators.profile import top_values
from loglattice.operators.volume import volume

T0 = dt.datetime(2024, 5, 1)
ROWS = [(T0 + dt.timedelta(minutes=i), f"ERROR: Processing payment req-{i}" if i % 2 else f"INFO: cart req-{i}", "ERROR" if i % 2 else "INFO", f"svc-{i % 3}", f"{i % 4:032x}") for i in range(24)]
SHAPES = {
    "otel": ("Timestamp", "Body", "SeverityText", "ServiceName", "TraceId"),
    "common": ("timestamp", "message", "level", "service", "trace_id"),
    "abbreviated": ("ts", "msg", "lvl", "svc", "tid"),
    "opaque": ("col_a", "pesan", "f1", "svc_tag", "tr_ref"),
}


@pytest.fixture(params=list(SHAPES))
def shaped(request, spark):
    names = SHAPES[request.param]
    df = spark.createDataFrame(ROWS, ", ".join(f"`{n}` {t}" for n, t in zip(names, ["timestamp", *["string"] * 4])))
    view = LogView(**dict(zip(("timestamp", "body", "severity", "service", "trace_id"), names)))
    return df, view.with_(row_id=(names[4], names[0]))


def test_every_shape_gives_the_same_rows(shaped):
    df, view = shaped
    p = P.phrase("req-7") | P.term("cart") & P.eq(view.service, "svc-1")
    rows = explore(df, view, p, projection="grid").collect()
    assert [r["__body"].split("-")[-1] for r in rows] == ["22", "16", "10", "7", "4"]
    counts = {r.level: r["count"] for r in volume(df, view, "day", by="severity").collect()}
    assert counts == {"ERROR": 12, "INFO": 12}
    assert {r.value for r in top_values(df, view, "service").collect()} == {"svc-0", "svc-1", "svc-2"}
    assert len(surrounding(df, view, T0 + dt.timedelta(minutes=5), 3).collect()) == 3


def test_a_view_that_maps_nothing(spark):
    df = spark.createDataFrame(ROWS, "a timestamp, b string, c string, d string, e string")
    view = LogView()
    p = P.where((T0, T0), P.term("x") & ~P.phrase("y"), [Filter("c", "=", "INFO")])
    assert filter_logs(df, view, p).count() == 12
    assert grid(df, view).columns == df.columns
    assert explore(df, view, P.eq("c", "ERROR"), limit=5).count() == 5
    assert top_values(df, view, "c", sample=None).count() == 2
    for need_role in (lambda: volume(df, view, "day"), lambda: surrounding(df, view, T0), lambda: with_row_key(df, view)):
        with pytest.raises(ValueError):
            need_role()


def test_otel_preset():
    view = LogView.otel(partition_col="TimestampTime", partition_by="second")
    assert list(view.mapped_roles.values()) == ["Timestamp", "Body", "SeverityText", "TraceId", "ServiceName"]
    with pytest.raises(ValueError):
        LogView(partition_by="fortnight")


@pytest.mark.parametrize("unit, trunc", [("second", "second"), ("minute", "minute"), ("hour", "hour"), ("day", "day")])
def test_coarse_column_loses_no_row(spark, unit, trunc):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=617 * i, milliseconds=13 * i)) for i in range(600)], "id int, ts timestamp")
    df = df.withColumn("coarse", F.to_date("ts") if unit == "day" else F.date_trunc(trunc, "ts"))
    plain = LogView(timestamp="ts")
    coarse = plain.with_(partition_col="coarse", partition_by=unit)
    r = P.time_range(T0 + dt.timedelta(hours=20, milliseconds=500), T0 + dt.timedelta(hours=43, minutes=59, seconds=59))
    assert sorted(filter_logs(df, coarse, r).drop("coarse").collect()) == sorted(filter_logs(df, plain, r).drop("coarse").collect())
