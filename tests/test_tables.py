import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from loglattice import LogView, P, filter_logs
from loglattice.operators.explore import detail
from loglattice.sources.logs import apply_retention, drop_expired, expired_partitions, read_logs, run_sql, write_logs

T0 = dt.datetime(2024, 1, 1)
VIEW = LogView(timestamp="ts", service="svc", row_id=("id",))


@pytest.fixture(scope="module")
def logs(spark):
    # two thirds of the rows fall on one day
    rows = [(i, T0 + dt.timedelta(minutes=i if i < 1200 else 7 * i), f"s{i % 5}") for i in range(1800)]
    return spark.createDataFrame(rows, "id int, ts timestamp, svc string")


@pytest.mark.parametrize("by", ["day", "hour"])
@pytest.mark.parametrize("ntz", [False, True])
@pytest.mark.parametrize("zones", [("UTC", "UTC"), ("America/New_York", "Asia/Tokyo")])
def test_pruned_equals_unpruned(spark, logs, tmp_path, by, ntz, zones):
    spark.conf.set("spark.sql.session.timeZone", zones[0])
    try:
        check_pruning(spark, logs, tmp_path, by, ntz, zones[1])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def check_pruning(spark, logs, tmp_path, by, ntz, reading_zone):
    df = logs.withColumn("ts", F.col("ts").cast("timestamp_ntz")) if ntz else logs
    df = df.filter("id < 1250") if by == "hour" else df
    path = str(tmp_path / by)
    view = write_logs(df, path, VIEW, by)
    spark.conf.set("spark.sql.session.timeZone", reading_zone)
    back = read_logs(spark, path)
    for lo, hi in (("2024-01-01 18:00:00", "2024-01-02 07:00:00"), ("2024-01-01 13:59:30", "2024-01-07 00:00:00"), (None, "2024-01-01 00:05:00")):
        got = filter_logs(back, view, P.time_range(lo, hi))
        want = filter_logs(df, VIEW, P.time_range(lo, hi))
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())
        text = got._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(event_date" in text and "PushedFilters: [IsNotNull(ts)" in text
    row = {"__timestamp": T0 + dt.timedelta(minutes=3)}
    assert ntz or detail(back, view, row).first().id == 3


def test_hot_day_is_split_and_files_are_sorted(spark, logs, tmp_path):
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_logs(logs, path, VIEW, bloom=("svc",))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    hot = [f for f in os.listdir(f"{path}/event_date=2024-01-01") if f.endswith(".parquet")]
    assert len(hot) > 1
    one = spark.read.parquet(f"{path}/event_date=2024-01-01/{hot[0]}").collect()
    assert one == sorted(one, key=lambda r: (r.svc, r.ts))
    assert read_logs(spark, path).count() == 1800


def test_rows_of_one_instant_are_split_between_files(spark, tmp_path):
    df = spark.range(0, 4000, numPartitions=8).select(
        F.col("id").cast("int"), F.lit(T0).cast("timestamp").alias("ts"), F.lit("one").alias("svc")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_logs(df, str(tmp_path / "t"), VIEW)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = [f for f in os.listdir(f"{tmp_path}/t/event_date=2024-01-01") if f.endswith(".parquet")]
    assert len(files) > 1
    assert read_logs(spark, str(tmp_path / "t")).count() == 4000


def test_append_keeps_earlier_rows(spark, logs, tmp_path):
    path = str(tmp_path / "t")
    write_logs(logs.filter("id < 10"), path, VIEW)
    write_logs(logs.filter("id >= 10 AND id < 20"), path, VIEW)
    assert read_logs(spark, path).count() == 20


def test_retention(spark, logs, tmp_path):
    path = str(tmp_path / "t")
    view = write_logs(logs, path, VIEW)
    back = read_logs(spark, path)
    now = "2024-02-01 12:00:00"
    kept = apply_retention(back, view, now)
    assert kept.count() == logs.filter("ts >= timestamp'2024-01-02 12:00:00'").count()
    assert [str(r.event_date) for r in expired_partitions(back, view, now).collect()] == ["2024-01-01"]


def test_run_sql_binds_the_range(spark, logs):
    q = "SELECT count(*) AS n FROM {logs} WHERE ts >= $__fromTime AND ts <= $__toTime"
    assert run_sql(spark, q, T0, T0 + dt.timedelta(minutes=9), logs=logs).first().n == 10
    assert run_sql(spark, "SELECT count(*) AS n FROM {logs}", logs=logs).first().n == 1800
    with pytest.raises(ValueError):
        run_sql(spark, q, T0, None, logs=logs)


def test_catalog_tables_and_other_formats(spark, logs, tmp_path):
    logs.filter("id < 3").createOrReplaceTempView("some_logs")
    assert read_logs(spark, "some_logs").count() == 3
    logs.filter("id < 3").write.json(str(tmp_path / "j"))
    assert read_logs(spark, str(tmp_path / "j"), format="json", schema=logs.schema).count() == 3


def test_expired_partitions_are_dropped_whole(spark, logs, tmp_path):
    path = str(tmp_path / "t")
    view = write_logs(logs, path, VIEW)
    days = sorted(x for x in os.listdir(path) if x.startswith("event_date="))
    gone = drop_expired(spark, path, view, T0 + dt.timedelta(days=8, hours=5), days=5)
    assert [f"event_date={d}" for d in gone] == [d for d in days if d < "event_date=2024-01-04"]
    assert sorted(x for x in os.listdir(path) if x.startswith("event_date=")) == [d for d in days if d >= "event_date=2024-01-04"]
    left = read_logs(spark, path)
    assert left.count() == logs.filter("ts >= '2024-01-04'").count()
    assert drop_expired(spark, path, view, T0 + dt.timedelta(days=8, hours=5), days=5) == []
