"""Rows around few anchors and first rows by any key, against the plain operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loglattice import LogView, P
from loglattice.operators.explore import page, surrounding_many
from loglattice.operators.near import first_rows, surrounding_few

T0 = dt.datetime(2024, 1, 1)
VIEW = LogView(timestamp="ts", service="svc", row_id=("id",))
SCHEMA = "id long, ts timestamp_ntz, svc string, v double, w string"


@pytest.fixture(scope="module")
def rows(spark):
    """A hot group, a sparse one, ties, an only row and a null group."""
    draw = random.Random(4)
    out = [(i, T0 + dt.timedelta(seconds=draw.randrange(3000)), "hot", draw.random(), draw.choice("ab")) for i in range(600)]
    out += [(1000 + i, T0 + dt.timedelta(days=9 * i), "sparse", None, "a") for i in range(12)]
    out += [(2000 + i, T0 + dt.timedelta(seconds=7), "ties", 0.5, "c") for i in range(9)]
    out += [(3000, T0 + dt.timedelta(days=400), "one", 2.0, None), (3001, T0, None, 1.0, "b"), (3002, T0 + dt.timedelta(seconds=1), None, 1.0, "b")]
    return spark.createDataFrame(out, SCHEMA).repartition(6)


ANCHORS = [
    (1, "hot", T0), (2, "hot", T0 + dt.timedelta(seconds=1500)), (3, "sparse", T0 + dt.timedelta(days=50)), (4, "ties", T0 + dt.timedelta(seconds=7)),
    (5, "ties", T0 + dt.timedelta(seconds=8)), (6, "ties", T0 + dt.timedelta(seconds=6)), (7, "one", T0), (8, None, T0), (9, "none", T0),
    (10, "sparse", T0 + dt.timedelta(days=800)), (11, "hot", T0 - dt.timedelta(days=2000)), (2, "hot", T0 + dt.timedelta(seconds=900)),
]


@pytest.mark.parametrize("n, reach, growth", [(3, 60, 16), (25, 1, 4), (1, 100_000_000, 2)])
def test_few_anchors_find_what_many_find(spark, rows, n, reach, growth):
    anchors = spark.createDataFrame(ANCHORS, "anchor_id long, svc string, ts timestamp_ntz")
    got = surrounding_few(rows, VIEW, anchors, n, reach_seconds=reach, growth=growth)
    want = surrounding_many(rows, VIEW, anchors, n)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_nothing_around_nothing(spark, rows):
    anchors = spark.createDataFrame(ANCHORS, "anchor_id long, svc string, ts timestamp_ntz")
    assert surrounding_few(rows, VIEW, anchors.limit(0)).count() == 0
    assert surrounding_few(rows.limit(0), VIEW, anchors).count() == 0
    late = anchors.withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    assert surrounding_few(rows, VIEW, late).count() == 0
    assert surrounding_few(rows, VIEW, anchors, 2, most=1).count() == surrounding_many(rows, VIEW, anchors, 2).count()


def test_only_near_rows_are_shuffled(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    rows.write.parquet(path)
    anchors = spark.createDataFrame(ANCHORS[1:2], "anchor_id long, svc string, ts timestamp_ntz")
    read = []
    import loglattice.operators.near as near

    real = near.written

    def spied(df, label):
        if label == "anchors-near":
            read.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, label)

    near.written = spied
    try:
        surrounding_few(spark.read.parquet(path), VIEW, anchors, 2).count()
    finally:
        near.written = real
    assert len(read) == 1  # enough in the first cells
    scan, shuffle = read[0].index("WindowGroupLimit"), read[0].index("Exchange hashpartitioning")
    assert read[0].index("BroadcastHashJoin") > shuffle > 0 and scan < read[0].index("BroadcastHashJoin") and "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in read[0]


@pytest.mark.parametrize("sort", ["v", "w", "svc"])
@pytest.mark.parametrize("offset, n", [(0, 5), (610, 50), (10_000, 5)])
@pytest.mark.parametrize("descending", [True, False])
def test_first_rows_equal_the_sorted_page(spark, rows, sort, offset, n, descending):
    want = [r.id for r in page(rows, VIEW, 0, offset + n, sort=sort, descending=descending).collect()][offset:]
    got = [r.id for r in first_rows(rows, VIEW, n, sort, descending, offset, sample_rows=100).collect()]
    assert got == want


def test_first_rows_of_a_search(spark, rows):
    where = P.eq("svc", "hot")
    got = first_rows(rows, VIEW, 7, "v", where=where, sample_rows=50).collect()
    assert [r.id for r in got] == [r.id for r in page(rows, VIEW, 0, 7, where=where, sort="v").collect()]
    assert first_rows(rows.limit(0), VIEW, 7, "v").count() == 0


def test_little_is_sorted(spark):
    df = spark.range(200_000).select(F.col("id"), F.hash("id").alias("v"), F.lit(T0).cast("timestamp_ntz").alias("ts")).repartition(20)
    got = first_rows(df, LogView(timestamp="ts", row_id=("id",)), 10, "v", offset=100_000, sample_rows=5000)
    sorted_ = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in sorted_
    assert [r.v for r in got.collect()] == sorted((r.v for r in df.select("v").collect()), reverse=True)[100_000:100_010]
