"""Files of a table: filters of words, packing, rows that expire."""

import datetime as dt
import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from loglattice import LogView, P, filter_logs
from loglattice.functions.tokens import asked, needed, needed_by_wildcard
from loglattice.sources import live, tokens
from loglattice.sources.live import changes, compact, expire_rows, live_files, read_live, sweep
from loglattice.sources.logs import with_partition_column, write_logs
from loglattice.sources.tokens import candidates, index_tokens, search_logs
from loglattice.streaming.streams import ingest, stream_logs

VIEW = LogView(timestamp="ts", body="body", service="svc", row_id=("id",))
SCHEMA = "id long, ts timestamp_ntz, body string, svc string"
T0 = dt.datetime(2024, 1, 1)

BODIES = [
    "payment failed", "PAYMENT failed", "req-59 ok", "req-592 ok", "100% done", "100x done", "a_b", "axb", "it's fine", "what?", "", None,
    "abcſ tail", "ıce cream", "İce x", "Kelvin", "straße ab", "naïve café", "ȧb c", "one\ntwo\tthree", "x" * 5000 + " needle " + "y" * 5000,
]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """A file for each body, so that a file is chosen or not by that body alone."""
    path = str(tmp_path_factory.mktemp("bodies") / "logs")
    rows = [(i, T0 + dt.timedelta(hours=7 * i), b, "s") for i, b in enumerate(BODIES)]
    each = spark.createDataFrame(rows, SCHEMA).repartitionByRange(len(rows), "id")
    parted = with_partition_column(each, VIEW)
    parted.write.partitionBy("event_date").parquet(path)
    view = VIEW.with_(partition_col="event_date", partition_by="day")
    index_tokens(spark, path, view)
    return path, view, spark.createDataFrame(rows, SCHEMA)


SEARCHES = [
    P.term("ayme"), P.phrase("req-59"), P.term("req-59"), P.wildcard("pay*"), P.wildcard("*"), P.term("100%"), P.phrase("it's fine"),
    P.phrase("abcs"), P.term("abcſ"), P.phrase("ice"), P.term("ice"), P.phrase("İce"), P.term("İce"), P.phrase("kelvin"), P.term("KELV"),
    P.phrase("stra"), P.phrase("a"), P.term("af"), P.term("xxx needle y"), P.term("two\tthree"), P.eq("body", "it's fine", quoted=True),
    P.wildcard("req-*", "body"), P.phrase("needle") | P.phrase("what"), P.phrase("ok") & ~P.term("592"), P.eq("svc", "s"),
]


def test_search_finds_what_a_full_scan_finds(spark, table):
    path, view, rows = table
    for search in SEARCHES:
        want = sorted(r.id for r in filter_logs(rows, VIEW, search).select("id").collect())
        got = sorted(r.id for r in search_logs(spark, path, view, search).select("id").collect())
        assert got == want, search.label


@pytest.mark.parametrize("search, files", [
    (P.phrase("needle"), 1), (P.phrase("nowhere"), 0), (P.term("ayme"), 2), (P.phrase("needle") | P.phrase("what"), 2),
    (P.phrase("ok") & P.term("592"), 1), (P.term("ok") & ~P.phrase("ok"), len(BODIES)),
])
def test_only_the_chosen_files_are_read(spark, table, search, files):
    path, view, _ = table
    chosen = [r.path for r in candidates(spark, path, view, search).collect()]
    assert files <= len(chosen) <= files + 1  # a filter may be wrong about one
    read = search_logs(spark, path, view, search).inputFiles()
    assert sorted(os.path.basename(f) for f in read) == sorted(os.path.basename(f) for f in chosen)


def test_files_without_a_filter_are_searched(spark, table, tmp_path):
    path, view, _ = table
    path = shutil.copytree(path, str(tmp_path / "logs"))
    write_logs(spark.createDataFrame([(100, T0, "a needle", "s"), (101, T0, None, "s")], SCHEMA), path, VIEW)
    assert sorted(r.id for r in search_logs(spark, path, view, P.phrase("needle")).collect()) == [20, 100]
    made = index_tokens(spark, path, view)
    assert made >= 1 and index_tokens(spark, path, view) == 0
    assert sorted(r.id for r in search_logs(spark, path, view, P.phrase("needle")).collect()) == [20, 100]
    assert len(search_logs(spark, path, view, P.phrase("needle"), most=1).collect()) == 2  # more files than the driver may list


def test_a_filter_grows_with_its_words(spark, tmp_path):
    path = str(tmp_path / "many")
    rows = spark.range(60000).select("id", F.lit(T0).cast("timestamp_ntz").alias("ts"), F.concat(F.lit("w"), F.hex("id")).alias("body"), F.lit("s").alias("svc"))
    view = write_logs(rows.coalesce(1), path, VIEW, tokens=True)
    sizes = {r.file: r.pieces for r in tokens.filters(spark, path).collect()}
    assert all(n > 1 for n in sizes.values())
    absent = sum(candidates(spark, path, view, P.phrase(f"absent{i}")).count() for i in range(12))
    assert absent <= 3 * len(sizes)


def test_what_a_search_needs():
    assert asked(needed("Payment failed", True, True)) == ["t:payment", "t:failed"]
    assert asked(needed("x payment y", False, False)) == ["t:payment"]
    assert asked(needed("payme", False, False)) == ["g:pay", "g:aym", "g:yme"]
    assert needed("é", True, True) is None and needed("ab", False, False) is None
    assert asked(needed("éabcd e", True, True)) == ["g:abc", "g:bcd", "t:e"]
    assert asked(needed_by_wildcard("ab* cde *f")) == ["t:cde"]


# --- packing ------------------------------------------------------------------------------------


def _rows(df):
    return sorted((r.id, r.body) for r in df.collect())


def _small_files(spark, path, n=8, days=3):
    for i in range(n):
        rows = [(i * 10 + k, T0 + dt.timedelta(days=k % days, seconds=i), f"b{i}", "s") for k in range(6)]
        view = write_logs(spark.createDataFrame(rows, SCHEMA).coalesce(1), path, VIEW)
    return view


def test_packing_keeps_rows_and_leaves_fewer_files(spark, tmp_path):
    path = str(tmp_path / "t")
    view = _small_files(spark, path)
    before, n = _rows(read_live(spark, path)), live_files(spark, path).count()
    assert compact(spark, path, view) == n and _rows(read_live(spark, path)) == before
    assert live_files(spark, path).count() == 3
    assert compact(spark, path, view) == 0  # nothing left to put together: no commit
    assert changes(spark, path).select("v").distinct().count() == 1
    assert read_live(spark, path).filter(F.col("event_date") == F.lit("2024-01-02")).count() == 16


def test_bins_hold_about_the_target(spark, tmp_path):
    path = str(tmp_path / "t")
    view = _small_files(spark, path, n=10, days=1)
    size = live_files(spark, path).agg(F.max("bytes")).collect()[0][0]
    before = _rows(read_live(spark, path))
    compact(spark, path, view, target=5 * size)
    assert _rows(read_live(spark, path)) == before
    bins = live._bins(spark.createDataFrame([(f"d=1/{i}", 10 * (i % 5 + 1)) for i in range(40)], "file string, bytes long"), 100)
    for r in bins.groupBy("bin").agg(F.sum("bytes").alias("b")).collect():
        assert r.b <= 150


def test_a_run_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    view = _small_files(spark, path)
    before = _rows(read_live(spark, path))
    real = live.rewrite

    def broken(spark, path, files, rows, view):
        rows.write.mode("overwrite").partitionBy("event_date").parquet(f"{path}/_rewritten/v=1")
        os.makedirs(f"{path}/_changes/v=1/_temporary/0")
        raise RuntimeError("lost")

    monkeypatch.setattr(live, "rewrite", broken)
    with pytest.raises(RuntimeError):
        compact(spark, path, view)
    assert _rows(read_live(spark, path)) == before and changes(spark, path) is None
    monkeypatch.setattr(live, "rewrite", real)
    assert compact(spark, path, view) > 0 and _rows(read_live(spark, path)) == before


def test_packing_beside_an_ingest(spark, tmp_path):
    source, path, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    view = VIEW.with_(partition_col="event_date", partition_by="day")

    def arrive(first):
        for i in range(first, first + 4):
            spark.createDataFrame([(i, T0, f"b{i}", "s")], SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        q = ingest(stream_logs(spark, source, SCHEMA, batch_files=2), path, state, VIEW, trigger={"availableNow": True})
        q.awaitTermination()
        return [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]

    arrive(0)
    assert run() == [2, 2]  # the cap
    old = read_live(spark, path)
    assert compact(spark, path, view) == 4
    arrive(4)
    run()
    assert _rows(read_live(spark, path)) == [(i, f"b{i}") for i in range(8)]
    assert len(_rows(old)) == 4  # a reader from before still has its files
    assert compact(spark, path, view) == 5 and live_files(spark, path).count() == 1
    assert sweep(spark, path) == 9
    assert _rows(read_live(spark, path)) == [(i, f"b{i}") for i in range(8)]


def test_words_are_found_after_packing(spark, tmp_path):
    path = str(tmp_path / "t")
    view = _small_files(spark, path)
    index_tokens(spark, path, view)
    compact(spark, path, view)
    assert sorted(r.id for r in search_logs(spark, path, view, P.phrase("b7")).collect()) == list(range(70, 76))
    assert index_tokens(spark, path, view) == 3
    assert candidates(spark, path, view, P.phrase("nothing")).count() == 0


# --- rows that expire ---------------------------------------------------------------------------


@pytest.mark.parametrize("now", ["2024-01-31 00:00:00", "2024-02-01 00:00:05", "2024-02-20"])
def test_no_expired_row_is_left(spark, tmp_path, now):
    path = str(tmp_path / "t")
    view = _small_files(spark, path)
    write_logs(spark.createDataFrame([(999, None, "no time", "s")], SCHEMA), path, VIEW)
    cut = dt.datetime.fromisoformat(now) - dt.timedelta(days=30)
    want = sorted(r.id for r in read_live(spark, path).collect() if r.ts is None or r.ts >= cut)
    untouched = {r.file for r in live_files(spark, path).collect() if r.file.split("/")[0] > f"event_date={cut:%Y-%m-%d}"}
    expire_rows(spark, path, view, now)
    assert sorted(r.id for r in read_live(spark, path).collect()) == want
    assert untouched <= {r.file for r in live_files(spark, path).collect()}
    assert expire_rows(spark, path, view, now) == 0
    sweep(spark, path)
    assert sorted(r.id for r in read_live(spark, path).collect()) == want
    left = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(*glob.glob(f"{path}/event_date=*"), *glob.glob(f"{path}/_rewritten/*")) if want else None
    assert left is None or left.filter(F.col("ts") < F.lit(cut)).count() == 0
