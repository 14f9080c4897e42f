"""Rewriting a table's files beside readers and a running ingest.

Files that Spark wrote below ``path`` stay as they are.  A rewrite puts its rows below
``path/_rewritten/v=N`` and then, as its commit, one file of ``path/_changes/v=N`` that lists the files
it replaces; before that file is there nobody looks at the rows.  :func:`read_live` reads the files that no
commit replaces and the rows of committed rewrites.  A rewrite that failed is overwritten by the
next, and files that arrive meanwhile are not in its list, so they stay.  One rewrite runs at a time.

A file is known by its folder and name (``event_date=2024-01-01/part-…``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loglattice.functions.coarse import coarse_literal
from loglattice.functions.fields import Scope, quoted
from loglattice.functions.literals import bound_literal, naive_utc
from loglattice.plans.durable import filesystem, written
from loglattice.view import LogView

REWRITTEN, CHANGES = "_rewritten", "_changes"
#: size of a file that is worth no further packing
TARGET_BYTES = 128 << 20


def file_id(path: Column) -> Column:
    return F.concat_ws("/", F.slice(F.split(path, "/"), -2, 2))


def _listing(spark: SparkSession, path: str) -> DataFrame | None:
    """file, path, bytes below a folder, hidden folders left out; None if there is no such folder."""
    try:
        # only names and lengths are asked for, so no file is read
        reader = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").option("pathGlobFilter", "*.parquet")
        found = reader.load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return found.select(file_id(F.col("path")).alias("file"), "path", F.col("length").alias("bytes"))


def changes(spark: SparkSession, path: str) -> DataFrame | None:
    """(file, v): which commit replaces which file; None before the first commit."""
    try:
        # the wildcard leaves folders out in which a commit has only begun
        log = spark.read.schema("file string, v long").option("basePath", f"{path}/{CHANGES}").parquet(f"{path}/{CHANGES}/v=*/*.parquet")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return log.select("file", "v")


def live_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, path, bytes, rewritten) of the files that make up the table now."""
    path = path.rstrip("/")
    raw = _listing(spark, path).withColumn("rewritten", F.lit(False))
    log = changes(spark, path)
    if log is None:
        return raw
    rewritten = _listing(spark, f"{path}/{REWRITTEN}")
    if rewritten is not None:
        version = F.regexp_extract("path", f"/{REWRITTEN}/v=([0-9]+)/", 1).cast("long")
        done = rewritten.withColumn("v", version).join(log.select("v").distinct(), "v", "left_semi")
        raw = raw.unionByName(done.drop("v").withColumn("rewritten", F.lit(True)))
    return raw.join(log.filter(F.col("file").isNotNull()), "file", "left_anti")


def live_schema(spark: SparkSession, path: str, schema=None) -> T.StructType:
    """The table's columns: as given, else as one of its files says."""
    path = path.rstrip("/")
    if schema is not None:
        return spark.read.schema(schema).parquet(path).schema
    if changes(spark, path) is None:
        return spark.read.parquet(path).schema
    base = F.when(F.col("rewritten"), f"{path}/{REWRITTEN}").otherwise(path).alias("base")
    one = live_files(spark, path).select("path", base).limit(1).collect()
    found = spark.read.option("basePath", one[0].base).parquet(one[0].path) if one else spark.read.parquet(path)
    return T.StructType([f for f in found.schema if f.name != "v"])


def read_files(spark: SparkSession, path: str, files: DataFrame, schema=None) -> DataFrame:
    """The rows of the ``files`` (path, rewritten) of a table.

    Their paths go through the driver, as the file list of any Spark scan does.
    """
    path = path.rstrip("/")
    found = files.select("path", "rewritten").collect()
    if not isinstance(schema, T.StructType):
        schema = live_schema(spark, path, schema)
    rows = spark.createDataFrame([], schema)
    for rewritten, base in ((False, path), (True, f"{path}/{REWRITTEN}")):
        paths = [r["path"] for r in found if r["rewritten"] == rewritten]
        if paths:
            part = spark.read.schema(schema).option("basePath", base).parquet(*paths)
            part = part.select(*[quoted(f.name) for f in schema], file_id(F.col("_metadata.file_path")).alias("__file"))
            rows = part if "__file" not in rows.columns else rows.unionByName(part)
    return rows if "__file" in rows.columns else rows.withColumn("__file", F.lit(None).cast("string"))


def read_live(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The table as the last commit left it, and all that has been ingested since."""
    path = path.rstrip("/")
    if changes(spark, path) is None:
        return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    return read_files(spark, path, live_files(spark, path), schema).drop("__file")


def rewrite(spark: SparkSession, path: str, files: DataFrame, rows: DataFrame | None, view: LogView) -> int:
    """Replace ``files`` by ``rows`` in one commit; returns its number."""
    path = path.rstrip("/")
    log = changes(spark, path)
    last = None if log is None else log.agg(F.max("v")).collect()[0][0]
    version = 1 if last is None else last + 1
    if rows is not None:
        writer = rows.write.mode("overwrite")
        if view.partition_col:
            writer = writer.partitionBy(view.partition_col)
        writer.parquet(f"{path}/{REWRITTEN}/v={version}")
    # one file, which Spark renames into place: the commit
    files.select("file").coalesce(1).write.mode("overwrite").parquet(f"{path}/{CHANGES}/v={version}")
    return version


def _bins(files: DataFrame, target: int) -> DataFrame:
    """``files`` with the number of their bin: next fit by falling size, in each folder; bins of one file are left out.

    The window holds one row a file of the folder, no rows of the table.
    """
    small = files.filter(F.col("bytes") < target).withColumn("folder", F.substring_index("file", "/", 1))
    in_folder = Window.partitionBy("folder").orderBy(F.desc("bytes"), "file")
    before = F.coalesce(F.sum("bytes").over(in_folder.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    binned = small.withColumn("bin", F.floor((before + F.col("bytes") / 2) / target))
    return binned.withColumn("__n", F.count("*").over(Window.partitionBy("folder", "bin"))).filter("__n > 1").drop("__n")


def compact(spark: SparkSession, path: str, view: LogView, target: int = TARGET_BYTES, schema=None) -> int:
    """Put files smaller than ``target`` bytes together, folder by folder; returns how many files were replaced.

    Rows of a bin go to one task, which writes them by service and time, so a file has at most about
    ``target`` bytes.  Files that arrive meanwhile are left for the next run.  A run that fails changes nothing, and a run
    that finds nothing to put together makes no commit.
    """
    bins = written(_bins(live_files(spark, path), target), "compact")
    n = bins.count()
    if n == 0:
        return 0
    rows = read_files(spark, path, bins, schema)
    names = [c for c in rows.columns if c != "__file"]
    placed = rows.join(bins.select(F.col("file").alias("__file"), "folder", "bin"), "__file")
    order = [quoted(c) for c in (view.service, view.timestamp) if c]
    packed = placed.repartition("folder", "bin").sortWithinPartitions("folder", "bin", *order)
    rewrite(spark, path, bins, packed.select(*[quoted(c) for c in names]), view)
    return n


def expire_rows(spark: SparkSession, path: str, view: LogView, now, days: int = 30, schema=None) -> int:
    """Drop every row older than ``days`` before ``now``; returns how many files were replaced.

    Files of partitions that hold only expired rows are replaced by nothing, those of the partition in which
    the bound lies by their remaining rows.  Other partitions are not read.  Nothing expired: no commit.
    """
    if not view.partition_col:
        raise ValueError("the view names no partition column")
    cut = naive_utc(now) - dt.timedelta(days=days)
    rows = read_live(spark, path, schema)
    scope = Scope(rows, view)
    part = scope.get(view.partition_col)
    if isinstance(part.dtype, T.NullType):  # only rows without a time are left
        return 0
    bound = coarse_literal(cut, view.partition_by, part.dtype)
    expired = scope.role("timestamp") < bound_literal(cut, scope.role_type("timestamp"), "gte")
    value = F.substring_index(F.substring_index("file", "/", 1), "=", -1).try_cast(part.dtype)
    files = live_files(spark, path).withColumn("__value", value)
    gone = files.filter(F.col("__value") < bound)
    edge = rows.filter(part.column == bound)
    if edge.filter(expired).limit(1).count():
        gone = files.filter(F.col("__value") <= bound)
        rest = edge.filter(~F.coalesce(expired, F.lit(False)))
    else:
        rest = None
    gone = written(gone.select("file"), "expire")
    n = gone.count()
    if n:
        rewrite(spark, path, gone, rest, view)
    return n


def sweep(spark: SparkSession, path: str) -> int:
    """Delete the files that commits have replaced; returns how many.

    To be run when no reader still works on a listing from before the last commit.  Plain readers of the folder lose
    the replaced rows by it; :func:`read_live` does not change.
    """
    path = path.rstrip("/")
    log = changes(spark, path)
    if log is None:
        return 0
    listed = _listing(spark, path)
    rewritten = _listing(spark, f"{path}/{REWRITTEN}")
    listed = listed if rewritten is None else listed.unionByName(rewritten)
    n = 0
    for row in listed.join(log, "file", "left_semi").select("path").toLocalIterator():
        fs, name = filesystem(row["path"])
        fs.delete_file(name)
        n += 1
    return n
