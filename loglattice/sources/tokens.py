"""A side table of the words in each file, so that a text search reads only files that can hold a match.

For each file of a table a Bloom filter of the elements of its words (see ``functions.tokens``) is
kept below ``path/_tokens``, cut into pieces of 32,768 bits; a filter has as many pieces as its words
need.  Filters are made for files that have none, so after an append only the new files are read, and a
file without a filter is always searched: results never depend on the side table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.functions.fields import Scope
from loglattice.functions.tokens import all_needed, asked, elements, holds, words
from loglattice.operators.predicates import Predicate, filter_logs
from loglattice.sources.live import live_files, live_schema, read_files, read_live
from loglattice.view import LogView

TOKENS = "_tokens"
#: bits of a piece: what Spark's bitmap aggregate holds
PIECE = 32_768
#: one word in about a hundred is taken to be in a file that does not have it
HASHES, BITS_PER_ELEMENT = 3, 12
#: with more files than these to read the whole table is read, so that the driver's list of files is bounded
MOST_FILES = 10_000


def _positions(element: Column, pieces: Column) -> list[Column]:
    """Bits of an element in a filter of ``pieces`` pieces: two halves of one hash, combined."""
    h = F.xxhash64(element)
    low, high = h.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(h, 33)
    return [(low + i * high) % (pieces * PIECE) for i in range(HASHES)]


def filters(spark: SparkSession, path: str) -> DataFrame | None:
    """(file, pieces, piece, bits); None if no file has a filter yet."""
    try:
        return spark.read.schema("file string, pieces long, piece long, bits binary").parquet(f"{path.rstrip('/')}/{TOKENS}/filters")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def index_tokens(spark: SparkSession, path: str, view: LogView, schema=None) -> int:
    """Make the filters of the live files that have none; returns how many files those were.

    A file without any word gets an empty filter.  Running it again, or beside an ingest, does no harm.
    """
    view.require("body")
    files, known = live_files(spark, path), filters(spark, path)
    if known is not None:
        files = files.join(known.select("file").distinct(), "file", "left_anti")
    n = files.count()
    if n == 0:
        return 0
    rows = read_files(spark, path, files, schema)
    body = Scope(rows, view).role("body")
    # words are made distinct first: there are far fewer of them than of their occurrences
    distinct = rows.select(F.col("__file").alias("file"), F.explode(words(body)).alias("word")).distinct()
    found = distinct.select("file", F.explode(elements(F.col("word"))).alias("element")).distinct()
    sizes = found.groupBy("file").agg(F.ceil(F.count("*") * BITS_PER_ELEMENT / PIECE).alias("pieces"))
    at = F.explode(F.array(*_positions(F.col("element"), F.col("pieces"))))
    places = found.join(sizes, "file").select("file", "pieces", at.alias("at"))
    places = places.select("file", "pieces", F.floor(F.col("at") / PIECE).alias("piece"), (F.col("at") % PIECE).alias("bit"))
    made = places.groupBy("file", "pieces", "piece").agg(F.bitmap_construct_agg("bit").alias("bits"))
    empty = files.select("file").join(sizes, "file", "left_anti")
    nothing = empty.select("file", F.lit(0).cast("long").alias("pieces"), F.lit(0).cast("long").alias("piece"), F.lit(None).cast("binary").alias("bits"))
    both = made.unionByName(nothing).repartitionByRange("file").sortWithinPartitions("file", "piece")
    both.write.mode("append").parquet(f"{path.rstrip('/')}/{TOKENS}/filters")
    return n


def _has_bit(at: Column) -> Column:
    """Whether this piece is the one that holds bit ``at`` and has it set."""
    byte = F.substr(F.col("bits"), F.floor(at % PIECE / 8).cast("int") + 1, F.lit(1))
    bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (at % 8).cast("int"))
    return F.coalesce((F.col("piece") == F.floor(at / PIECE)) & (bit == 1), F.lit(False))


def candidates(spark: SparkSession, path: str, view: LogView, *predicates: Predicate, schema=None) -> DataFrame:
    """The live files that can hold a row meeting the predicates, as far as their filters tell."""
    files, known = live_files(spark, path), filters(spark, path)
    scope = Scope(spark.createDataFrame([], live_schema(spark, path, schema)), view)
    formula = all_needed([p.needs(scope) for p in predicates])
    if known is None or formula is None:
        return files
    names = {e: f"__e{i}" for i, e in enumerate(asked(formula))}
    probes = [
        F.max(_has_bit(at)).alias(f"{name}_{i}")
        for element, name in names.items()
        for i, at in enumerate(_positions(F.lit(element), F.greatest(F.col("pieces"), F.lit(1))))
    ]
    seen = known.groupBy("file").agg(*probes)

    def has(element: str) -> Column:
        bits = [F.col(f"{names[element]}_{i}") for i in range(HASHES)]
        return bits[0] & bits[1] & bits[2]

    may = seen.select("file", holds(formula, has).alias("__may"))
    return files.join(may, "file", "left").filter(F.coalesce("__may", F.lit(True))).drop("__may")


def search_logs(spark: SparkSession, path: str, view: LogView, *predicates: Predicate, schema=None, most: int = MOST_FILES) -> DataFrame:
    """``filter_logs`` over the live table, reading only the files that can hold a match."""
    columns = live_schema(spark, path, schema)
    picked = candidates(spark, path, view, *predicates, schema=columns).select("path", "rewritten").limit(most + 1).collect()
    if len(picked) > most:
        df = read_live(spark, path, columns)
    else:
        df = read_files(spark, path, spark.createDataFrame(picked, "path string, rewritten boolean"), columns).drop("__file")
    return filter_logs(df, view, *predicates)
