"""Resampling of documents towards a target distribution, by hashed word n-grams.

A document's words and pairs of neighbouring words fall into ``BUCKETS`` buckets by their CRC.  How
much more often a bucket occurs in the target than in the corpus is its gain; a document's weight is
the mean gain of its features; Gumbel noise fixed by the id turns weights into a draw without
replacement: the highest scores are drawn.

Words come from an Aho-Corasick automaton over the distinct words of a group of texts, each with a
blank on both sides, so that a match is a whole word.  A word carries the CRC of its bytes, the CRC
of its bytes and a blank, and its length.  The CRC of a pair follows from those of its parts: CRCs
are linear, and appending n bytes to the left part is one table look-up for each of its four bytes.

Texts are scanned twice, once to count and once to score; between the scans only the counts of
buckets meet (map-side sums, at most BUCKETS rows a task).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loglattice.llm.common import shipped
from loglattice.plans.durable import written
from loglattice.plans.ordered import BLOCK, into_blocks

BUCKETS = 10_000
#: bytes of text that share one automaton: bounds what a worker holds, changes no result
GROUP_BYTES = 8_000_000
#: longer words are known by a stand-in in the automaton, which else holds a node for every byte
LONG_WORD = 200

_NUMBER = itemgetter(1)
#: lower-cases A-Z and makes every other ASCII character but a-z and 0-9 a blank
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256)
)


@lru_cache(maxsize=4096)
def _after(n: int) -> np.ndarray:
    """Tables [4, 256]: what a CRC's bytes become when ``n`` bytes of value zero follow."""
    basis = np.array([_zeros(1 << i, n) for i in range(32)], np.uint32)
    byte = np.arange(256, dtype=np.uint32)
    out = np.zeros((4, 256), np.uint32)
    for place in range(4):
        for bit in range(8):
            out[place] ^= np.where(byte >> bit & 1, basis[place * 8 + bit], 0).astype(np.uint32)
    return out


@lru_cache(maxsize=64)
def _doubled(power: int) -> tuple[int, ...]:
    """The images of the 32 bits of a CRC's register under 2**power bytes of zero."""
    if power == 0:
        return tuple(_one_byte(1 << i) for i in range(32))
    half = _doubled(power - 1)
    return tuple(_image(half, v) for v in half)


def _one_byte(register: int) -> int:
    # zlib inverts the register before and after; undone on both sides, a zero byte is a linear step
    return zlib.crc32(b"\x00", register ^ 0xFFFFFFFF) ^ 0xFFFFFFFF


def _image(basis: tuple[int, ...], register: int) -> int:
    out = 0
    while register:
        low = register & -register
        out ^= basis[low.bit_length() - 1]
        register ^= low
    return out


def _zeros(register: int, n: int) -> int:
    power = 0
    while n:
        if n & 1:
            register = _image(_doubled(power), register)
        n, power = n >> 1, power + 1
    return register


def joined_crc(left: np.ndarray, right: np.ndarray, right_length: np.ndarray) -> np.ndarray:
    """CRC-32 of left bytes followed by right bytes, from the CRCs of both and the length of the right."""
    lengths, place = np.unique(right_length, return_inverse=True)
    tables = np.stack([_after(int(n)) for n in lengths]) if len(lengths) else np.zeros((0, 4, 256), np.uint32)
    out = right.astype(np.uint32)
    for byte in range(4):
        out = out ^ tables[place, byte, (left >> np.uint32(8 * byte)) & np.uint32(255)]
    return out


#: stands between texts that are scanned together; no folded text holds it
_BREAK = b"!"


class Dictionary:
    """The distinct words of a folded text as an automaton that emits their numbers; 0 is the break between texts."""

    def __init__(self, folded: bytes):
        words = set(folded.split())
        words.discard(_BREAK)
        listed = [_BREAK, *words]
        self.long = {w: b"!%d" % i for i, w in enumerate(w for w in words if len(w) > LONG_WORD)}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        known = [self.long.get(w, w) for w in listed] if self.long else listed
        for number, word in enumerate(known):
            self.machine.add_word(f" {word.decode('latin-1')} ", number)
        self.machine.make_automaton()
        self.crc = np.fromiter(map(zlib.crc32, listed), np.uint32, len(listed))
        self.length = np.fromiter(map(len, listed), np.uint32, len(listed))
        one = np.ones(len(listed), np.uint32)
        self.spaced = joined_crc(self.crc, zlib.crc32(b" ") * one, one)

    def scan(self, folded: bytes) -> np.ndarray:
        """Numbers of the words of a text, in order."""
        if self.long:
            folded = b" ".join(self.long.get(w, w) for w in folded.split())
        text = f" {folded.decode('latin-1')} "
        return np.fromiter(map(_NUMBER, self.machine.iter(text)), np.int64)

    def features(self, numbers: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, bucket) of each word and of each two neighbours in one text, texts counted by the breaks."""
        text = np.cumsum(numbers == 0)
        word = numbers > 0
        both = word[1:] & word[:-1]
        left, right = numbers[:-1][both], numbers[1:][both]
        pairs = joined_crc(self.spaced[left], self.crc[right], self.length[right])
        crcs = np.concatenate([self.crc[numbers[word]], pairs])
        return np.concatenate([text[word], text[1:][both]]), crcs.astype(np.int64) % buckets


def _pieces(text: bytes) -> Iterator[bytes]:
    """A folded text in pieces of about GROUP_BYTES, cut at blanks."""
    at = 0
    while len(text) - at > GROUP_BYTES:
        cut = text.find(b" ", at + GROUP_BYTES)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def _groups(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Folded texts in groups of about GROUP_BYTES, with the place of the first; a longer text is a group."""
    first, group, size = 0, [], 0
    for place, text in enumerate(texts):
        folded = (text or b"").translate(_FOLD)
        if group and size + len(folded) > GROUP_BYTES:
            yield first, group
            first, group, size = place, [], 0
        group.append(folded)
        size += len(folded)
    if group:
        yield first, group


def _features(texts: list[bytes | None], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of texts, buckets of their features) of a group of texts at a time; a long text comes in several parts."""
    for first, group in _groups(texts):
        last = b""
        for piece in _pieces(group[0]) if len(group) == 1 else [b" ! ".join(group)]:
            book = Dictionary(last + b" " + piece)
            text, found = book.features(book.scan(last + b" " + piece), buckets)
            if last:  # the word before the cut has been counted with its piece
                text, found = text[1:], found[1:]
            yield first + text, found
            last = (piece.rsplit(None, 1) or [last])[-1]


def bucket_counts(texts: DataFrame, column: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found in _features(batch.column(0).to_pylist(), buckets):
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    raw = shipped(texts).select(F.col(column).cast("binary").alias("raw"))
    return raw.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, column: str = "text", target_column: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket: floor(1000 ln) of its smoothed share in the target by that in the source."""
    every = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    s = bucket_counts(source, column, buckets).withColumnRenamed("n", "s")
    t = bucket_counts(target, target_column, buckets).withColumnRenamed("n", "t")
    both = every.join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0, ["s", "t"])
    total = Window.partitionBy()  # over the buckets only
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    all_s, all_t = F.sum("s").over(total).cast("double"), F.sum("t").over(total).cast("double")
    ratio = ((t + 1) * (all_s + buckets)) / ((s + 1) * (all_t + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weigh(docs: DataFrame, table: DataFrame, id_column: str = "doc_id", column: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(id_column, n_features, weight) of every row; the gains (``buckets`` rows) go to every task."""
    gain = np.zeros(buckets, np.int64)
    for row in table.collect():  # `buckets` rows, whatever the corpus
        gain[row["bucket"]] = row["gain"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for places, found in _features(batch.column(1).to_pylist(), buckets):
                n += np.bincount(places, minlength=len(n))
                # sums of whole numbers below 2**53 are exact in doubles
                total += np.bincount(places, gain[found], minlength=len(n)).astype(np.int64)
            weight = total // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(weight, pa.int64())], [id_column, "n_features", "weight"]
            )

    kind = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField(id_column, kind), T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())])
    return shipped(docs).select(F.col(id_column), F.col(column).cast("binary")).mapInArrow(score, schema)


def noise(id_: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, fixed by the id: floor(-1000 ln(-ln u))."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def ranked(rows: DataFrame, score: str, id_column: str, draw: Column, out: str = "rank") -> DataFrame:
    """Ranks by falling score, ties to the smaller id, for the first ``draw`` of all rows (null beyond).

    ``draw`` says from ``n`` (the number of rows) how many.  Rows are cut into ranges by (score, id,
    reading task), so equal rows spread over ranges too; a rank is the rows of the ranges before plus
    the place in the range.
    """
    lean = rows.withColumn("__down", -F.col(score)).withColumn("__null", F.col(id_column).isNull())
    order = ["__down", "__null", id_column, "__task"]
    blocks = into_blocks(lean.withColumn("__task", F.monotonically_increasing_id()), [], order)
    sizes = blocks.groupBy(BLOCK).agg(F.count("*").alias("__rows"))
    every = Window.partitionBy()  # one row a range
    before = F.sum("__rows").over(Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(BLOCK, F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__rows").over(every).alias("n"))
    place = F.row_number().over(Window.partitionBy(BLOCK).orderBy(*order)) + F.col("__before")
    # one row a range: as many as there are shuffle partitions
    placed = blocks.join(F.broadcast(sizes), BLOCK).withColumn("__rank", place.cast("long"))
    return placed.withColumn(out, F.when(F.col("__rank") <= draw, F.col("__rank"))).drop(*order[:2], "__task", BLOCK, "__before", "__rank", "n")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS,
    id_column: str = "doc_id", column: str = "text", target_column: str = "text",
) -> DataFrame:
    """(id_column, n_features, weight, score, rank) of every document.

    Of the N documents of ``least_words`` words or more, ``floor(percent * N / 100)`` are drawn: those
    of the highest scores, ties to the smaller id (null ids last); the others have no rank.  A null or
    empty text has no features and weight 0.  Repeated rows are documents of their own: each is counted, scored
    and ranked (equal ones by an order fixed within the run).  Other columns are not read, so they cannot
    clash.  Without documents the result is empty; without target texts every target count is 0.
    """
    table = gains(docs, target, column, target_column, buckets)
    kind = docs.schema[id_column].dataType
    scored = weigh(docs, table, id_column, column, buckets).withColumn("score", F.col("weight") + noise(F.col(id_column), seed))
    scored = written(scored, "importance")
    enough = F.col("n_features") >= 2 * least_words - 1
    drawn = ranked(scored.filter(enough), "score", id_column, F.expr(f"n * {percent} div 100"))
    rest = scored.filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(F.col(id_column).cast(kind), "n_features", "weight", "score", "rank")
