"""Substring dedup: remove words of every window of ``window`` words whose sequence occurs more than once.

Runs of windows that share an anchor with another run (see minimizers) are the candidates.  Runs with one
anchor go to one shard, each distinct sequence of words once, with its number of occurrences.  A shard
builds a compressed FM-index of its sequences: the Burrows-Wheeler transform in a wavelet matrix of
packed bits with block counts.  The sequences are then streamed through it by backward search, all at
once: from an end, a match grows to the left as long as it occurs twice.  Where it stops, the shortest
prefix that already stops it gives the next end.  Intervals of at least ``window`` words are reported.

A window and its twin have the same anchor, so they meet in a shard, and a shard's documents are all that
can match there.  Words are compared by their 64-bit hashes, in sequences of at least the window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import shipped, whole
from loglattice.llm.minimizers import runs
from loglattice.plans.durable import written

ANCHOR = 8
#: Bytes of word hashes that a shard indexes, about.
SHARD_BYTES = 12 << 20
WORDS_AT_ONCE = 200_000


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


class Bits:
    """Packed bits with a count before each block of 64."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros(-(-(n + 1) // 64) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.blocks = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.blocks), dtype=np.int64)[:-1]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.blocks[block] & mask)


class FMIndex:
    """Backward search over symbols 0..size-1, of which 0 separates sequences."""

    def __init__(self, text: np.ndarray, longest: int):
        n = len(text)
        rank = text.astype(np.int64)
        reach = 1
        order = np.argsort(rank, kind="stable")
        while reach <= longest:  # prefix doubling; beyond a separator the order does not matter
            ahead = np.zeros(n, dtype=np.int64)
            ahead[: n - reach] = rank[reach:] + 1
            key = rank * (n + 2) + ahead
            order = np.argsort(key, kind="stable")
            sorted_ = key[order]
            number = np.cumsum(np.append(0, sorted_[1:] != sorted_[:-1]))
            rank = np.empty(n, dtype=np.int64)
            rank[order] = number
            if number[-1] == n - 1:
                break
            reach *= 2
        size = int(text.max()) + 1
        self.start = np.append(0, np.cumsum(np.bincount(text, minlength=size)))
        symbols = text[order - 1]
        self.levels = max(1, int(size - 1).bit_length())
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(np.uint8)
            self.bits.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        firsts = np.full(size, 0, dtype=np.int64)
        new = np.append(True, symbols[1:] != symbols[:-1])
        firsts[symbols[new]] = np.flatnonzero(new)
        self.offset = self.start[:-1] - firsts
        self.length = n

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with one more symbol in front."""
        for depth, (bits, zeros) in enumerate(zip(self.bits, self.zeros)):
            one = ((symbol >> (self.levels - 1 - depth)) & 1).astype(bool)
            a, b = bits.rank(low), bits.rank(high)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        shift = self.offset[symbol]
        return low + shift, high + shift

    def grow(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each end, the least start, not below ``begin``, from which text[start:end] occurs twice."""
        start = end.copy()
        live = np.flatnonzero(start > begin)
        low, high = np.zeros(len(live), dtype=np.int64), np.full(len(live), self.length, dtype=np.int64)
        while len(live):
            low, high = self.step(text[start[live] - 1], low, high)
            twice = high - low >= 2
            live, low, high = live[twice], low[twice], high[twice]
            start[live] -= 1
            more = start[live] > begin[live]
            live, low, high = live[more], low[more], high[more]
        return start


def repeated_intervals(sequences: list[np.ndarray], window: int) -> Iterator[tuple[int, int, int]]:
    """(sequence, start, end): maximal intervals, of at least ``window`` symbols, all of whose windows occur
    at least twice among the sequences."""
    values, symbols = np.unique(np.concatenate(sequences), return_inverse=True)
    sizes = np.array([len(s) for s in sequences])
    text = np.zeros(int(sizes.sum()) + len(sizes), dtype=np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    stop = begin + sizes
    place = np.ones(len(text), dtype=bool)
    place[stop] = False
    text[place] = symbols + 1
    index = FMIndex(text, int(sizes.max()))
    which, first, end = np.arange(len(sizes)), begin, stop
    while len(which):
        start = index.grow(text, first, end)
        found = end - start >= window
        yield from zip(which[found].tolist(), (start - first)[found].tolist(), (end - first)[found].tolist())
        left = start > first
        which, first, end, blocked = which[left], first[left], end[left], start[left] - 1
        # the shortest text from ``blocked`` on that does not occur twice: its end is in (low, high]
        low, high = blocked, end
        while (open_ := np.flatnonzero(high - low > 1)).size:
            middle = (low[open_] + high[open_]) // 2
            fits = index.grow(text, blocked[open_], middle) == blocked[open_]
            low[open_[fits]] = middle[fits]
            high[open_[~fits]] = middle[~fits]
        end = np.minimum(high - 1, blocked + window)
        go = end - first >= window
        which, first, end = which[go], first[go], end[go]


def _document_words(texts: list[bytes]) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    lo, held, n = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t.split())
        n += len(held[-1])
        if n >= WORDS_AT_ONCE:
            yield lo, i + 1, held
            lo, held, n = i + 1, [], 0
    if held:
        yield lo, len(texts), held


def candidate_runs(docs: DataFrame, window: int, k: int = ANCHOR) -> DataFrame:
    """(row, m, run) of ``docs`` (row, body): runs of windows whose minimum m occurs elsewhere; a run is its
    first word, and its number of windows less one."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            for lo, _, words in _document_words(texts):
                ends = np.cumsum([len(w) for w in words])
                r = runs(word_hashes([w for own in words for w in own]), ends, window, k)
                which = np.searchsorted(ends, r.first, side="right")
                packed = ((r.first - np.append(0, ends)[which]) << 16) | ((r.last - r.first) << 1) | r.within
                yield pa.RecordBatch.from_arrays([pa.array(r.minimum.view(np.int64)), pa.array(rows[which + lo]), pa.array(packed)], names=["m", "row", "run"])

    found = written(shipped(docs).select("row", "body").mapInArrow(find, "m long, row long, run long"), "fm-runs")
    often = found.groupBy("m").agg(F.count("*").alias("n")).where("n > 1").select("m")
    own = found.where(F.col("run").bitwiseAND(F.lit(1)) == 1)
    return found.join(often, "m", "left_semi").union(own).select("row", "m", F.shiftright("run", 1).alias("run")).distinct()


def occurrences(rows: DataFrame, window: int) -> DataFrame:
    """(m, h, row, first, n, content): each candidate run by its anchor m and the hash h of its words.

    Of equal runs in one batch the first has the words (as 64-bit hashes) and the number n of them all.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            name, texts, own = (b.column(c).to_pylist() for c in ("row", "body", "runs"))
            out: list[list] = []
            seen: dict[tuple[int, int], int] = {}
            for row, t, list_ in zip(name, texts, own):
                x = word_hashes(t.split())
                for r in list_:
                    first = r["run"] >> 15
                    content = x[first : first + (r["run"] & 0x7FFF) + window].tobytes()
                    h = xxhash.xxh64_intdigest(content) - (1 << 63)
                    at = seen.setdefault((r["m"], h), len(out))
                    out.append([r["m"], h, row, first, 0, content if at == len(out) else None])
                    out[at][4] += 1
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["m", "h", "row", "first", "n", "content"])

    return shipped(rows).select("row", "body", "runs").mapInArrow(cut, "m long, h long, row long, first long, n long, content binary")


def shard_intervals(contents: DataFrame, window: int, shards: int) -> DataFrame:
    """(m, h, spans): intervals of each distinct run of ``contents`` (m, h, n, content) that occur twice."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[tuple[int, int], int] = {}
        times: list[int] = []
        sequences: list[np.ndarray] = []
        for b in batches:
            for m, h, n, content in zip(*(b.column(c).to_pylist() for c in ("m", "h", "n", "content"))):
                at = number.setdefault((m, h), len(times))
                if at == len(times):
                    times.append(0)
                    sequences.append(np.frombuffer(content, dtype=np.uint64))
                times[at] += n
        if not sequences:
            return
        spans: list[list[tuple[int, int]]] = [[(0, len(s))] if t > 1 else [] for s, t in zip(sequences, times)]
        for i, start, end in repeated_intervals(sequences, window):
            if times[i] == 1:
                spans[i].append((start, end))
        out = [(m, h, [{"s": s, "e": e} for s, e in spans[i]]) for (m, h), i in number.items() if spans[i]]
        for lo in range(0, len(out), 20_000):
            kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[lo : lo + 20_000]), (pa.int64(), pa.int64(), kind))], names=["m", "h", "spans"])

    dealt = contents.select("m", "h", "n", "content").repartition(shards, "m")
    return shipped(dealt).mapInArrow(search, "m long, h long, spans array<struct<s:long,e:long>>")


def dedup(docs: DataFrame, window: int = 35) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as doc_id, n_words, n_removed, kept_sha256.

    Words are what white space of ASCII separates, unchanged.  Each word goes that a window of ``window``
    words covers whose sequence also starts anywhere else, in the same document or another; windows never
    cross documents.  Null texts have no words; texts below the window stay.  Rows that repeat doc_id and
    text are one document, with one result each.
    """
    row = F.xxhash64("doc_id", "text")
    all_ = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole("text").cast("binary").alias("body"))
    names = written(all_.select("row", F.unhex(F.sha2("body", 256)).alias("h")), "fm-names").distinct()
    copies = names.groupBy("h").agg(F.count("*").alias("copies"), F.min("row").alias("rep"))
    info = names.join(copies, "h").select("row", F.col("copies") > 1, F.col("rep") == F.col("row")).toDF("row", "copied", "rep")
    runs_ = candidate_runs(all_, window).groupBy("row").agg(F.collect_set(F.struct("m", "run")).alias("runs"))
    known = written(info.join(runs_, "row", "left"), "fm-info")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Word counts; what is left of texts that are settled; the body of the others and of partners."""
        for b in batches:
            out = []
            for i, (body, copied, open_) in enumerate(zip(*(b.column(c).to_pylist() for c in ("body", "copied", "open")))):
                words = body.split()
                gone = copied and len(words) >= window
                settled = gone or not open_
                digest = hashlib.sha256(b"" if gone else b" ".join(words)).hexdigest() if settled else None
                out.append((len(words), len(words) if gone else 0, digest))
            columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))] if out else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("runs"), *columns, b.column("body")], names=["row", "doc_id", "runs", "n_words", "n_removed", "kept_sha256", "body"])

    open_ = F.col("runs").isNotNull()
    joined = all_.join(known, "row").select("row", "doc_id", "body", "copied", F.when(open_ & F.col("rep"), F.col("runs")).alias("runs"), open_.alias("open"))
    schema = "row long, doc_id long, runs array<struct<m:long,run:long>>, n_words long, n_removed long, kept_sha256 string, body binary"
    settled = shipped(joined).mapInArrow(settle, schema)
    needed = F.col("runs").isNotNull() | F.col("kept_sha256").isNull()
    rows = written(settled.withColumn("body", F.when(needed, F.col("body"))), "fm-rows")

    found = written(occurrences(rows.where("runs is not null").dropDuplicates(["row"]), window), "fm-occurrences")
    contents = found.where("content is not null")
    size = contents.agg(F.sum(F.length("content"))).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    spans = written(shard_intervals(contents, window, shards), "fm-spans")
    placed = found.select("m", "h", "row", "first").join(spans, ["m", "h"])
    each = placed.select("row", "first", F.explode("spans").alias("s")).select("row", F.struct((F.col("first") + F.col("s.s")).alias("s"), (F.col("first") + F.col("s.e")).alias("e")).alias("s"))
    per_row = each.groupBy("row").agg(F.collect_set("s").alias("spans"))
    left = rows.where("kept_sha256 is null").select("row", "doc_id", "body").join(per_row, "row", "left")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, body, own in zip(b["doc_id"], b["body"], b["spans"]):
                words = body.split()
                stay = np.ones(len(words), dtype=bool)
                for s in own if own is not None else []:
                    stay[s["s"] : s["e"]] = False
                kept = b" ".join([words[i] for i in np.flatnonzero(stay).tolist()])
                out.append((doc_id, len(words), int(len(words) - stay.sum()), hashlib.sha256(kept).hexdigest()))
            got = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])
            got["doc_id"] = got["doc_id"].astype("Int64")
            yield got

    changed = shipped(left).select("doc_id", "body", "spans").mapInPandas(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return changed.union(rows.where("kept_sha256 is not null").select("doc_id", "n_words", "n_removed", "kept_sha256"))
