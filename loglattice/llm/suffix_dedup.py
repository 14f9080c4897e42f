"""Suffix-array dedup: remove bytes of every repeated string of ``window`` bytes but its first occurrence.

Windows are handled in runs (see minimizers).  A run becomes a suffix: its text from the anchor on, then
what precedes the anchor.  Suffixes are put into one order over the cluster by a merge sort that knows
common prefixes: a task sorts what it has into runs, cuts them at splitters, and sends them front-coded
(length of the prefix shared with the entry before, and the rest); a receiving task combines the runs of
its range with a loser tree that carries the known prefix lengths along and never compares them again.
In the order, equal suffixes are neighbours, and their first is the earliest in the corpus; suffixes with
one anchor share a prefix as long as the anchor.

A run that equals an earlier one is removed whole.  Runs that share an anchor but differ go on, cut by a
longer anchor, until single windows are sorted; what shares no anchor is unique.  All comparisons are on
the bytes themselves.

The order breaks ties by position, and splitters hold positions, so a string that a third of the corpus
has is spread over as many ranges as its share.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import shipped, whole
from loglattice.llm.minimizers import runs
from loglattice.plans.durable import forget, written

#: Anchor sizes, from coarse to single windows; each step sorts only what the one before left open.
STEPS = (32, 72, 96, 100)
#: Entries that a task sorts at once; entries of a range of the order.
RUN_ENTRIES, RANGE_ENTRIES = 150_000, 100_000
#: Splitters are quantiles of so many sampled suffixes a range.
SAMPLED = 25
#: Bits of a position below the rank of a text among those with its doc_id.
PLACE = 40

Entry = tuple[bytes, int, int]


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    step = 8
    while a[known : known + step] == b[known : known + step]:
        known += step
        step *= 2
    while step > 1:
        step //= 2
        if a[known : known + step] == b[known : known + step]:
            known += step
    return known


def front_code(entries: list[Entry]) -> tuple[bytes, bytes, bytes, bytes, bytes]:
    """Prefix lengths shared with the entry before, sizes and bytes of the rests, documents and places."""
    shared, sizes, rests, before = [], [], [], b""
    for key, _, _ in entries:
        n = common_prefix(before, key)
        shared.append(n)
        sizes.append(len(key) - n)
        rests.append(key[n:])
        before = key
    numbers = lambda x, kind: np.array(x, dtype=kind).tobytes()
    return (
        numbers(shared, "<u2"), numbers(sizes, "<u2"), b"".join(rests),
        numbers([e[1] for e in entries], "<i8"), numbers([e[2] for e in entries], "<i8"),
    )


def front_decode(shared: bytes, sizes: bytes, rests: bytes, docs: bytes, places: bytes) -> Iterator[tuple[int, bytes, int, int]]:
    """(shared prefix length, key, document, place) of each entry of a run."""
    at, key = 0, b""
    columns = (np.frombuffer(x, k).tolist() for x, k in ((shared, "<u2"), (sizes, "<u2"), (docs, "<i8"), (places, "<i8")))
    for n, size, doc, place in zip(*columns):
        key = key[:n] + rests[at : at + size]
        at += size
        yield n, key, doc, place


def loser_tree(sources: list[Iterator[tuple[int, bytes, int, int]]]) -> Iterator[tuple[int, bytes, int, int]]:
    """Merges sorted runs; yields (prefix shared with the entry before, key, document, place).

    Each run keeps the length of the prefix its head shares with the entry that went out last.  Of two
    heads the one that shares more comes first, without a look at the bytes.  Only heads that share as
    much are compared, from there on, and the loser then knows what it shares with the winner.  The next
    head of the winning run knows its own from the front coding.
    """
    k = len(sources)
    heads: list[tuple[int, bytes, int, int] | None] = [next(s, None) for s in sources]
    shared = [0] * k
    key: list[bytes | None] = [h[1] if h else None for h in heads]

    def first(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        x, y = key[a], key[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        if x == y:
            n, less = len(x), heads[a][2:] <= heads[b][2:]
        else:
            n = common_prefix(x, y, shared[a])
            less = x[n : n + 1] < y[n : n + 1]
        if less:
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    size = 1
    while size < k:
        size *= 2
    heads += [None] * (size - k)
    key += [None] * (size - k)
    shared += [0] * (size - k)
    sources = [*sources, *[iter(())] * (size - k)]
    tree = [0] * size  # losers
    winners = list(range(size))
    level = size
    while level > 1:
        level //= 2
        nexts = []
        for i in range(level):
            w, tree[level + i] = first(winners[2 * i], winners[2 * i + 1])
            nexts.append(w)
        winners = nexts
    top = winners[0]
    while key[top] is not None:
        head = heads[top]
        yield shared[top], head[1], head[2], head[3]
        heads[top] = following = next(sources[top], None)
        if following is None:
            key[top] = None
        else:
            key[top], shared[top] = following[1], following[0]
        node = (top + size) // 2
        while node:
            top, tree[node] = first(top, tree[node])
            node //= 2


def suffix(content: bytes, anchor: int, within: bool) -> bytes:
    """A run's text from its anchor, what is before the anchor, and how long that is."""
    return content[anchor:] + content[:anchor] + struct.pack(">HB", anchor, within)


def content_of(key: bytes) -> tuple[bytes, bool]:
    anchor, within = struct.unpack(">HB", key[-3:])
    body = key[:-3]
    cut = len(body) - anchor
    return body[cut:] + body[:cut], bool(within)


def _batches(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def fragment_runs(texts: list[bytes], window: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For parts of ``texts``: text number, minimum, first start, windows - 1, anchor - first, within; of each run."""
    for lo, hi in _batches(texts):
        part = texts[lo:hi]
        ends = np.cumsum([len(t) for t in part])
        r = runs(np.frombuffer(b"".join(part), dtype=np.uint8), ends, window, k)
        which = np.searchsorted(ends, r.first, side="right")
        yield which + lo, r.minimum, r.first - np.append(0, ends)[which], r.last - r.first, r.anchor - r.first, r.within


def _entries_of_fragments(k: int, window: int):
    """Suffixes of fragments (doc, place, content)."""

    def make(docs: list[int], places: list[int], texts: list[bytes]) -> Iterator[Entry]:
        if k == window:
            for doc, place, t in zip(docs, places, texts):
                for i in range(len(t) - window + 1):
                    yield t[i : i + window] + b"\0\0\0", doc, place + i
            return
        for which, _, first, more, anchor, within in fragment_runs(texts, window, k):
            for i, p, m, a, s in zip(which.tolist(), first.tolist(), more.tolist(), anchor.tolist(), within.tolist()):
                yield suffix(texts[i][p : p + m + window], a, s), docs[i], places[i] + p

    return make


def _entries_of_documents(window: int):
    """Suffixes of the candidate runs of whole documents; a candidate is packed into one long."""

    def make(docs: list[int], places: list[int], texts: list[bytes], runs_: list[np.ndarray]) -> Iterator[Entry]:
        for doc, place, t, own in zip(docs, places, texts, runs_):
            for e in own.tolist():
                p = e >> 24
                yield suffix(t[p : p + ((e >> 16) & 255) + window], (e >> 8) & 255, bool(e & 1)), doc, place + p

    return make


def _spooled(entries: Iterator[Entry], splitters: list[Entry]) -> Iterator[tuple]:
    """Sorted runs of bounded size, cut at the splitters and front-coded."""
    while True:
        held = [e for _, e in zip(range(RUN_ENTRIES), entries)]
        if not held:
            return
        held.sort()
        edges = [0, *[bisect.bisect_right(held, s) for s in splitters], len(held)]
        for r, (lo, hi) in enumerate(zip(edges, edges[1:])):
            if hi > lo:
                yield (r, *front_code(held[lo:hi]))


def sort_suffixes(rows: DataFrame, make, columns: list[str], estimate: int, k: int, last: bool) -> DataFrame:
    """Sorts the suffixes that ``make`` gets out of ``rows`` and judges them.

    Returns (doc, place, length, content): repeated runs with null content, whose ``length`` bytes go;
    and, unless this is the ``last`` step, the earliest of each distinct run that another run shares its
    anchor with, with their content.  ``rows`` is a table, read twice (a sample, all).
    """
    spark = rows.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-estimate // RANGE_ENTRIES))
    want = ranges * SAMPLED
    rate = min(1.0, 4 * want / max(1, estimate))
    kind = "key binary, doc long, place long"

    def lists(b: pa.RecordBatch) -> list[list]:
        return [b.column(c).to_pylist() if c != "runs" else [np.array(x or [], dtype=np.int64) for x in b.column(c).to_pylist()] for c in columns]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [e for e in make(*lists(b)) if hash(e[1:]) % 4 == 0] or []
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in got], pa.binary()), pa.array([e[1] for e in got], pa.int64()), pa.array([e[2] for e in got], pa.int64())], names=["key", "doc", "place"])

    chosen = F.pmod(F.xxhash64("doc", "place", F.lit(9)), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1
    picked = shipped(rows).where(chosen).select(*columns).mapInArrow(sample, kind).limit(8 * want).collect()
    known = sorted({(bytes(r[0]), r[1], r[2]) for r in picked})
    splitters = [known[len(known) * i // ranges] for i in range(1, ranges)] if len(known) >= ranges else known
    splitters = sorted(set(splitters))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries() -> Iterator[Entry]:
            for b in batches:
                yield from make(*lists(b))

        for row in _spooled(entries(), splitters):
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *[pa.array([x], pa.binary()) for x in row[1:]]], names=["r", "shared", "sizes", "rests", "docs", "places"])

    def merge(t: pa.Table) -> pa.Table:
        r = t.column("r")[0].as_py()
        blobs = zip(*[t.column(c).to_pylist() for c in ("shared", "sizes", "rests", "docs", "places")])
        below, above = (splitters[r - 1] if r else None), r < len(splitters)
        out: list[tuple[int, int, int, bytes | None]] = []
        waiting: tuple | None = None  # first distinct run of its anchor so far
        before, before_at = (below[0], below[1:]) if below else (b"", None)
        for n, key, doc, place in loser_tree([front_decode(*b) for b in blobs]):
            if before_at == (doc, place) and key == before:
                continue
            if not out and waiting is None and before_at is not None and below and before is below[0]:
                n = common_prefix(before, key)
            size = len(key) - 3
            if n == len(key) and key == before:
                out.append((doc, place, size, None))
            elif not last:
                row = (doc, place, size, key)
                if n >= k and before:
                    if waiting:
                        out.append(waiting)
                        waiting = None
                    out.append(row)
                else:
                    if waiting and waiting[3][-1]:
                        out.append(waiting)
                    waiting = row
            before, before_at = key, (doc, place)
        if waiting and (above or waiting[3][-1]):
            out.append(waiting)
        names = ["doc", "place", "length", "content"]
        columns_ = [[o[i] for o in out] for i in range(3)] + [[o[3] and content_of(o[3])[0] for o in out]]
        return pa.table([pa.array(c, x) for c, x in zip(columns_, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=names)

    blobs = shipped(rows).select(*columns).mapInArrow(cut, "r int, shared binary, sizes binary, rests binary, docs binary, places binary")
    return blobs.groupBy("r").applyInArrow(merge, "doc long, place long, length long, content binary")


def candidate_runs(docs: DataFrame, window: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(row, run) of ``docs`` (row, body): runs of windows whose minimum occurs elsewhere, packed into longs; and the table they are read from."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            for which, least, first, more, anchor, within in fragment_runs(texts, window, k):
                packed = (first << 24) | (more << 16) | (anchor << 8) | within
                yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), pa.array(rows[which]), pa.array(packed)], names=["m", "row", "run"])

    found = written(shipped(docs).select("row", "body").mapInArrow(find, "m long, row long, run long"), "suffix-runs")
    often = found.groupBy("m").agg(F.count("*").alias("n")).where("n > 1").select("m")
    own = found.where(F.col("run").bitwiseAND(F.lit(1)) == 1)
    return found.join(often, "m", "left_semi").union(own).select("row", "run"), found


def repeated_spans(docs: DataFrame, window: int = 100, steps: tuple[int, ...] = STEPS) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` with what is known of each, and the spans that go.

    Rows: row, doc_id, doc, rank, n_bytes, copy (the text has an earlier copy), body (null where nothing can
    repeat or the text is a copy).  Spans: doc, rank, start, length.
    """
    text = whole("text").cast("binary")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    row = F.xxhash64("doc_id", "text")
    all_ = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), doc.alias("doc"), text.alias("body"))
    names = written(all_.select("row", "doc", F.unhex(F.sha2("body", 256)).alias("h")), "suffix-names").distinct()
    firsts = names.groupBy("h").agg(F.min(F.struct("doc", "row")).alias("f"))
    ranks = names.select("doc", "row").distinct().groupBy("doc").agg(F.array_sort(F.collect_set("row")).alias("rows"))
    ranked = ranks.select("doc", F.posexplode("rows").alias("rank", "row")).select("row", "rank")
    info = names.join(firsts, "h").select("row", (F.col("f.row") != F.col("row")).alias("copy")).join(ranked, "row")
    met, found = candidate_runs(all_, window, steps[0])
    runs_ = met.groupBy("row").agg(F.collect_set("run").alias("runs"))
    known = written(info.join(runs_, "row", "left"), "suffix-info")
    forget(found)
    joined = all_.join(known, "row")
    open_ = F.col("runs").isNotNull() & ~F.col("copy")
    digest = F.when(~open_, F.sha2(F.when(F.col("copy") & (F.octet_length("body") >= window), F.lit(b"").cast("binary")).otherwise(F.col("body")), 256))
    rows = joined.select(
        "row", "doc_id", "doc", "rank", "copy", F.octet_length("body").cast("long").alias("n_bytes"), digest.alias("kept_sha256"),
        F.when(open_, F.col("body")).alias("body"), F.when(open_, F.col("runs")).alias("runs"),
    )
    rows = written(rows, "suffix-rows")
    place = F.shiftleft(F.col("rank").cast("long"), PLACE)
    fragments = rows.where("body is not null").select("doc", place.alias("place"), F.col("body").alias("content"), "runs")
    forget(known)
    spans: DataFrame | None = None
    before = None
    for step, k in enumerate(steps):
        last = k == window
        if step == 0:
            estimate = fragments.agg(F.sum(F.size("runs"))).first()[0] or 0
            make, columns = _entries_of_documents(window), ["doc", "place", "content", "runs"]
        else:
            windows = fragments.agg(F.sum(F.length("content") - (window - 1))).first()[0] or 0
            estimate = windows * 2 // (window - k + 2)
            make, columns = _entries_of_fragments(k, window), ["doc", "place", "content"]
        judged = written(sort_suffixes(fragments, make, columns, estimate, k, last), "suffix-step")
        gone = written(judged.where("content is null").select("doc", "place", "length"), "suffix-gone")
        if before is not None:
            forget(before)  # the step before: its spans are written, its fragments are judged
        before = judged
        spans = gone if spans is None else spans.union(gone)
        fragments = judged.where("content is not null").select("doc", "place", "content")
    forget(before)
    rank = F.shiftrightunsigned("place", PLACE).cast("int")
    start = F.col("place").bitwiseAND(F.lit((1 << PLACE) - 1))
    return rows, spans.select("doc", rank.alias("rank"), start.alias("start"), "length")


def _without(body: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of a text without the spans, and the number of maximal runs that go."""
    kept, at, n, end = [], 0, 0, -1
    for lo, hi in sorted(spans):
        if lo > end:
            n += 1
            kept.append(body[at:lo])
        end = at = max(end, hi)
    kept.append(body[at:])
    return b"".join(kept), n


def dedup(docs: DataFrame, window: int = 100, texts: bool = False) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as doc_id, n_bytes, n_removed, n_spans, kept_sha256, and row.

    Each byte goes that a ``window``-byte string covers which also starts earlier: in a smaller doc_id, or
    before in the same document.  Null texts are empty; texts below the window stay; rows without doc_id
    come first; different texts with one doc_id follow each other in a fixed order, and rows that repeat
    both are one document, with one result each.  With ``texts``, only rows of which something goes, as
    row, kept (binary).
    """
    rows, spans = repeated_spans(docs, window)
    ends = spans.groupBy("doc", "rank").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    open_ = rows.where("body is not null").join(ends, ["doc", "rank"], "left")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row, doc_id, body, own in zip(b["row"], b["doc_id"], b["body"], b["spans"]):
                pairs = [(s["start"], s["start"] + s["length"]) for s in own] if own is not None else []
                kept, n = _without(body, pairs)
                out.append((row, doc_id, len(body), len(body) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept if texts else None))
            got = pd.DataFrame(out, columns=["row", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            got["doc_id"] = got["doc_id"].astype("Int64")
            yield got

    schema = "row long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    changed = shipped(open_).select("row", "doc_id", "body", "spans").mapInPandas(cut, schema)
    whole_copy = F.col("copy") & (F.col("n_bytes") >= window)
    if texts:
        empty = rows.where(F.col("body").isNull() & whole_copy).select("row", F.lit(b"").cast("binary").alias("kept"))
        return changed.where("n_removed > 0").select("row", "kept").union(empty).dropDuplicates(["row"])
    fixed = rows.where("body is null").select(
        "row", "doc_id", "n_bytes", F.when(whole_copy, F.col("n_bytes")).otherwise(F.lit(0)).alias("n_removed"),
        F.when(whole_copy, 1).otherwise(0).cast("long").alias("n_spans"), "kept_sha256",
    )
    return changed.drop("kept").unionByName(fixed)


def without_repeats(docs: DataFrame, window: int = 100) -> DataFrame:
    """``docs`` with all columns, where ``text`` has lost its repeated bytes and ``n_chars``, if it is there,
    counts what is left.  A code point that is cut in two goes whole; a text that is all repeated becomes
    empty; texts of which nothing goes are untouched."""
    kept = written(dedup(docs, window, texts=True), "suffix-kept")

    @F.pandas_udf("string")
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: b.decode("utf-8", "ignore"), na_action="ignore")

    key = "__row_of_text"
    new = shipped(kept).select(F.col("row").alias(key), decode("kept").alias("__kept"))
    out = docs.withColumn(key, F.xxhash64("doc_id", "text")).join(new, key, "left")
    out = out.withColumn("text", F.coalesce("__kept", "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__kept").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
