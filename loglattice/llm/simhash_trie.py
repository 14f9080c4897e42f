"""SimHash near-duplicates by a self-join of binary tries.

Signatures that differ in at most ``radius`` bits of a piece agree on one of ``radius + 1`` blocks of it.
For each block there is a trie of the pieces rotated so that the block comes first.  Its upper levels,
where no bit may differ, are walked by Spark's shuffle: equal blocks meet.  Below, a task walks pairs of
trie nodes level by level, adds up the bits in which their paths differ and prunes a pair as soon as it
exceeds the radius.  Nodes are ranges of the sorted pieces, and a level of all node pairs is one step of
array operations.

What leaves a task is one spanning link per signature and block, not the pairs of a group; Spark joins
the links into components.  A block that too many signatures share is cut into cells, see ``_cells``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loglattice.llm.common import shipped, whole
from loglattice.llm.components import components
from loglattice.plans.durable import forget, written

#: Signatures of one block value that a task joins at most; more are cut into cells.
CELL = 50_000
#: Rows of a partition that holds many small blocks.
PARTITION_ROWS = 400_000
#: Node pairs, or pairs of signatures, held at once.
CHUNK = 1_000_000


def shingle_hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle, repeats included; fewer words make one shingle, none make none."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, dtype=np.uint64)
    runs = zip(*[w[i:] for i in range(words)]) if len(w) >= words else [w]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.array([digest(join(r), seed) for r in runs], dtype=np.uint64)


#: Odd multipliers that make further 64-bit words of votes out of one hash; fixed values.
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def vote_words(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` unsigned 64-bit words; bit b of one is 1 if over half of the hashes have it set."""
    if not len(hashes):
        return np.zeros(words, dtype=np.uint64)
    rows = [hashes]
    for m in _MIX[: words - 1]:
        x = hashes * np.uint64(m)
        rows.append((x ^ (x >> np.uint64(29))) * np.uint64(_MIX[0]))
    votes = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.stack([r[at : at + 4096] for r in rows], axis=1)
        votes += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)


@dataclass(frozen=True)
class Plan:
    """How signatures are compared.

    A signature has ``words`` longs.  ``tables`` pieces of ``bits`` bits are drawn from it (the signature
    itself if its size is the piece's).  Pairs within ``radius`` on a piece are candidates; ``sure`` bits
    on the whole signature make a link, up to ``maybe`` bits make a pair that has to be looked at.
    """

    words: int = 1
    bits: int = 64
    tables: int = 1
    radius: int = 3
    sure: int = 3
    maybe: int = 3

    @property
    def blocks(self) -> list[tuple[int, int]]:
        """First bit, from the top, and size of each block of a piece."""
        n = self.radius + 1
        edges = [self.bits * i // n for i in range(n + 1)]
        return [(edges[i], edges[i + 1] - edges[i]) for i in range(n)]

    def pieces(self, signatures: np.ndarray) -> np.ndarray:
        """(rows, tables) pieces of (rows, words) signatures."""
        if self.bits == 64 * self.words:
            return signatures
        bits = np.unpackbits(signatures.view(np.uint8), axis=1, bitorder="little")
        draw = np.random.default_rng(11)
        out = np.empty((len(signatures), self.tables), dtype=np.uint64)
        order: list[int] = []
        for t in range(self.tables):
            if len(order) < self.bits:
                order += draw.permutation(64 * self.words).tolist()
            own, order = order[: self.bits], order[self.bits :]
            padded = np.zeros((len(signatures), 64), dtype=np.uint8)
            padded[:, : self.bits] = bits[:, own]
            out[:, t] = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)[:, 0]
        return out


def signatures(docs: DataFrame, shingle: int, plan: Plan, distinct: bool = False) -> DataFrame:
    """(doc_id, sig, pieces) of every whole text of ``docs`` (doc_id, text), as arrays of longs.

    Every shingle votes as often as it occurs, or once where ``distinct``.
    """
    voters = np.unique if distinct else np.asarray

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sig = np.stack([vote_words(voters(shingle_hashes(t, shingle)), plan.words) for t in b["text"]]) if len(b) else np.empty((0, plan.words), np.uint64)
            rows = {"doc_id": b["doc_id"].astype("Int64"), "sig": list(sig.view(np.int64)), "pieces": list(plan.pieces(sig).view(np.int64))}
            yield pd.DataFrame(rows)

    rows = shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    return rows.mapInPandas(run, "doc_id long, sig array<long>, pieces array<long>")


class Tries:
    """The tries under all equal prefixes of ``depth`` bits of sorted distinct values of ``bits`` bits."""

    def __init__(self, values: np.ndarray, bits: int, depth: int):
        self.values, self.bits, self.depth = values, bits, depth
        n = len(values)
        diff = values[1:] ^ values[:-1]
        self.first: list[np.ndarray] = []
        self.size: list[np.ndarray] = []
        self.child: list[tuple[np.ndarray, np.ndarray]] = []
        cut = np.ones(n, dtype=bool)
        names = None
        for d in range(depth, bits + 1):
            cut[1:] = (diff >> np.uint64(bits - d)) != 0 if d else False
            first = np.flatnonzero(cut).astype(np.int32)
            own = np.cumsum(cut, dtype=np.int32) - 1
            if names is not None:
                top = self.first[-1]
                one = ((values[top] >> np.uint64(bits - d)) & np.uint64(1)).astype(bool)
                low = own[top]
                two = np.diff(np.append(low, len(first))) > 1
                self.child.append((np.where(one, -1, low).astype(np.int32), np.where(one, low, np.where(two, low + 1, -1)).astype(np.int32)))
            self.first.append(first)
            self.size.append(np.diff(np.append(first, n)).astype(np.int32))
            names = own

    def self_join(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of value numbers (i, j), i and j alike where a value meets itself, within ``radius`` bits."""
        if not len(self.values):
            return
        roots = np.arange(len(self.first[0]), dtype=np.int32)
        stack = [(0, roots, roots, np.zeros(len(roots), dtype=np.int8))]
        while stack:
            level, a, b, bad = stack.pop()
            if len(a) > CHUNK:
                half = len(a) // 2
                stack += [(level, a[:half], b[:half], bad[:half]), (level, a[half:], b[half:], bad[half:])]
                continue
            alone = (self.size[level][a] == 1) & (self.size[level][b] == 1)
            if alone.any():
                i, j = self.first[level][a[alone]], self.first[level][b[alone]]
                near = np.bitwise_count(self.values[i] ^ self.values[j]) <= radius
                yield i[near], j[near]
                a, b, bad = a[~alone], b[~alone], bad[~alone]
            if not len(a):
                continue
            zero, one = self.child[level]
            az, ao, bz, bo = zero[a], one[a], zero[b], one[b]
            same = a == b
            parts = [(az, bz, bad), (ao, bo, bad), (az, bo, bad + 1), (np.where(same, -1, ao), bz, bad + 1)]
            na, nb, nbad = (np.concatenate(x) for x in zip(*parts))
            go = (na >= 0) & (nb >= 0) & (nbad <= radius)
            if go.any():
                stack.append((level + 1, na[go], nb[go], nbad[go].astype(np.int8)))


def _rows_of(i: np.ndarray, j: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of value pairs, where value v has rows start[v] to start[v + 1]."""
    na, nb = start[i + 1] - start[i], start[j + 1] - start[j]
    if na.max(initial=1) == 1 and nb.max(initial=1) == 1:
        differ = i != j
        yield start[i[differ]], start[j[differ]]
        return
    for k in range(len(i)):
        if na[k] * nb[k] == 1:
            continue
        rows_b = np.arange(start[j[k]], start[j[k] + 1])
        step = max(1, CHUNK // len(rows_b))
        for at in range(start[i[k]], start[i[k] + 1], step):
            rows_a = np.arange(at, min(at + step, start[i[k] + 1]))
            a, b = np.repeat(rows_a, len(rows_b)), np.tile(rows_b, len(rows_a))
            if i[k] == j[k]:
                a, b = a[a < b], b[a < b]
            yield a, b
    plain = (na == 1) & (nb == 1) & (i != j)
    if plain.any():
        yield start[i[plain]], start[j[plain]]


def _roots(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if (up == label).all():
            return label
        label = up


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least row number of each component, after the links (a, b)."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        label = _roots(label)
    return label


def _join_segment(ids: np.ndarray, sig: np.ndarray, piece: np.ndarray, plan: Plan, block: int):
    """Links of one table and block that span the sure components, and links that span the likely ones."""
    offset, size = plan.blocks[block]
    bits = np.uint64(plan.bits)
    mask = np.uint64((1 << plan.bits) - 1)
    turned = piece if offset == 0 else ((piece << np.uint64(offset)) | (piece >> (bits - np.uint64(offset)))) & mask
    order = np.lexsort((ids, turned))
    ids, sig, turned = ids[order], sig[order], turned[order]
    values, start = np.unique(turned, return_index=True)
    start = np.append(start, len(turned))
    label = np.arange(len(ids))
    likely = np.arange(len(ids))
    for i, j in Tries(values, plan.bits, size).self_join(plan.radius):
        for a, b in _rows_of(i, j, start):
            if not len(a):
                continue
            far = np.bitwise_count(sig[a] ^ sig[b]).sum(axis=1)
            sure = far <= plan.sure
            label = _union(label, a[sure], b[sure])
            likely = _union(likely, a[far <= plan.maybe], b[far <= plan.maybe])
    out = []
    for found in (label, likely):
        linked = np.flatnonzero(found != np.arange(len(ids)))
        out.append(np.stack([ids[linked], ids[found[linked]]], axis=1) if len(linked) else np.empty((0, 2), np.int64))
    return tuple(out)


def _cells(rows: DataFrame, size: int) -> DataFrame:
    """Cuts what shares a block value into cells of at most about ``size`` rows.

    n rows become s = 2n / size parts; each pair of parts, and so each pair of rows, meets in the cell of
    both.  Where no block value is that large, rows stay as they are.
    """
    count = rows.groupBy("g", "blk").agg(F.count("*").alias("n")).where(F.col("n") > size)
    hot = written(count.select("g", "blk", F.ceil(F.col("n") * 2 / size).cast("int").alias("s")), "hot-blocks")
    if hot.isEmpty():
        return rows.withColumn("cell", F.lit(0))
    joined = rows.join(hot, ["g", "blk"], "left").withColumn("s", F.coalesce("s", F.lit(1)))
    part = F.pmod(F.xxhash64("id", F.lit(3)), F.col("s")).cast("int")
    other = F.sequence(F.lit(0), F.col("s") - 1)
    return joined.withColumn("o", F.explode(other)).withColumn(
        "cell", F.least(part, F.col("o")) * F.col("s") + F.greatest(part, F.col("o"))
    ).drop("s", "o")


def near_links(sigs: DataFrame, plan: Plan, cell: int = CELL) -> DataFrame:
    """(a, b, sure) of ids: links that span what is surely near, and links that span what is likely near.

    ``sigs`` is a table of distinct ids with (id, sig, pieces); it is read twice.
    """
    blocks = plan.blocks
    exploded = sigs.select("id", "sig", F.posexplode("pieces").alias("t", "piece"))
    keys = [
        F.struct(F.lit(c).alias("c"), F.shiftrightunsigned("piece", plan.bits - at - size).bitwiseAND(F.lit((1 << size) - 1)).cast("long").alias("blk"))
        for c, (at, size) in enumerate(blocks)
    ]
    rows = exploded.select("id", "sig", "t", "piece", F.explode(F.array(*keys)).alias("k"))
    rows = rows.select((F.col("t") * len(blocks) + F.col("k.c")).alias("g"), "k.blk", "id", "piece", "sig")
    rows = _cells(rows, cell)
    n = sigs.count() * plan.tables * len(blocks)
    parts = max(int(sigs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // PARTITION_ROWS))
    words = [F.col("sig")[w].alias(f"s{w}") for w in range(plan.words)]
    dealt = rows.select("g", "blk", "cell", "id", "piece", *words).repartition(parts, "g", "blk", "cell").select("g", "cell", "id", "piece", *[f"s{w}" for w in range(plan.words)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        del got
        g, cells, ids = (t.column(c).to_numpy() for c in ("g", "cell", "id"))
        piece = t.column("piece").to_numpy().view(np.uint64)
        sig = np.stack([t.column(f"s{w}").to_numpy() for w in range(plan.words)], axis=1).view(np.uint64)
        order = np.lexsort((cells, g))
        edge = np.flatnonzero(np.append(True, (np.diff(g[order]) != 0) | (np.diff(cells[order]) != 0)))
        for lo, hi in zip(edge, np.append(edge[1:], len(order))):
            own = order[lo:hi]
            for pairs, sure in zip(_join_segment(ids[own], sig[own], piece[own], plan, int(g[own[0]]) % len(blocks)), (True, False)):
                for at in range(0, len(pairs), 100_000):
                    p = pairs[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(np.full(len(p), sure))], names=["a", "b", "sure"])

    return shipped(dealt).mapInArrow(run, "a long, b long, sure boolean")


#: 64 bits, linked at 3 or fewer differing ones.
EXACT = Plan()
#: 256 bits of 5-word shingles; 24 pieces of 32 bits find most pairs of similarity 0.8, which differ in about 39 bits,
#: and fewer of very short texts.  Up to 22 bits a pair is probably similar, up to 54 it may be.
SIMILAR = Plan(words=4, bits=32, tables=24, radius=2, sure=22, maybe=54)


def near_components(docs: DataFrame, shingle: int = 3, plan: Plan = EXACT) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as doc_id, fingerprint, component_id, n_links.

    Fingerprints link at ``plan.radius`` or fewer differing bits; component_id is the smallest doc_id that
    links reach, itself included.  Null and empty texts have fingerprint zero, which links like any
    other.  Repeated rows stay; rows without doc_id get the component of their fingerprint (null if no
    row of it has an id).  n_links counts the other distinct fingerprints of the component.
    """
    prints = written(signatures(docs, shingle, plan).select("doc_id", F.col("sig")[0].alias("f")), "simhash")
    one = written(prints.groupBy("f").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    links = near_links(one.select(F.col("f").alias("id"), F.array("f").alias("sig"), F.array("f").alias("pieces")), plan)
    linked = components(links, "a", "b")
    rooted = one.join(linked, one["f"] == linked["node"], "left").select("f", "first", F.coalesce("component", "f").alias("root"))
    classes = rooted.groupBy("root").agg(F.min("first").alias("component_id"), (F.count("*") - 1).alias("n_links"))
    named = rooted.join(classes, "root").select("f", "component_id", "n_links")
    return prints.join(named, "f").select(
        "doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id", "n_links"
    )


#: Ids that are sent to every executor (16 bytes each there); more of them are joined by a shuffle.
FEW_IDS = 200_000


def _kept(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` with (left_semi) or without (left_anti) the written ``ids``; wide rows move only if the ids are many."""
    return rows.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, key, how)


#: Texts whose shingle sets a worker holds at once.
AT_ONCE = 200


def _shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), AT_ONCE):
                some = b.iloc[at : at + AT_ONCE]
                sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in some["text"]]
                yield pd.DataFrame({"doc_id": some["doc_id"], "set": sets})

    return shipped(docs).select("doc_id", "text").mapInPandas(distinct, "doc_id long, set array<long>")


#: Bits of the longer sketches that pairs are compared by before their sets are, short ones first; each divides the next.
LONG_PARITY = (1024, 8192)
#: Bytes of sketches that are moved at once, as each pair takes those of its texts along.
MOVED = 2 << 30


def _parity(own: np.ndarray, bits: int) -> bytes:
    """The parity of the number of hashes in each of ``bits`` buckets: sets differ in at least as many hashes as these in bits."""
    return np.packbits(np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def _folded(sketch: bytes, bits: int) -> bytes:
    """The parity of the same hashes in fewer buckets."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint8).reshape(-1, bits // 8), axis=0).tobytes()


def _apart(a: bytes, b: bytes) -> int:
    return int.from_bytes(a).__xor__(int.from_bytes(b)).bit_count()


def _may_be_similar(pairs: DataFrame, docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The written ``pairs`` that sizes and long sketches do not rule out.

    Pairs meet their sketches in parts of about ``MOVED`` bytes, one after the other, so that what is on
    disk at once does not grow with the number of pairs.
    """

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), AT_ONCE):
                some = b.iloc[at : at + AT_ONCE]
                made = [(len(s), _parity(s, LONG_PARITY[-1])) for s in (np.unique(shingle_hashes(t, shingle)) for t in some["text"])]
                rows = {"doc_id": some["doc_id"], "size": [n for n, _ in made]}
                yield pd.DataFrame(rows | {f"sketch{n}": [_folded(p, n) for _, p in made] for n in LONG_PARITY})

    @F.pandas_udf("int")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_apart(x, y) for x, y in zip(a, b)], dtype="int32")

    schema = "doc_id long, size int, " + ", ".join(f"sketch{n} binary" for n in LONG_PARITY)
    known = written(shipped(docs).select("doc_id", "text").mapInPandas(sketch, schema), "simhash-sketches")
    total = F.col("size_a") + F.col("size_b")
    fits = F.least("size_a", "size_b") >= F.lit(similarity) * F.greatest("size_a", "size_b") - 1e-9
    left = pairs
    for bits in LONG_PARITY:
        of_a, of_b = (known.select(F.col("doc_id").alias(c), F.col("size").alias(f"size_{c}"), F.col(f"sketch{bits}").alias(f"sketch_{c}")) for c in ("a", "b"))
        parts = max(1, -(-left.count() * bits // 8 // MOVED))
        found = []
        for part in range(parts):
            some = left.where(F.pmod(F.xxhash64("a", "b", F.lit(13)), F.lit(parts)) == part) if parts > 1 else left
            met = some.join(of_a, "a").join(of_b, "b").where(fits)
            near = apart("sketch_a", "sketch_b") <= total * F.lit((1 - similarity) / (1 + similarity)) + 1e-9
            found.append(written(met.where(near).select("a", "b"), "simhash-maybe"))
        before, left = left, found[0] if parts == 1 else written(reduce(DataFrame.union, found), "simhash-maybe")
        if before is not pairs:
            forget(before)
        if parts > 1:
            forget(*found)
    forget(known)
    return left


def _mentioned(pairs: DataFrame) -> DataFrame:
    return written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "simhash-ids")


def _similar(pairs: DataFrame, docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Those of the ``pairs`` (a, b) of doc_ids whose shingle sets have the similarity.

    Sketches of at most a kilobyte a text go first; sets are made and moved only for the pairs that they leave.
    """
    pairs = written(pairs, "simhash-pairs")
    named = _mentioned(pairs)
    maybe = _may_be_similar(pairs, _kept(docs, named, "doc_id", "left_semi"), similarity, shingle)
    forget(pairs, named)
    pairs, named = maybe, _mentioned(maybe)
    sets = written(_shingle_sets(_kept(docs, named, "doc_id", "left_semi"), shingle), "simhash-sets")
    of_a, of_b = (sets.select(F.col("doc_id").alias(c), F.col("set").alias(f"set_{c}")) for c in ("a", "b"))
    near = of_a.join(F.broadcast(pairs), "a") if pairs.count() <= FEW_IDS else of_a.join(pairs, "a")
    both = F.size(F.array_intersect("set_a", "set_b"))
    enough = both >= F.lit(similarity) * (F.size("set_a") + F.size("set_b") - both)
    found = written(near.join(of_b, "b").where(enough).select("a", "b"), "simhash-similar")
    forget(pairs, named, sets)
    return found


#: Texts whose shingles are counted at least, to put common shingles last, and the part of all texts that is; how many of
#: them make a shingle common, and how many common ones are known at most, the most common ones.
COUNTED, COUNTED_OF, COMMON, KNOWN = 5_000, 5, 4, 500_000
#: Bits of a sketch of a set: the parity of the number of its shingles in each of as many buckets.
PARITY = 256


def _common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles common in a part of the texts, and their counts.

    They only set the order of shingles: with any order no pair is lost.  The part grows with the texts, as
    a shingle that is taken for a rare one makes pairs of all prefixes that have it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b["text"]:
                yield pd.DataFrame({"h": np.unique(shingle_hashes(t, shingle)).view(np.int64)})

    every = F.lit(max(1, min(COUNTED_OF, docs.count() // COUNTED)))
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), every) == 0).select("text")
    counts = shipped(some).mapInPandas(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    counts = written(counts, "simhash-common")
    found = counts.orderBy(F.desc("n"), "h").limit(KNOWN).toArrow()
    forget(counts)
    hashes = found["h"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found["n"].to_numpy()[order]


def _prefixes(docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(id, size, sketch, prefix) of the shingle set of each text, the prefix in the order of all shingles.

    In one order of all shingles, rare ones first, two sets with the similarity share a shingle of their
    prefixes: were the first size - similarity * size + 1 of one all missing in the other, too few would be left.
    """
    hashes, counts = _common(docs, shingle)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes, sketches, prefixes = [], [], []
            for t in b["text"]:
                own = np.unique(shingle_hashes(t, shingle))
                seen = np.zeros(len(own), dtype=np.int64)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                    seen = np.where(hashes[at] == own, counts[at], 0)
                first = np.lexsort((own, seen))[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1]
                odd = (np.bincount((own % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)
                sizes.append(len(own))
                sketches.append(np.packbits(odd).view(np.int64))
                prefixes.append(own[first].view(np.int64))
            yield pd.DataFrame({"id": b["doc_id"], "size": np.array(sizes, dtype=np.int32), "sketch": sketches, "prefix": prefixes})

    return shipped(docs).select("doc_id", "text").mapInPandas(run, "id long, size int, sketch array<long>, prefix array<long>")


#: Rows of a shared shingle that are compared with all later rows of it in the first round; eight times as many in each further one.
PIVOTS = 4


def _exact_links(docs: DataFrame, links: DataFrame, similarity: float, shingle: int, pivots: int = PIVOTS) -> DataFrame:
    """(a, b): ``links`` and further ones, so that every pair with the similarity is connected.

    The rows of a shingle that prefixes share have a fixed order.  A round compares the next few rows of
    each shingle with all later ones, unless the pair is connected already, the sizes or the sketches rule
    the similarity out (sets differ in at least as many shingles as sketches in bits), or so many shingles
    stand before this one that it cannot be the first of enough shared ones; it is the first that counts.
    Rounds end when all rows of all shingles with more than one component have had their turn.
    """
    sets = written(_prefixes(docs, similarity, shingle), "simhash-prefixes")
    by_shingle = Window.partitionBy("h")
    rows = sets.select("id", F.posexplode("prefix").alias("at", "h")).withColumn("n", F.count("*").over(by_shingle))
    rows = rows.withColumn("r", F.row_number().over(by_shingle.orderBy(F.xxhash64("id", F.lit(9)), "id"))).where("n > 1").select("h", "r", "id", "at")
    rows = written(rows, "simhash-met")
    low, high = 0, pivots
    while True:
        known = components(links, "a", "b").select(F.col("node").alias("id"), "component")
        live = rows.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = live.groupBy("h").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("r").alias("n"))
        mixed = mixed.where((F.col("x") != F.col("y")) & (F.col("n") > low + 1)).select("h")
        live = live.join(mixed, "h", "left_semi").join(sets.drop("prefix"), "id")
        live = written(live.select("h", "r", "id", "component", "size", "sketch", (F.col("size") - F.col("at")).alias("rest")), "simhash-live")
        last = live.agg(F.max("r")).first()[0]
        if last is None:
            forget(sets, rows, live)
            return links
        p = live.where((F.col("r") > low) & (F.col("r") <= high)).select("h", *[F.col(c).alias(f"p_{c}") for c in ("r", "id", "size", "sketch", "component", "rest")])
        apart = sum((F.bit_count(F.col("sketch")[w].bitwiseXOR(F.col("p_sketch")[w])) for w in range(PARITY // 64)), F.lit(0))
        total = F.col("size") + F.col("p_size")
        may = (
            (live["h"] == p["h"]) & (F.col("r") > F.col("p_r")) & (F.col("component") != F.col("p_component"))
            & (F.least("size", "p_size") >= F.lit(similarity) * F.greatest("size", "p_size") - 1e-9)
            & (F.least("rest", "p_rest") >= total * F.lit(similarity / (1 + similarity)) - 1e-6)
            & (apart <= total * F.lit((1 - similarity) / (1 + similarity)) + 1e-9)
        )
        pairs = live.join(p, may).select(F.least("id", "p_id").alias("a"), F.greatest("id", "p_id").alias("b")).distinct()
        more = _similar(pairs, docs, similarity, shingle)
        before, links = links, written(links.union(more), "simhash-links")
        forget(before, more, live)
        if last <= high + 1:
            forget(sets, rows)
            return links
        low, high = high, high * 8


def similar_links(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, plan: Plan = SIMILAR) -> DataFrame:
    """(a, b): links whose components are those of all pairs with the similarity of shingle sets.

    ``docs`` has distinct doc_ids and texts without nulls.  The tries give links that span what is likely
    similar; those whose sets are similar count, and so fold most of a group of near copies before a join
    by prefixes of the sets adds what the tries do not find, as no bound on signatures finds all.
    """
    sigs = written(signatures(docs, shingle, plan, distinct=True).withColumnRenamed("doc_id", "id"), "simhash")
    found = near_links(sigs, plan).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (~F.col("sure")).alias("open"))
    likely = found.groupBy("b").agg(F.min(F.struct("open", "a"))["a"].alias("a")).select("a", "b")  # one a text, as the join finds all
    links = _similar(likely, docs, similarity, shingle)
    forget(sigs)
    return _exact_links(docs, links, similarity, shingle)


def keep_one_of_similar(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` with all their columns, but of each group of similar texts only one: that of the
    smallest doc_id.

    Equal texts are one from the start, and texts without words are equal.  Rows without doc_id stay.
    Of repeated rows one stays.  Different texts under one doc_id are texts of their own; a hash of the
    row breaks ties.
    """
    known = docs.where("doc_id is not null").withColumn("__row", F.xxhash64(*docs.columns))
    known = written(known.withColumn("__node", F.monotonically_increasing_id()), "simhash-texts")  # numbers hold from here on
    words = F.array_join(F.filter(F.split(whole("text"), "[ \t\n\r\x0b\f]+"), lambda w: w != ""), " ")
    key = F.unhex(F.sha2(F.translate(words, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256))
    keyed = known.select(key.alias("k"), "doc_id", "__row", "__node")
    firsts = keyed.groupBy("k").agg(F.min(F.struct("doc_id", "__row", "__node")).alias("first")).select("first.__node")
    copies = written(keyed.select("__node").join(firsts, "__node", "left_anti"), "simhash-copies")
    one = _kept(known, copies, "__node", "left_anti")
    links = similar_links(one.select(F.col("__node").alias("doc_id"), whole("text").alias("text")), similarity, shingle)
    grouped = written(components(links, "a", "b").withColumnRenamed("node", "__node"), "simhash-groups")
    named = grouped.join(known.select("__node", "doc_id", "__row"), "__node")
    stay = named.groupBy("component").agg(F.min(F.struct("doc_id", "__row", "__node")).alias("first")).select("first.__node")
    gone = grouped.select("__node").join(stay, "__node", "left_anti").union(copies)
    gone = written(gone, "simhash-gone")
    forget(links, grouped, copies)
    kept = _kept(known, gone, "__node", "left_anti")
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))
