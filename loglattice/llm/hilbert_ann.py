"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions, in several random ways; each projection is shifted, put on a
grid and ordered by its Hilbert curve; what shares a cell is ordered by finer grids inside it, then by a
hash of the id.  The curve is cut into key ranges of about equal size, which are counted and which Spark
deals out.  A query goes to the ranges within a window around its own key; there all vectors are
measured exactly, and the best of all curves merge.

Equal vectors are one entry with their smallest ids, of which no query can need more than k + 1, so a
vector that a third of the rows has is a single entry.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loglattice.llm.common import shipped
from loglattice.plans.durable import written

#: Vectors of one key range at most; a wider window has more ranges.
RANGE_ROWS = 20_000
#: Grids, each inside the cells of the one before, that order what shares a cell.
LEVELS = 3


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of (rows, dims) cells with coordinates of ``bits`` bits."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of the sub-cubes, from the largest on
        p = q - 1
        for i in range(len(x)):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0]) ^ swap
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):  # Gray code
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros(len(cells), dtype=np.uint64)
    for j in range(bits - 1, -1, -1):
        for v in x:
            key = (key << np.uint64(1)) | (((v ^ turn) >> j) & 1).astype(np.uint64)
    return key


@dataclass
class Curves:
    """Projections, grids and range borders, fitted on a sample."""

    projections: np.ndarray  # curves, size, dims
    low: np.ndarray  # curves, dims
    width: np.ndarray
    bits: int
    borders: list[np.ndarray]

    def keys(self, x: np.ndarray, ids: np.ndarray, curve: int) -> np.ndarray:
        """Byte strings of a total order: the key in the grid, the keys in ever finer grids inside a cell, a hash of the id."""
        y = (x @ self.projections[curve] - self.low[curve]) / self.width[curve]
        y = np.clip(y, 0, np.nextafter(1.0, 0)) * (1 << self.bits)
        out = np.empty((len(x), LEVELS + 1), dtype=">u8")
        for level in range(LEVELS):
            cells = np.floor(y)
            out[:, level] = hilbert_keys(cells.astype(np.int64), self.bits)
            y = (y - cells) * (1 << self.bits)
        tie = (ids.astype(np.int64).view(np.uint64) + np.uint64(curve)) * np.uint64(0x9E3779B97F4A7C15)
        out[:, LEVELS] = (tie ^ (tie >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return out.view(f"S{8 * (LEVELS + 1)}")[:, 0]

    def ranges(self, x: np.ndarray, ids: np.ndarray, curve: int) -> np.ndarray:
        return np.searchsorted(self.borders[curve], self.keys(x, ids, curve), side="right")


def fit_curves(sample: np.ndarray, ids: np.ndarray, curves: int, dims: int, bits: int, ranges: int, seed: int = 5) -> Curves:
    """Random projections; each grid spans eight deviations around the sample, shifted at random."""
    draw = np.random.default_rng(seed)
    size = sample.shape[1]
    dims = min(dims, size)
    projections = np.stack([np.linalg.qr(draw.standard_normal((size, dims)))[0] for _ in range(curves)])
    y = np.einsum("ns,csd->cnd", sample, projections)
    spread = np.maximum(y.std(axis=1), 1e-12) * 8
    low = y.mean(axis=1) - spread * (0.5 + draw.uniform(-0.12, 0.12, (curves, dims)))
    out = Curves(projections, low, spread, bits, [])
    for c in range(curves):
        keys = np.sort(out.keys(sample, ids, c))
        out.borders.append(keys[(np.arange(1, ranges) * len(keys)) // ranges])
    return out


def usable(v: Column) -> Column:
    """A vector with a direction: no null or non-finite component, not all zero."""
    d = F.transform(v, lambda x: x.cast("double"))
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & F.coalesce(~bad, F.lit(False)) & F.exists(d, lambda x: x != 0)


def within_rows(counts: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last range of the window of each range: on each side as many as have ``need`` rows, or all."""
    ends = np.cumsum(counts)
    first = np.searchsorted(ends, ends - counts - need, side="right")
    last = np.searchsorted(ends, ends + need, side="left")
    return first, np.minimum(last, len(counts) - 1)


def nearest(
    vectors: DataFrame, k: int = 10, every: int = 100, curves: int = 40, dims: int = 8, bits: int = 8,
    share: float = 0.011, least: int = 500, sample: int = 20_000,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each row whose id ``every`` divides.

    ``vectors`` has vec_id and embedding.  A window reaches at least ``share`` of all vectors, or ``least``
    if more (and a quarter on top), to both sides of a query's key range on each of ``curves`` curves,
    in counted rows.  The curves and the borders of the
    key ranges are fitted on about ``sample`` vectors, chosen by a hash of the id; every vector is indexed.
    Score is the Euclidean distance in double precision; ties go to the smaller vec_id.  Vectors without
    a direction and rows without id take no part, nor do vectors of another size than the most
    frequent one.  Rows that repeat id and vector are one.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = rows.where("vec_id is not null").where(usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").head()
    out = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], out)
    rows = rows.where(F.size("v") == sizes["size"]).distinct()
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    ids = rows.withColumn("r", first).where(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("v").agg(F.lit(True).alias("asked"))
    entries = written(ids.join(asked, "v", "left").select(F.col("ids")[0].alias("id"), "ids", "v", F.coalesce("asked", F.lit(False)).alias("asked")), "ann-entries")
    n = entries.count()
    rate = min(1.0, sample / n)
    chosen = entries.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1).select("id", "v").limit(2 * sample)
    drawn = sorted((r["v"], r["id"]) for r in chosen.collect()) or [(r["v"], r["id"]) for r in entries.select("v", "id").head(1)]
    window = min(n, max(least, math.ceil(share * n)))
    width = max(1, min(window // 2, RANGE_ROWS))
    ranges = max(1, n // width)
    names = np.array([r[1] for r in drawn], dtype=np.int64)
    model = fit_curves(np.array([r[0] for r in drawn], dtype=np.float64), names, curves, dims, bits, ranges)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy())
                for c in range(curves):
                    at, rows_ = np.unique(model.ranges(x, b["id"].to_numpy(), c), return_counts=True)
                    yield pd.DataFrame({"curve": c, "range": at, "n": rows_})

    counted = shipped(entries).select("id", "v").mapInPandas(count, "curve int, range int, n long").groupBy("curve", "range").agg(F.sum("n").alias("n"))
    counts = np.zeros((curves, ranges), dtype=np.int64)
    for r in counted.collect():
        counts[r["curve"], r["range"]] = r["n"]
    bound = min(RANGE_ROWS, 2 * width)
    parts = np.where(counts > bound, -(-counts * 5 // (4 * bound)), 1)  # what is over the bound is dealt by a hash, and all its parts are visited
    windows = [within_rows(c, math.ceil(1.25 * window)) for c in counts]

    def place(query: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                x, ids_ = np.stack(b["v"].to_numpy()), b["id"].to_numpy()
                for c in range(curves):
                    own = model.ranges(x, ids_, c)
                    if not query:
                        mixed = ids_.astype(np.int64).view(np.uint64) * np.uint64(0x165667B19E3779F9)
                        part = ((mixed >> np.uint64(32)) % parts[c][own].astype(np.uint64)).astype(np.int32)
                        yield pd.DataFrame({"curve": c, "range": own, "part": part, "id": ids_, "v": list(x)})
                        continue
                    visits = [first + np.flatnonzero(counts[c][first : last + 1]) for first, last in zip(windows[c][0][own], windows[c][1][own])]
                    row = np.repeat(np.arange(len(x)), [len(v) for v in visits])
                    at = np.concatenate(visits)
                    row, at, part = np.repeat(row, parts[c][at]), np.repeat(at, parts[c][at]), np.concatenate([np.arange(m) for m in parts[c][at]])
                    yield pd.DataFrame({"curve": c, "range": at, "part": part, "id": ids_[row], "v": list(x[row])})

        return run

    placed = "curve int, range int, part int, id long, v array<double>"
    items = shipped(entries).select("id", "v").mapInPandas(place(False), placed)
    queries = entries.where("asked").select("id", "v").mapInPandas(place(True), placed)

    def measure(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        if len(left) and len(right):
            x, y = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
            names = left["id"].to_numpy()
            square = (x**2).sum(axis=1)
            for i, query in enumerate(right["id"].to_numpy()):
                rough = square - 2 * (x @ y[i])
                limit = np.partition(rough, k)[k] if len(rough) > k + 1 else np.inf
                near = np.flatnonzero(rough <= limit + 1e-9 * (1 + abs(limit) if np.isfinite(limit) else 1))
                score = np.sqrt(((x[near] - y[i]) ** 2).sum(axis=1))
                found.append(pd.DataFrame({"query": query, "id": names[near], "score": score}))
        return pd.concat(found) if found else pd.DataFrame({"query": [], "id": [], "score": []})

    near = items.groupBy("curve", "range", "part").cogroup(queries.groupBy("curve", "range", "part")).applyInPandas(measure, "query long, id long, score double")
    best = near.groupBy("query", "id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query").orderBy("score", "id")
    best = best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    listed = best.join(entries.select("id", "ids"), "id").select("query", F.explode("ids").alias("vec_id"), "score")
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    listed = listed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    owners = entries.where("asked").select(F.col("id").alias("query"), "v").join(rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v"), "v")
    pairs = owners.select("query", "query_id").join(listed, "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
