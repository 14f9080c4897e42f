"""What is known of each root while its query log is still arriving.

A keyed state machine with event-time timers: a root is ``pending`` from its arrival, ``ok`` as soon as
the log knows it, and when its time budget is over its last row says ``ok`` or ``no-data`` for good.
Roots are kept by the bucket of their id, so state and timers are asked for once a bucket and batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loglattice.functions.fields import quoted

# The statuses of a root.
NOT_TAGGED, PENDING, OK, NO_DATA = "not-tagged", "pending", "ok", "no-data"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 1024  # the bucket of null ids is -1
NO_LOG, NO_ROOT = np.iinfo(np.int64).min, np.iinfo(np.int64).max
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _by_root(ids, n, latest, first, tagged) -> tuple[np.ndarray, ...]:
    """One entry a root: its log rows, the latest of them, the start of its first root row and whether that is tagged."""
    at, ids = pd.factorize(ids)
    total, late, early = np.zeros(len(ids), np.int64), np.full(len(ids), NO_LOG), np.full(len(ids), NO_ROOT)
    np.add.at(total, at, n)
    np.maximum.at(late, at, latest)
    np.minimum.at(early, at, first)
    flag = np.zeros(len(ids), bool)
    firsts = np.flatnonzero(first == early[at])[::-1]  # of root rows at one time the first to come is written last
    flag[at[firsts]] = tagged[firsts]
    return ids, total, late, early, flag


def _summary(frames: Iterator[pd.DataFrame]) -> tuple[np.ndarray, ...]:
    """The entries of a bucket's rows, held as entries and not as rows."""
    parts, merged = [], 0
    for f in frames:
        is_root, us = f["is_root"].to_numpy(bool), f["us"].to_numpy(np.int64)
        logged, first = np.where(is_root, NO_LOG, us), np.where(is_root, us, NO_ROOT)
        parts.append(_by_root(f["id"].to_numpy(), (~is_root).astype(np.int64), logged, first, f["is_tagged"].to_numpy(bool)))
        if len(parts) > 1 and sum(len(p[0]) for p in parts) > 2 * merged:
            parts = [_by_root(*map(np.concatenate, zip(*parts)))]
            merged = len(parts[0][0])
    return parts[0] if len(parts) == 1 else _by_root(*map(np.concatenate, zip(*parts)))


def _ms(us: np.ndarray) -> np.ndarray:
    """Milliseconds, rounded up."""
    return -(-us // 1000)


class RootStatus(StatefulProcessor):
    """State of a bucket: of each root whether it has arrived, the log rows seen, and when it is settled."""

    def __init__(self, budget: int):
        self.budget = budget  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("roots", "entries binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new_ids, more, latest, first, tagged = _summary(rows)
        kept = self._kept()
        if kept is None:
            ids, at = new_ids, np.arange(len(new_ids))
            arrived, had, due = np.zeros(len(ids), bool), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            known = 0
        else:
            known = len(kept[0])
            at, ids = pd.factorize(np.concatenate([kept[0], new_ids]))
            at, extra = at[known:], len(ids) - known
            arrived, had, due = (np.concatenate([x, np.zeros(extra, x.dtype)]) for x in kept[1:])
        n, start, flag, log = had.copy(), np.full(len(ids), NO_ROOT), np.zeros(len(ids), bool), np.full(len(ids), NO_LOG)
        n[at] += more
        start[at], flag[at], log[at] = first, tagged, latest
        came = (start < NO_ROOT) & ~arrived
        untagged, new = came & ~flag, came & flag
        due[new] = _ms(start[new] + self.budget)
        # log rows without a root so far; forgotten if none comes for two budgets
        waits = ~came & (np.arange(len(ids)) >= known)
        due[waits] = _ms(log[waits] + 2 * self.budget)
        told = new | (arrived & (n > 0) & (had == 0))
        stays = ~untagged
        self._keep(ids[stays], (arrived | new)[stays], n[stays], due[stays], None if kept is None else int(kept[3].min()))
        if untagged.any():
            yield self._rows(key, ids[untagged], NOT_TAGGED, np.zeros(untagged.sum(), np.int64), True)
        if told.any():
            yield self._rows(key, ids[told], np.where(n[told] > 0, OK, PENDING), n[told], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept = self._kept()
        if kept is None:
            return
        ids, arrived, n, due = kept
        over = due <= timerValues.getCurrentWatermarkInMs()
        # the timer that has fired deletes itself
        self._keep(ids[~over], arrived[~over], n[~over], due[~over], None)
        told = over & arrived
        if told.any():
            yield self._rows(key, ids[told], np.where(n[told] > 0, OK, NO_DATA), n[told], True)

    def close(self) -> None:
        pass

    def _kept(self) -> tuple[np.ndarray, ...] | None:
        got = self.state.get()
        if got is None:
            return None
        table = pa.ipc.open_stream(bytes(got[0])).read_all()
        return tuple(c.to_numpy() for c in table.columns)

    def _keep(self, ids, arrived, n, due, timer: int | None) -> None:
        """Writes the bucket's entries and sets its one timer, at the first that is due."""
        at = int(due.min()) if len(due) else None
        if timer is not None and timer != at:
            self.handle.deleteTimer(timer)
        if at is None:
            self.state.clear()
            return
        entries = pa.table({"id": ids, "arrived": arrived, "n": n, "due": due})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, entries.schema) as out:
            out.write_table(entries)
        self.state.update((sink.getvalue().to_pybytes(),))
        if timer != at:
            self.handle.registerTimer(at)

    def _rows(self, key, ids, status, n, settled: bool) -> pd.DataFrame:
        ids = pd.Series([None] * len(ids), dtype=object) if key[0] < 0 else ids
        return pd.DataFrame({"id": ids, "status": status, "n_log_rows": n, "settled": settled})


def _coded(kind: T.DataType) -> tuple[Column, Column]:
    """An id as a long or a string, never null, and the id of that: what pandas and Arrow give back as it was."""
    c = F.col("root_id")
    if isinstance(kind, T.IntegralType):
        return F.coalesce(c.cast("long"), F.lit(0).cast("long")), F.col("id").cast(kind)
    if isinstance(kind, T.StringType):
        return F.coalesce(c, F.lit("")), F.col("id")
    wrapped = T.StructType([T.StructField("v", kind)])
    return F.to_json(F.struct(c.alias("v")), JSON_TIMES), F.from_json("id", wrapped, JSON_TIMES)["v"]


def stream_status(
    roots: DataFrame, qlog: DataFrame, budget_seconds: float, late: str = "30 seconds", tagged: Column | None = None,
    start: str = "start_time", logged: str = "event_time", buckets: int = BUCKETS,
) -> DataFrame:
    """(root_id, status, n_log_rows, settled) as things change.

    ``roots`` has root_id and a start time, a row a root; ``qlog`` trace_id and an event time.  A tagged root
    gives ``pending`` when it arrives (``ok`` if the log was faster), ``ok`` at its first log row, and one settled
    row when both streams' watermarks have passed its start by ``budget_seconds``: ``ok`` with the number of
    log rows, or ``no-data``.  An untagged root gives one settled row at once.  A root that arrives again before it is settled
    changes nothing; log rows without a root are forgotten two budgets after the latest of them that came first.
    Null ids are one root; rows without a time are left out.  The settled rows equal ``correlation_status`` if no log row comes after its root is settled.

    Needs the RocksDB state store (``STATE_STORE`` as ``spark.sql.streaming.stateStore.providerClass``).  An open
    root's state is its id and three numbers, however many rows it has.  A batch reads and writes the open roots of the
    ``buckets`` it has rows or timers for, each at once; their number stays as it is for the life of a checkpoint.
    """
    kind = roots.schema["root_id"].dataType
    flag = F.lit(True) if tagged is None else F.coalesce(tagged, F.lit(False))
    left = roots.withWatermark(start, late).select(
        "root_id", quoted(start).alias("at"), F.lit(True).alias("is_root"), flag.alias("is_tagged")
    )
    right = qlog.withWatermark(logged, late).select(
        F.col("trace_id").cast(kind).alias("root_id"), quoted(logged).alias("at"), F.lit(False).alias("is_root"), F.lit(False).alias("is_tagged")
    )
    code, root_id = _coded(kind)
    out = T.StructType([
        T.StructField("id", T.LongType() if isinstance(kind, T.IntegralType) else T.StringType()),
        T.StructField("status", T.StringType()), T.StructField("n_log_rows", T.LongType()), T.StructField("settled", T.BooleanType()),
    ])
    processor = RootStatus(round(budget_seconds * 1_000_000))
    bucket = F.when(F.col("root_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("root_id"), F.lit(buckets)).cast("int"))
    rows = left.unionByName(right).filter(F.col("at").isNotNull())
    grouped = rows.select(bucket.alias("bucket"), code.alias("id"), "at", F.unix_micros("at").alias("us"), "is_root", "is_tagged").groupBy("bucket")
    changes = grouped.transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Update", timeMode="EventTime")
    return changes.select(root_id.alias("root_id"), "status", "n_log_rows", "settled")
