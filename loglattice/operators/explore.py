"""Rows of a log table: projections, lists, pages, single rows, rows around an instant."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.functions.fields import Scope, json_path, quoted
from loglattice.functions.literals import bound_literal, naive_utc, timestamp_literal
from loglattice.operators.predicates import Predicate, filter_logs, time_range
from loglattice.plans.joins import broadcast_if_bounded
from loglattice.plans.durable import durable
from loglattice.plans.ordered import into_blocks, running_sum
from loglattice.plans.topk import bounded_by_time, within
from loglattice.view import ROLE_ALIASES, LogView

DEFAULT_LIMIT = 200
PAGE_SIZE = 50
KEY_ROLES = ("timestamp", "body", "severity", "service")

Extra = Sequence["str | tuple[str, Column]"]


def _extra_columns(scope: Scope, columns: Extra) -> list[Column]:
    out = []
    for c in columns:
        if isinstance(c, str):
            out.append(scope.get(c).column.alias(c))
        else:
            out.append(c[1].alias(c[0]))
    return out


def grid(df: DataFrame, view: LogView, columns: Extra = ()) -> DataFrame:
    """Mapped roles under their fixed names plus the chosen columns; everything if that is nothing."""
    scope = Scope(df, view)
    core = [scope.get(name).column.alias(ROLE_ALIASES[role]) for role, name in view.mapped_roles.items()]
    chosen = core + _extra_columns(scope, columns)
    return df.select(*chosen) if chosen else df


def full(df: DataFrame, view: LogView, columns: Extra = ()) -> DataFrame:
    """All columns plus the chosen expressions."""
    return df.select("*", *_extra_columns(Scope(df, view), columns))


def extract(df: DataFrame, view: LogView, paths: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """Nested fields as columns of their own, one per path.

    A path is read the same way whether it is asked alone or with others: of repeated keys the first
    counts, text that is no JSON gives NULL.  Spark evaluates the paths of one text column together.
    """
    scope = Scope(df, view)
    named = dict(paths) if isinstance(paths, Mapping) else {p: p for p in paths}
    fields = {alias: scope.get(p).field for alias, p in named.items()}
    return df.select(*df.columns, *[f.column.alias(a) for a, f in fields.items()])


def _key_parts(df: DataFrame, view: LogView) -> dict[str, Column]:
    """The key columns a frame has, under their narrow alias or their own name."""
    scope = Scope(df, view)
    parts = {}
    for role in KEY_ROLES:
        alias, name = ROLE_ALIASES[role], getattr(view, role)
        if alias in df.columns:
            parts[role] = quoted(alias)
        elif name:
            hit = scope.resolve(name)
            if hit is not None:
                parts[role] = hit.column
    if not parts:
        raise ValueError("no part of the content key is mapped")
    return parts


def row_key(df: DataFrame, view: LogView) -> Column:
    """Content key over timestamp, body, severity and service; never NULL.

    Equal for equal content whether the frame is the narrow projection or the full row.  Each part
    is written with its length in front and NULL as a dash, so no two contents read the same.
    """
    written = []
    for col in _key_parts(df, view).values():
        text = col.cast("string")
        written.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.coalesce(F.sha2(F.concat(*written), 256), F.lit(""))


def with_row_key(df: DataFrame, view: LogView, out: str = "row_key") -> DataFrame:
    return df.withColumn(out, row_key(df, view))


# --- sorted lists -------------------------------------------------------------------------------

def _order(scope: Scope, sort: str | None, descending: bool) -> list[Column]:
    """Chosen column or role (default timestamp), NULLs last, ties broken by the row id."""
    view = scope.view
    name = sort or view.timestamp
    keys = []
    if name:
        role = {v: k for k, v in ROLE_ALIASES.items()}.get(name)
        col = scope.role(role) if role else scope.get(name).column
        keys.append(col.desc_nulls_last() if descending else col.asc_nulls_last())
    for rid in view.row_id:
        if rid != name:
            keys.append(quoted(rid).asc_nulls_last())
    return keys


def explore(
    df: DataFrame,
    view: LogView,
    where: Predicate | None = None,
    sort: str | None = None,
    descending: bool = True,
    limit: int = DEFAULT_LIMIT,
    projection: str = "full",
    columns: Extra = (),
    time_first: bool = False,
) -> DataFrame:
    """The first ``limit`` matching rows in the chosen order (a top-k, never a full sort).

    With ``time_first`` a list by time looks at the timestamps before it reads the wide rows (see
    ``plans.topk``), which pays on inputs of very many scan tasks.
    """
    rows = filter_logs(df, view, where) if where is not None else df
    if view.timestamp and sort in (None, view.timestamp, ROLE_ALIASES["timestamp"]):
        rows = bounded_by_time(rows, view, limit, descending, time_first)
    order = _order(Scope(rows, view), sort, descending)
    top = (rows.orderBy(*order) if order else rows).limit(limit)
    return grid(top, view, columns) if projection == "grid" else full(top, view, columns)


def page(
    df: DataFrame,
    view: LogView,
    number: int,
    size: int = PAGE_SIZE,
    where: Predicate | None = None,
    sort: str | None = None,
    descending: bool = True,
    time_first: bool = False,
) -> DataFrame:
    """Page ``number`` (from 0) by offset.  Cost grows with depth; see :func:`page_after`."""
    rows = filter_logs(df, view, where) if where is not None else df
    if view.timestamp and sort in (None, view.timestamp, ROLE_ALIASES["timestamp"]):
        rows = bounded_by_time(rows, view, (number + 1) * size, descending, time_first)
    order = _order(Scope(rows, view), sort, descending)
    return (rows.orderBy(*order) if order else rows).offset(number * size).limit(size)


def has_more(page_rows: DataFrame, size: int = PAGE_SIZE) -> bool:
    """A full page means there may be another one."""
    return len(page_rows.limit(size).select(F.lit(1)).take(size)) == size


def page_after(
    df: DataFrame,
    view: LogView,
    last: Mapping[str, object],
    size: int = PAGE_SIZE,
    where: Predicate | None = None,
    time_first: bool = False,
) -> DataFrame:
    """The page after the row ``last`` (its timestamp and row id), newest first, at any depth.

    Rows without a timestamp come last.  ``time_first`` as in :func:`explore`.
    """
    view.require("timestamp")
    if not view.row_id:
        raise ValueError("paging by key needs row_id columns")
    rows = filter_logs(df, view, where) if where is not None else df
    scope = Scope(rows, view)
    ts = scope.role("timestamp")
    tie = F.lit(False)
    same = F.lit(True)
    for rid in view.row_id:
        tie = tie | (same & (quoted(rid) > F.lit(last[rid])))
        same = same & (quoted(rid) == F.lit(last[rid]))
    if last[view.timestamp] is None:  # among the rows without a timestamp, which are listed last
        return rows.filter(ts.isNull() & tie).orderBy(*_order(scope, None, True)).limit(size)
    at = timestamp_literal(last[view.timestamp], scope.role_type("timestamp"))
    # the plain range also reaches the file scan; the disjunction alone would not
    reach = rows.filter((ts <= at) | ts.isNull()).filter((ts < at) | (tie & (ts == at)) | ts.isNull())
    later = bounded_by_time(reach, view, size, force=time_first)
    return later.orderBy(*_order(scope, None, True)).limit(size)


# --- one row and its full form ------------------------------------------------------------------

def detail(df: DataFrame, view: LogView, row: Mapping[str, object]) -> DataFrame:
    """The full row behind a narrow one: its millisecond, and equal body, severity and service."""
    view.require("timestamp")
    at = naive_utc(row[ROLE_ALIASES["timestamp"]])
    start = at.replace(microsecond=at.microsecond // 1000 * 1000)
    rows = filter_logs(df, view, time_range(start, start + dt.timedelta(milliseconds=1), closed=False))
    scope = Scope(rows, view)
    for role in ("body", "severity", "service"):
        alias = ROLE_ALIASES[role]
        if getattr(view, role) and alias in row:
            value = row[alias]
            col = scope.role(role)
            rows = rows.filter(col == F.lit(value) if value is not None else F.coalesce(col.cast("string"), F.lit("")) == "")
    order = [quoted(r) for r in view.row_id]
    return (rows.orderBy(*order) if order else rows).limit(1)


def hydrate(df: DataFrame, narrow: DataFrame, view: LogView, time: tuple | None = None) -> DataFrame:
    """Every narrow row with one full row of the same content key, NULL where there is none.

    The narrow rows are written out once and their time span prunes the scan of the log table.  Their
    distinct keys then pick the rows that are wanted at all, by a semi-join that Spark carries out as
    the size it has measured suggests.  Copies of one content key are reduced to one row before the
    join, so a key shared by many rows stays one row.
    """
    rows = filter_logs(df, view, time_range(*time)) if time else df
    narrow = durable(narrow)
    stamp = next((c for c in (ROLE_ALIASES["timestamp"], view.timestamp) if c and c in narrow.columns), None)
    if view.timestamp and stamp:
        span = [narrow.agg(f(quoted(stamp))).scalar() for f in (F.min, F.max)]
        rows = rows.filter(within(Scope(rows, view), *span, keep_null=True))
    # compare the columns themselves, so only the survivors are hashed
    theirs, ours = _key_parts(narrow, view), _key_parts(rows, view)
    wanted = narrow.select(*[c.alias(f"__n_{r}") for r, c in theirs.items()]).distinct()
    same = [c.eqNullSafe(F.col(f"__n_{r}")) for r, c in ours.items() if r in theirs]
    rows = rows.join(wanted, reduce(lambda a, b: a & b, same), "left_semi")
    keyed = rows.withColumn("__key", row_key(rows, view))
    left = narrow.withColumn("__key", row_key(narrow, view))
    tie = F.struct(*[quoted(r) for r in view.row_id]) if view.row_id else F.xxhash64(F.to_json(F.struct(*df.columns)))
    one = keyed.groupBy("__key").agg(F.min_by(F.struct(*[quoted(c) for c in df.columns]), tie).alias("__row"))
    joined = left.join(one, "__key", "left")
    kept = [c for c in narrow.columns if c not in df.columns]
    return joined.select(*[quoted(c) for c in kept], *[quoted("__row", c).alias(c) for c in df.columns])


def duplicate_groups(df: DataFrame, view: LogView) -> DataFrame:
    """Content keys shared by more than one row, with their count and time span."""
    scope = Scope(df, view)
    aggs = [F.count("*").alias("n_rows")]
    if view.timestamp:
        ts = scope.role("timestamp")
        aggs += [F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen")]
    return df.groupBy(row_key(df, view).alias("row_key")).agg(*aggs).filter(F.col("n_rows") > 1)


# --- rows around an instant ---------------------------------------------------------------------

def surrounding(
    df: DataFrame,
    view: LogView,
    at,
    n: int = 25,
    direction: str = "before",
    where: Predicate | None = None,
    time_first: bool = False,
) -> DataFrame:
    """``n`` rows strictly before (newest first) or after (oldest first) an instant."""
    if direction not in ("before", "after"):
        raise ValueError("direction is 'before' or 'after'")
    view.require("timestamp")
    rows = filter_logs(df, view, where) if where is not None else df
    before = direction == "before"
    rows = filter_logs(rows, view, time_range(None, at) if before else time_range(at, None))
    scope = Scope(rows, view)
    ts, lit = scope.role("timestamp"), bound_literal(at, scope.role_type("timestamp"), "lt" if before else "gt")
    rows = bounded_by_time(rows.filter(ts < lit if before else ts > lit), view, n, before, time_first)
    top = rows.orderBy(*_order(scope, None, before)).limit(n)
    roles = {"timestamp": "timestamp", "body": "body", "severity": "severity", "service": "serviceName"}
    named = [
        (scope.role(r) if getattr(view, r) else F.lit("")).alias(alias)
        for r, alias in roles.items()
    ]
    return top.select(*named, *[quoted(r) for r in view.row_id if r not in roles.values()])


def surrounding_many(
    df: DataFrame,
    view: LogView,
    anchors: DataFrame,
    n: int = 25,
    by: str | None = None,
    anchor_id: str = "anchor_id",
    anchor_rows: int | None = None,
) -> DataFrame:
    """The ``n`` rows before and after each of many anchors, within the same ``by`` value.

    ``anchors`` has ``anchor_id``, the ``by`` column and the timestamp column.  Rows get their
    position within ``by`` from block-wise running counts, so no group is sorted by one task; an
    anchor then asks for the ``2n`` positions next to it, an equi-join the size of the result.
    ``offset`` is -1 for the row just before the anchor, 1 for the row just after.
    """
    view.require("timestamp")
    by = by or view.service
    if not by or not view.row_id:
        raise ValueError("surrounding_many needs a grouping column and row_id columns")
    ids = list(view.row_id)
    key = quoted(by).alias("__by")
    ts = quoted(view.timestamp).alias("__ts")
    # at one instant: the anchor's 'before' mark, the rows, the anchor's 'after' mark
    rows = df.select(key, ts, F.lit(1).alias("__kind"), *[quoted(i) for i in ids], F.lit(None).cast("string").alias("__a"))
    marks = anchors.select(
        key,
        ts,
        F.explode(F.array(F.lit(0), F.lit(2))).alias("__kind"),
        *[F.lit(None).cast(df.schema[i].dataType).alias(i) for i in ids],
        quoted(anchor_id).cast("string").alias("__a"),
    )
    order = ["__ts", "__kind", *ids, "__a"]
    blocked = into_blocks(rows.unionByName(marks), ["__by"], order)
    is_row = F.when(F.col("__kind") == 1, 1).otherwise(0)
    placed = running_sum(blocked, is_row, ["__by"], order, "__pos")
    seen = placed.filter(F.col("__kind") != 1)
    steps = F.when(
        F.col("__kind") == 0,
        F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct((-i).alias("off"), (F.col("__pos") - i + 1).alias("at"))),
    ).otherwise(
        F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(i.alias("off"), (F.col("__pos") + i).alias("at")))
    )
    asked = seen.select("__by", "__a", F.explode(steps).alias("s")).select(
        F.col("__by").alias("__q_by"), F.col("s.at").alias("__q_pos"), "__a", F.col("s.off").alias("offset")
    )
    near = F.col("__by").eqNullSafe(F.col("__q_by")) & (F.col("__pos") == F.col("__q_pos"))
    bound = anchor_rows * 2 * n if anchor_rows is not None else None
    hits = placed.filter(F.col("__kind") == 1).drop("__a", "__kind").join(
        broadcast_if_bounded(asked, bound), near
    )
    return hits.select(
        F.col("__a").cast(anchors.schema[anchor_id].dataType).alias(anchor_id),
        "offset",
        F.col("__by").alias(by),
        F.col("__ts").alias(view.timestamp),
        *[quoted(i) for i in ids if i not in (by, view.timestamp)],
    )
