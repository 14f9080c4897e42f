"""Structured filters: field, operator, value(s)."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.functions.fields import Resolved, Scope
from loglattice.functions.literals import typed_literal
from loglattice.operators.predicates import Predicate, all_of, filter_logs, non_empty, one_of
from loglattice.view import LogView

# Each operator and its exact opposite.
OPPOSITE = {
    "=": "!=",
    "!=": "=",
    "contains": "not_contains",
    "not_contains": "contains",
    "one_of": "not_one_of",
    "not_one_of": "one_of",
    "exists": "not_exists",
    "not_exists": "exists",
}


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: str = ""
    values: tuple = ()
    disabled: bool = False

    def __post_init__(self) -> None:
        if self.op not in OPPOSITE:
            raise ValueError(f"unknown filter operator {self.op!r}; use {', '.join(OPPOSITE)}")
        object.__setattr__(self, "values", tuple(self.values))

    def opposite(self) -> "Filter":
        return replace(self, op=OPPOSITE[self.op])

    @property
    def identity(self) -> tuple:
        """Filters of equal identity are one filter; the order of a value list does not matter."""
        chosen = tuple(sorted(map(str, self.values))) if self.values else str(self.value)
        return (self.field, self.op, chosen)


def cell_filter(field: str, value, include: bool = True) -> Filter:
    """'Filter for' or 'filter out' one value."""
    return Filter(field, "=" if include else "!=", value)


def contains_pattern(value: str) -> str:
    """``%`` and ``_`` stay wildcards; a backslash that escapes nothing is made literal."""
    return "%" + re.sub(r"\\([\\%_])|\\", lambda m: m[0] if m[1] else "\\\\", value) + "%"


def _filter_column(f: Filter, r: Resolved) -> Column:
    value = f.value.strip() if isinstance(f.value, str) else f.value
    if f.op == "exists":
        return non_empty(r)
    if f.op == "not_exists":
        return ~non_empty(r)
    if f.op in ("one_of", "not_one_of"):
        chosen = f.values or ((value,) if value not in ("", None) else ())
        if not chosen:
            return F.lit(f.op == "not_one_of")
        hit = one_of(r, chosen)
        return hit if f.op == "one_of" else ~hit
    negative = f.op in ("!=", "not_contains")
    if r.kind == "text" or f.op in ("contains", "not_contains"):
        hit = r.field.as_string().ilike(contains_pattern(str(value)))
        return ~hit if negative else hit
    if isinstance(r.dtype, (T.MapType, T.ArrayType, T.VariantType)):
        col, lit = r.field.as_string(), F.lit(str(value))
    else:
        col, lit = r.column, typed_literal(value, r.dtype)
    return col != lit if negative else col == lit


def filter_predicate(f: Filter) -> Predicate:
    return Predicate(lambda scope: _filter_column(f, scope.get(f.field)), f"{f.field} {f.op} {f.value or f.values}")


def active_filters(filters: Iterable[Filter]) -> list[Filter]:
    """Enabled filters, exact repeats collapsed to the last one given."""
    kept: dict[tuple, Filter] = {}
    for f in filters:
        kept.pop(f.identity, None)
        kept[f.identity] = f
    return [f for f in kept.values() if not f.disabled]


def filters_predicate(filters: Iterable[Filter]) -> Predicate:
    return all_of(*(filter_predicate(f) for f in active_filters(filters)))


def apply_filters(df: DataFrame, view: LogView, filters: Iterable[Filter]) -> DataFrame:
    """Rows meeting every enabled filter."""
    return filter_logs(df, view, filters_predicate(filters))
