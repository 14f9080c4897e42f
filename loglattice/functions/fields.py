"""Resolve field names against a DataFrame schema, on the driver, into Spark columns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.view import ROLE_ALIASES, LogView

_PLAIN_SEGMENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
_BRACKET_ACCESS = re.compile(r"(?P<col>[A-Za-z_][A-Za-z0-9_]*)\['(?P<key>(?:[^'\\]|\\.)*)'\]\Z")


class UnresolvedField(ValueError):
    """The name matches no column, struct leaf, map key path, JSON path or mapped role."""


@dataclass(frozen=True)
class Field:
    name: str
    display: str
    source: str  # column | struct | map | json
    semantic: str
    dtype: T.DataType
    column: Column

    def as_string(self) -> Column:
        if isinstance(self.dtype, T.StringType):
            return self.column
        if isinstance(self.dtype, (T.VariantType, T.ArrayType)):
            return F.to_json(self.column)
        return self.column.cast("string")


@dataclass(frozen=True)
class Resolved:
    column: Column
    kind: str  # text | exact | map | json
    dtype: T.DataType
    field: Field


def quoted(*parts: str) -> Column:
    return F.col(".".join("`" + p.replace("`", "``") + "`" for p in parts))


def json_path(path: str) -> str:
    """``user.id`` -> ``$.user.id``; segments that are no plain names are bracketed."""
    out = "$"
    for seg in path.split("."):
        if _PLAIN_SEGMENT.match(seg):
            out += f".{seg}"
        else:
            out += "['" + seg.replace("'", "\\'") + "']"
    return out


def map_value(container: Column, key: str) -> Column:
    """A map entry; an absent key reads as the empty string."""
    return F.coalesce(F.try_element_at(container, F.lit(key)), F.lit(""))


def json_value(container: Column, dtype: T.DataType, path: str) -> Column:
    """The value at a dotted path as a string, NULL when the path is absent."""
    if isinstance(dtype, T.VariantType):
        return F.try_variant_get(container, json_path(path), "string")
    return F.get_json_object(container, json_path(path))


def semantic_type(dtype: T.DataType, is_json_text: bool = False) -> str:
    if is_json_text or isinstance(dtype, T.VariantType):
        return "json"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.MapType):
        return "map"
    if isinstance(dtype, T.StructType):
        return "tuple"
    if isinstance(dtype, T.ArrayType):
        return "array"
    if isinstance(dtype, T.StringType):
        return "string"
    return "unknown"


def _struct_leaves(prefix: tuple[str, ...], dtype: T.StructType) -> Iterator[tuple[tuple[str, ...], T.DataType]]:
    for f in dtype.fields:
        path = (*prefix, f.name)
        if isinstance(f.dataType, T.StructType):
            yield from _struct_leaves(path, f.dataType)
        else:
            yield path, f.dataType


class Scope:
    """The fields of one DataFrame under one view."""

    def __init__(self, df: DataFrame, view: LogView):
        self.view = view
        self.schema = df.schema
        self._types = {f.name: f.dataType for f in df.schema.fields}
        self.fields = list(self._collect())
        self._by_display: dict[str, Field] = {}
        self._by_name: dict[str, Field] = {}
        for f in self.fields:  # columns, then struct leaves, then JSON leaves: the first one wins
            self._by_display.setdefault(f.display.lower(), f)
            self._by_name.setdefault(f.name.lower(), f)

    def _collect(self) -> Iterator[Field]:
        structs = []
        for name, dtype in self._types.items():
            if isinstance(dtype, T.StructType):
                structs.append((name, dtype))
                continue
            kind = semantic_type(dtype, name in self.view.json_columns)
            yield Field(name, name, "column", kind, dtype, quoted(name))
        for name, dtype in structs:
            for path, leaf in _struct_leaves((name,), dtype):
                yield Field(".".join(path[1:]), ".".join(path), "struct", semantic_type(leaf), leaf, quoted(*path))
        for leaf in self.view.json_leaves:
            container, _, path = leaf.partition(".")
            if container in self._types and path:
                yield self._json_field(container, path)

    def _json_field(self, container: str, path: str) -> Field:
        col = json_value(quoted(container), self._types[container], path)
        return Field(path, f"{container}.{path}", "json", "string", T.StringType(), col)

    def _map_field(self, container: str, key: str) -> Field:
        return Field(key, f"{container}.{key}", "map", "string", T.StringType(), map_value(quoted(container), key))

    @property
    def map_columns(self) -> list[str]:
        return [n for n, t in self._types.items() if isinstance(t, T.MapType)]

    @property
    def json_columns(self) -> list[str]:
        return [n for n, t in self._types.items() if isinstance(t, T.VariantType) or n in self.view.json_columns]

    def find(self, name: str) -> Field | None:
        raw = name.strip()
        low = raw.lower()
        if raw in self._types and not isinstance(self._types[raw], T.StructType):
            return next(f for f in self.fields if f.display == raw)
        hit = self._by_display.get(low) or self._by_name.get(low)
        if hit is not None:
            return hit
        hit = self._container_path(raw)
        if hit is not None:
            return hit
        for role in ROLE_ALIASES:
            target = getattr(self.view, role)
            if target and low in (role, ROLE_ALIASES[role].lower()) and target.lower() != low:
                return self.find(target)
        m = _BRACKET_ACCESS.match(raw)
        if m and m["col"] in self.map_columns:
            return self._map_field(m["col"], re.sub(r"\\(.)", r"\1", m["key"]))
        return None

    def _container_path(self, raw: str) -> Field | None:
        """``<map or JSON column>.<rest>``; the longest container name wins."""
        for make, names in ((self._map_field, self.map_columns), (self._json_field, self.json_columns)):
            fits = [n for n in names if len(raw) > len(n) + 1 and raw.lower().startswith(n.lower() + ".")]
            if fits:
                best = max(fits, key=len)
                return make(best, raw[len(best) + 1 :])
        return None

    def resolve(self, name: str) -> Resolved | None:
        field = self.find(name)
        if field is None:
            return None
        if field.source in ("map", "json"):
            kind = field.source
        else:
            kind = "text" if self.view.body and field.display == self.view.body else "exact"
        return Resolved(field.column, kind, field.dtype, field)

    def get(self, name: str) -> Resolved:
        hit = self.resolve(name)
        if hit is None:
            raise UnresolvedField(f"no field {name!r}; the table has {', '.join(self._types)}")
        return hit

    def role(self, role: str) -> Column:
        """The column mapped to a role."""
        self.view.require(role)
        return self.get(getattr(self.view, role)).column

    def role_type(self, role: str) -> T.DataType:
        return self.get(getattr(self.view, role)).dtype

    def matching(self, pattern: str) -> list[Field]:
        """Every leaf whose name or display name fits a ``*`` pattern, ignoring case."""
        rx = re.compile(".*".join(re.escape(p) for p in pattern.split("*")) + r"\Z", re.IGNORECASE)
        seen: dict[str, Field] = {}
        for f in self.fields:
            if rx.match(f.name) or rx.match(f.display):
                seen.setdefault(f.display, f)
        return list(seen.values())
