"""Attribute containers: text to typed columns, containers to dotted key/value rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.functions.fields import Scope, quoted, semantic_type
from loglattice.view import LogView

#: levels of objects that one expression opens
LEVELS = 20
_ENTRY = "array<struct<key string, value string>>"


def normalize_attrs(
    df: DataFrame, maps: Sequence[str] = (), jsons: Sequence[str] = (), bad_flags: bool = False
) -> DataFrame:
    """Text attribute columns as MAP<STRING,STRING> and VARIANT.

    Map text may use single quotes; nested values become JSON text; NULL values become ''; text
    that is no object gives an empty map.  JSON text that is no object gives ``{}``.
    ``bad_flags`` adds ``<column>_bad`` for text that was present but unusable.
    """
    new: dict[str, Column] = {}
    for c in maps:
        parsed = _object_map(quoted(c))
        new[c] = F.coalesce(F.transform_values(parsed, lambda _, v: F.coalesce(v, F.lit(""))), _empty_map())
        if bad_flags:
            new[f"{c}_bad"] = _present(quoted(c)) & parsed.isNull()
    for c in jsons:
        obj = _json_object(quoted(c))
        new[c] = F.coalesce(obj, F.parse_json(F.lit("{}")))
        if bad_flags:
            new[f"{c}_bad"] = _present(quoted(c)) & obj.isNull()
    return df.withColumns(new)


def normalize_report(df: DataFrame, maps: Sequence[str] = (), jsons: Sequence[str] = ()) -> DataFrame:
    """Per column: rows, rows with text, rows whose text was unusable."""
    cols = [*maps, *jsons]
    aggs = [F.count("*").alias("n_rows")]
    for c in cols:
        aggs.append(F.count_if(_present(quoted(c))).alias(f"p_{c}"))
        aggs.append(F.count_if(_bad(c, c in maps)).alias(f"b_{c}"))
    wide = df.agg(*aggs)
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col("n_rows"), F.col(f"p_{c}").alias("n_present"), F.col(f"b_{c}").alias("n_bad"))
            for c in cols
        ]
    )
    return wide.select(F.inline(pairs))


def _bad(c: str, is_map: bool) -> Column:
    parsed = _object_map(quoted(c)) if is_map else _json_object(quoted(c))
    return _present(quoted(c)) & parsed.isNull()


def _present(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def _object_map(text: Column) -> Column:
    """The text as a map, NULL when it is no object."""
    parsed = F.from_json(text, T.MapType(T.StringType(), T.StringType()))
    return F.when(F.ltrim(text).startswith("{"), parsed)


def _json_object(text: Column) -> Column:
    """The text as a VARIANT, NULL when it is no JSON object."""
    v = F.try_parse_json(text)
    return F.when(F.ltrim(text).startswith("{"), v)


def _empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


# --- leaves -------------------------------------------------------------------------------------

def as_variant(col: Column, dtype: T.DataType) -> Column:
    return col if isinstance(dtype, T.VariantType) else F.try_parse_json(col)


def _entries(v: Column) -> Column:
    """Members of a VARIANT object; NULL when it is no object."""
    return F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))


def _opened(path: Column, v: Column, depth: int) -> Column:
    """Leaves below one member: its own members opened in turn, or the member itself."""
    itself = F.array(F.struct(path.alias("path"), v.alias("value")))
    if depth <= 0:
        return itself
    below = F.transform(_entries(v), lambda e: _opened(F.concat(path, F.lit("."), e["key"]), e["value"], depth - 1))
    return F.coalesce(F.flatten(below), itself)


def variant_leaves(value: Column, max_depth: int) -> Column:
    """Dotted leaves of a VARIANT object as an array of (path, value), in one expression.

    Objects are opened inside the row and every node is looked at once, so nothing is shuffled.
    Arrays and scalars are leaves; an object below ``max_depth`` stays a leaf, whole.
    """
    return F.flatten(F.transform(_entries(value), lambda e: _opened(e["key"], e["value"], max_depth - 1)))


def with_leaves(df: DataFrame, name: str, value: Column, depth: int) -> DataFrame:
    """``df`` with the leaves of a VARIANT in column ``name``, opened ``depth`` levels deep.

    An expression opens a bounded number of levels; what is deeper is opened by further ones over the
    leaves so far.
    """
    df = df.withColumn(name, variant_leaves(value, min(depth, LEVELS)))
    for done in range(LEVELS, depth, LEVELS):
        more = min(LEVELS, depth - done)
        df = df.withColumn(name, _deeper(name, more))
    return df


def _deeper(name: str, levels: int) -> Column:
    return F.flatten(F.transform(quoted(name), lambda x: _opened(x["path"], x["value"], levels)))


#: what is neither a brace nor may hold one that counts: strings, and all other signs
_NO_BRACES = r'"(?:[^"\\]++|\\.)*+"|[^{}"]++'


def _nesting(text: Column) -> Column:
    """Braces of JSON text that are open at once, at most; those inside strings do not count."""
    braces = F.split(F.regexp_replace(text, _NO_BRACES, ""), "")
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))

    def step(at: Column, sign: Column) -> Column:
        now = at["open"] + F.when(sign == "{", 1).when(sign == "}", -1).otherwise(0)
        return F.struct(now.alias("open"), F.greatest(at["most"], now).alias("most"))

    return F.aggregate(braces, start, step, lambda at: at["most"])


def depth_of(df: DataFrame, column: str) -> int:
    """Levels of objects within objects in a JSON column, over all rows.

    JSON text is not parsed for it: a scan looks for a second brace, and only if there is one another
    counts how deep they nest (objects in arrays count too, which costs nothing but a level).  A VARIANT's
    leaves are opened a few levels deep, then twice as deep, until none of them is an object.
    """
    if df.isStreaming:
        raise ValueError("give max_depth for a stream")
    if isinstance(df.schema[column].dataType, T.StringType):
        text = quoted(column)
        if not df.agg(F.coalesce(F.bool_or(F.locate("{", F.ltrim(text), 2) > 0), F.lit(False))).first()[0]:
            return 1
        return max(1, df.agg(F.coalesce(F.max(_nesting(text)), F.lit(1))).first()[0])
    value, depth = as_variant(quoted(column), df.schema[column].dataType), 6
    while True:
        opened = with_leaves(df.select(value.alias("__v")), "__leaves", F.col("__v"), depth)
        left = F.exists("__leaves", lambda x: _entries(x["value"]).isNotNull())
        if not opened.agg(F.coalesce(F.bool_or(left), F.lit(False))).first()[0]:
            return depth
        depth *= 2


def leaf_text(v: Column) -> Column:
    """Strings as they are, JSON null as '', arrays and objects as JSON text, other scalars printed."""
    scalar = F.try_variant_get(v, "$", "string")
    return F.when(F.is_variant_null(v), F.lit("")).otherwise(F.coalesce(scalar, F.to_json(v)))


def _json_entries(leaves: Column, prefix: str) -> Column:
    lead = F.lit(f"{prefix}.") if prefix else F.lit("")
    return F.transform(
        leaves,
        lambda x: F.struct(F.concat(lead, x["path"]).alias("key"), leaf_text(x["value"]).alias("value")),
    )


def _map_entries(col: Column, prefix: str) -> Column:
    lead = F.lit(f"{prefix}.") if prefix else F.lit("")
    return F.transform(
        F.map_entries(col),
        lambda e: F.struct(
            F.concat(lead, e["key"].cast("string")).alias("key"),
            F.coalesce(e["value"].cast("string"), F.lit("")).alias("value"),
        ),
    )


def _named_entries(name: str) -> Column:
    """Entries of one map column as structs that also carry the column's name."""
    return F.transform(
        F.map_entries(quoted(name)),
        lambda e: F.struct(
            F.lit(name).alias("column"),
            e["key"].cast("string").alias("key"),
            F.coalesce(e["value"].cast("string"), F.lit("")).alias("value"),
        ),
    )


def flatten_map(df: DataFrame, view: LogView, columns: Sequence[str] | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """(kept columns, column, key, value) for every entry of the map columns; empty maps give no row."""
    scope = Scope(df, view)
    cols = list(columns) if columns is not None else scope.map_columns
    keep = list(view.row_id) if keep is None else list(keep)
    groups = [_named_entries(c) for c in cols]
    if not groups:
        raise ValueError("the table has no map column")
    safe = [F.coalesce(g, F.array().cast("array<struct<column string, key string, value string>>")) for g in groups]
    return df.select(*[quoted(k) for k in keep], F.inline(F.concat(*safe) if len(safe) > 1 else safe[0]))


def flatten_json(
    df: DataFrame, view: LogView, column: str, max_depth: int | None = None, keep: Sequence[str] | None = None
) -> DataFrame:
    """(kept columns, key, value) for every dotted leaf of a JSON column; non-objects give no row.

    Objects are opened as deep as the data goes, unless ``max_depth`` says where to stop.
    """
    keep = list(view.row_id) if keep is None else list(keep)
    max_depth = depth_of(df, column) if max_depth is None else max_depth
    opened = with_leaves(df, "__leaves", as_variant(quoted(column), df.schema[column].dataType), max_depth)
    return opened.select(*[quoted(k) for k in keep], F.inline(_json_entries(F.col("__leaves"), "")))


def _text(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return col
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(col)
    return col.cast("string")


def column_entries(df: DataFrame, view: LogView) -> list[tuple[str, Column]]:
    """(name, struct(key, value)) for each column, NULL values kept as NULL."""
    return [
        (f.name, F.struct(F.lit(f.name).alias("key"), _text(quoted(f.name), f.dataType).alias("value")))
        for f in df.schema.fields
    ]


def flatten_rows(
    df: DataFrame, view: LogView, keep: Sequence[str] | None = None, max_depth: int | None = None
) -> DataFrame:
    """Whole rows as (kept columns, key, value, type): plain columns printed, containers as their leaves.

    One array per row is built and exploded, so the table is read once however many containers it
    has.  A JSON column without leaves contributes no row, an empty map none.
    """
    scope = Scope(df, view)
    keep = list(view.row_id) if keep is None else list(keep)
    plain, groups, opened = [], [], df
    for f in df.schema.fields:
        if f.name in scope.map_columns:
            groups.append(_typed(_map_entries(quoted(f.name), f.name)))
        elif f.name == view.span_attributes and isinstance(f.dataType, T.StringType):  # a map as text
            groups.append(_typed(_map_entries(_object_map(quoted(f.name)), f.name)))
        elif f.name in scope.json_columns:
            depth = depth_of(df, f.name) if max_depth is None else max_depth
            leaves = f"__leaves_{f.name}"
            opened = with_leaves(opened, leaves, as_variant(quoted(f.name), f.dataType), depth)
            groups.append(_typed(_json_entries(quoted(leaves), f.name)))
        else:
            plain.append(
                F.struct(
                    F.lit(f.name).alias("key"),
                    F.coalesce(_text(quoted(f.name), f.dataType), F.lit("")).alias("value"),
                    F.lit(semantic_type(f.dataType)).alias("type"),
                )
            )
    empty = F.array().cast("array<struct<key string, value string, type string>>")
    parts = ([F.array(*plain)] if plain else []) + [F.coalesce(g, empty) for g in groups]
    return opened.select(*[quoted(k) for k in keep], F.inline(F.concat(*parts) if len(parts) > 1 else parts[0]))


def _typed(entries: Column) -> Column:
    """Container leaves are strings: neither map entries nor JSON paths declare a type."""
    return F.transform(
        entries, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.lit("string").alias("type"))
    )
