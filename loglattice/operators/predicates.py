"""Search predicates, composed in Python and bound to a table when applied.

A predicate knows nothing of a table until ``bind`` resolves its fields against a
:class:`~loglattice.functions.fields.Scope` and returns a Spark column, so the same predicate can
be applied to any table, batch or stream.  ``bind`` returning ``None`` means "ignore me": that is a
bare term on a table whose view maps no body.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.functions.coarse import coarse_literal
from loglattice.functions.fields import Resolved, Scope, UnresolvedField
from loglattice.functions.literals import as_number, bound_literal, typed_literal
from loglattice.functions.tokens import Needs, all_needed, any_needed, needed, needed_by_wildcard
from loglattice.view import LogView

Binder = Callable[[Scope], "Column | None"]


@dataclass(frozen=True)
class BodyTest:
    """One test of the body as data: an ILIKE pattern or a regular expression that must fit, or must not."""

    like: bool
    pattern: str
    wanted: bool = True
    #: what a body that fits must hold; nothing where it must not fit
    needs: Needs = None


#: alternatives above which a predicate is no longer written out as such
MOST_CLAUSES = 32


@dataclass(frozen=True)
class Predicate:
    bind: Binder
    label: str = ""
    #: words of the body without which no row can match (None: nothing is known)
    needs: Callable[[Scope], Needs] = lambda scope: None
    #: the predicate as alternatives of body tests (None: it is not about the body alone)
    clauses: Callable[[Scope], "list[tuple[BodyTest, ...]] | None"] = lambda scope: None

    def __and__(self, other: "Predicate") -> "Predicate":
        return all_of(self, other)

    def __or__(self, other: "Predicate") -> "Predicate":
        return any_of(self, other)

    def __invert__(self) -> "Predicate":
        return negate(self)

    def column(self, df: DataFrame, view: LogView) -> Column:
        bound = self.bind(Scope(df, view))
        return F.lit(True) if bound is None else bound


def filter_logs(df: DataFrame, view: LogView, *predicates: Predicate) -> DataFrame:
    """Rows meeting every predicate."""
    scope = Scope(df, view)
    for p in predicates:
        bound = p.bind(scope)
        if bound is not None:
            df = df.filter(bound)
    return df


# --- text ---------------------------------------------------------------------------------------

def escape_like(text: str) -> str:
    """Make ``\\``, ``%`` and ``_`` literal in an ILIKE pattern."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def wildcard_pattern(text: str) -> str:
    return escape_like(text).replace("*", "%")


#: Fixed value: what may stand beside a phrase.
NO_WORD = "[^a-zA-Z0-9_]"


def phrase_pattern(text: str) -> str:
    """Whole-phrase regex: no letter, digit or underscore may touch either end."""
    literal = "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return f"(?iu)(^|{NO_WORD}){literal}({NO_WORD}|$)"


def _plain_run(text: str) -> str:
    """Longest run of ASCII characters whose lower case is their only case partner.

    ``i``, ``k`` and ``s`` have further partners outside ASCII, which lower() does not fold.
    """
    return max(re.split(r"[^\x00-\x7f]|[ikIKsS]", text), key=len)


def phrase_match(col: Column, text: str) -> Column:
    hit = col.rlike(phrase_pattern(text))
    run = _plain_run(text)
    if len(run) < 2:
        return hit
    # a substring test rejects most rows before the regex runs; it never rejects a match
    return F.lower(col).contains(run.lower()) & hit


def contains_match(col: Column, text: str) -> Column:
    return col.ilike(f"%{escape_like(text)}%")


def _body(scope: Scope) -> Column | None:
    return scope.role("body") if scope.view.body else None


def _body_test(bind: Binder, label: str, test: BodyTest) -> Predicate:
    def has(scope: Scope) -> bool:
        return scope.view.body is not None

    return Predicate(bind, label, lambda s: test.needs if has(s) else None, lambda s: [(test,)] if has(s) else None)


def _like_test(text: str) -> BodyTest:
    return BodyTest(True, f"%{escape_like(text)}%", needs=needed(text, False, False))


def _phrase_test(text: str) -> BodyTest:
    return BodyTest(False, phrase_pattern(text), needs=needed(text, True, True))


def _wildcard_test(pattern: str) -> BodyTest:
    return BodyTest(True, wildcard_pattern(pattern), needs=needed_by_wildcard(pattern))


def term(text: str) -> Predicate:
    """Body contains the text, ignoring case."""

    def bind(scope: Scope):
        body = _body(scope)
        return None if body is None else contains_match(body, text)

    return _body_test(bind, text, _like_test(text))


def phrase(text: str, field: str | None = None, on_unresolved: str = "error") -> Predicate:
    """Whole phrase in the body; on any other kind of field, exact equality with the text."""
    if field is None:

        def bind(scope: Scope):
            body = _body(scope)
            return None if body is None else phrase_match(body, text)

        return _body_test(bind, f'"{text}"', _phrase_test(text))

    def on_field(r: Resolved) -> Column:
        return phrase_match(r.column, text) if r.kind == "text" else _equals(r, text, True)

    return _on(field, on_field, on_unresolved, f"{field}:{text}", _phrase_test(text))


def wildcard(pattern: str, field: str | None = None, on_unresolved: str = "error") -> Predicate:
    """``*`` stands for any run of characters; the pattern covers the whole value; case is ignored."""
    like = wildcard_pattern(pattern)
    if field is None:

        def bind(scope: Scope):
            body = _body(scope)
            return None if body is None else body.ilike(like)

        return _body_test(bind, pattern, _wildcard_test(pattern))
    on_field = lambda r: r.field.as_string().ilike(like)
    return _on(field, on_field, on_unresolved, f"{field}:{pattern}", _wildcard_test(pattern))


# --- fields -------------------------------------------------------------------------------------

def _on(field: str, build: Callable[[Resolved], Column], on_unresolved: str, raw: str, text_test: BodyTest | None = None) -> Predicate:
    """Apply ``build`` to a field; a name that is no field is an error or a search of the body.

    ``text_test`` is the test that ``build`` makes where the field is the body.
    """
    if on_unresolved not in ("error", "body"):
        raise ValueError("on_unresolved is 'error' or 'body'")

    def bind(scope: Scope):
        hit = scope.resolve(field)
        if hit is not None:
            return build(hit)
        if on_unresolved == "error":
            raise UnresolvedField(f"no field {field!r}")
        return (wildcard(raw) if "*" in raw else term(raw)).bind(scope)

    def as_body(scope: Scope) -> Predicate | None:
        hit = scope.resolve(field)
        if hit is None:
            return wildcard(raw) if "*" in raw else term(raw)
        return _body_test(bind, raw, text_test) if hit.kind == "text" and text_test is not None else None

    def needs(scope: Scope) -> Needs:
        found = as_body(scope)
        return None if found is None else found.needs(scope)

    def clauses(scope: Scope) -> list[tuple[BodyTest, ...]] | None:
        found = as_body(scope)
        return None if found is None else found.clauses(scope)

    return Predicate(bind, raw, needs, clauses)


def _equals(r: Resolved, value, quoted: bool) -> Column:
    if value is None or (value == "null" and not quoted):
        return r.column.isNull()
    if isinstance(r.dtype, (T.MapType, T.ArrayType, T.VariantType)):
        return r.field.as_string() == F.lit(str(value))
    if isinstance(value, bool):
        value = str(value).lower()
    if r.kind == "text" and not quoted:
        return contains_match(r.column, str(value))
    return r.column == typed_literal(value, r.dtype)


def eq(field: str, value, quoted: bool = False, on_unresolved: str = "error") -> Predicate:
    """Equality by kind: substring on the body, exact elsewhere.

    Unquoted ``true``/``false`` compare with a boolean column as booleans, ``null`` (or None) asks
    for NULL; ``quoted=True`` keeps them strings and turns a body test into a phrase test.
    """
    if quoted:
        return phrase(str(value), field, on_unresolved)

    def on_field(r: Resolved) -> Column:
        if r.kind == "text" and value is not None:
            return contains_match(r.column, str(value))
        return _equals(r, value, quoted)

    test = None if value is None else _like_test(str(value))
    return _on(field, on_field, on_unresolved, f"{field}:{value}", test)


def non_empty(r: Resolved) -> Column:
    """The value's string form is not empty; NULL counts as empty."""
    if isinstance(r.dtype, (T.MapType, T.ArrayType, T.VariantType)):
        return r.column.isNotNull()
    if isinstance(r.dtype, T.StringType):
        return F.coalesce(r.column, F.lit("")) != ""
    return r.column.isNotNull()


def exists(field: str) -> Predicate:
    return _on(field, non_empty, "error", f"{field}:*")


def _range(field: str, op: str, value) -> Predicate:
    num = as_number(value)

    def on_field(r: Resolved) -> Column:
        col = r.column
        if isinstance(r.dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            lit = bound_literal(value, r.dtype, op)
        elif num is not None and isinstance(r.dtype, T.NumericType):
            lit = F.lit(num)
        elif num is not None:
            col, lit = r.field.as_string().try_cast("double"), F.lit(float(num))
        elif isinstance(r.dtype, T.StringType):
            lit = F.lit(str(value))
        else:
            lit = typed_literal(value, r.dtype)
        return {"gt": col > lit, "gte": col >= lit, "lt": col < lit, "lte": col <= lit}[op]

    return _on(field, on_field, "error", f"{field} {op} {value}")


def gt(field: str, value) -> Predicate:
    return _range(field, "gt", value)


def gte(field: str, value) -> Predicate:
    return _range(field, "gte", value)


def lt(field: str, value) -> Predicate:
    return _range(field, "lt", value)


def lte(field: str, value) -> Predicate:
    return _range(field, "lte", value)


def values(field: str, first, *rest: tuple[str, object]) -> Predicate:
    """A value list ``field:(a or b and not c)``, folded from the left without precedence.

    ``values("f", "a", ("or", "b"), ("and", negate_value("c")))``.  A list joined by ``or`` alone on
    an exact field becomes one IN.
    """
    items = [first, *(v for _, v in rest)]
    joins = [j for j, _ in rest]
    if any(j not in ("and", "or") for j in joins):
        raise ValueError("values are joined by 'and' or 'or'")

    def on_field(r: Resolved) -> Column:
        plain = not any(isinstance(v, (_Not, _Quoted)) or v is None or v == "null" or "*" in str(v) for v in items)
        if plain and r.kind != "text" and "and" not in joins:
            return one_of(r, items)
        acc = _value(r, first)
        for join, v in rest:
            acc = acc & _value(r, v) if join == "and" else acc | _value(r, v)
        return acc

    return _on(field, on_field, "error", field)


def one_of(r: Resolved, items: Iterable) -> Column:
    """The value is one of a list; containers by their text, booleans spelled as in equality."""
    if isinstance(r.dtype, (T.MapType, T.ArrayType, T.VariantType)):
        return r.field.as_string().isin([str(v) for v in items])
    spelled = [str(v).lower() if isinstance(v, bool) and not isinstance(r.dtype, T.BooleanType) else v for v in items]
    return r.column.isin([typed_literal(v, r.dtype) for v in spelled])


@dataclass(frozen=True)
class _Not:
    value: object


def negate_value(value) -> _Not:
    return _Not(value)


@dataclass(frozen=True)
class _Quoted:
    text: str


def quoted_value(text: str) -> _Quoted:
    """A quoted entry of a value list: a phrase on the body, the exact string elsewhere."""
    return _Quoted(text)


def _value(r: Resolved, v) -> Column:
    if isinstance(v, _Not):
        return ~_value(r, v.value)
    if isinstance(v, _Quoted):
        return phrase_match(r.column, v.text) if r.kind == "text" else _equals(r, v.text, True)
    if isinstance(v, str) and "*" in v:
        return r.field.as_string().ilike(wildcard_pattern(v))
    return contains_match(r.column, str(v)) if r.kind == "text" and v is not None else _equals(r, v, False)


def any_field(pattern: str, make: Callable[[str], Predicate]) -> Predicate:
    """``make(field)`` holds for at least one leaf whose name fits the ``*`` pattern."""

    def bind(scope: Scope):
        hits = []
        for f in scope.matching(pattern):
            try:
                bound = make(f.display).bind(scope)
            except ValueError:
                continue  # the value is no literal of this leaf's type, so it cannot be equal
            if bound is not None:
                hits.append(bound)
        return reduce(lambda a, b: a | b, hits) if hits else F.lit(False)

    return Predicate(bind, pattern)


# --- composition --------------------------------------------------------------------------------

def _either(parts: list) -> list[tuple[BodyTest, ...]] | None:
    if any(p is None for p in parts) or sum(map(len, parts)) > MOST_CLAUSES:
        return None
    return [clause for p in parts for clause in p]


def _every(parts: list) -> list[tuple[BodyTest, ...]] | None:
    if any(p is None for p in parts) or math.prod(map(len, parts)) > MOST_CLAUSES:
        return None
    return [tuple(t for clause in chosen for t in clause) for chosen in itertools.product(*parts)]


def all_of(*preds: Predicate) -> Predicate:
    def bind(scope: Scope):
        bound = [c for c in (p.bind(scope) for p in preds) if c is not None]
        return reduce(lambda a, b: a & b, bound) if bound else None

    return Predicate(bind, " and ".join(p.label for p in preds), lambda scope: all_needed([p.needs(scope) for p in preds]), lambda scope: _every([p.clauses(scope) for p in preds]))


def any_of(*preds: Predicate) -> Predicate:
    def bind(scope: Scope):
        bound = [p.bind(scope) for p in preds]
        if any(c is None for c in bound):
            return F.lit(True) if bound else None
        return reduce(lambda a, b: a | b, bound) if bound else None

    return Predicate(bind, " or ".join(p.label for p in preds), lambda scope: any_needed([p.needs(scope) for p in preds]), lambda scope: _either([p.clauses(scope) for p in preds]))


def negate(pred: Predicate) -> Predicate:
    def bind(scope: Scope):
        bound = pred.bind(scope)
        return None if bound is None else ~bound

    def clauses(scope: Scope) -> list[tuple[BodyTest, ...]] | None:
        known = pred.clauses(scope)
        if known is None:
            return None
        return _every([[(replace(t, wanted=not t.wanted, needs=None),) for t in clause] for clause in known])

    return Predicate(bind, f"not {pred.label}", clauses=clauses)


# --- time ---------------------------------------------------------------------------------------

def time_range(from_=None, to=None, *, closed: bool = True) -> Predicate:
    """Inclusive time range (``closed=False`` leaves the end out); ignored without a timestamp.

    On a table partitioned by a truncation of the timestamp the same range, truncated, is asked of
    the partition column, so whole partitions are skipped and no matching row is lost.
    """

    def bind(scope: Scope):
        view = scope.view
        if not view.timestamp or (from_ is None and to is None):
            return None
        ts, dtype = scope.role("timestamp"), scope.role_type("timestamp")
        parts = []
        if from_ is not None:
            parts.append(ts >= bound_literal(from_, dtype, "gte"))
        if to is not None:
            hi = bound_literal(to, dtype, "lte" if closed else "lt")
            parts.append(ts <= hi if closed else ts < hi)
        if view.partition_col:
            p = scope.get(view.partition_col)
            if from_ is not None:
                parts.append(p.column >= coarse_literal(from_, view.partition_by, p.dtype))
            if to is not None:
                parts.append(p.column <= coarse_literal(to, view.partition_by, p.dtype))
        return reduce(lambda a, b: a & b, parts)

    return Predicate(bind, "time")


def where(time: tuple | None = None, search: Predicate | None = None, filters: Iterable = ()) -> Predicate:
    """Time range AND search AND every enabled filter."""
    from loglattice.operators.filters import filters_predicate

    parts = []
    if time is not None:
        parts.append(time_range(*time))
    if search is not None:
        parts.append(search)
    parts.append(filters_predicate(filters))
    return all_of(*parts)
