"""Document filters as Spark predicates.

``compile_filter`` folds a filter document such as
``{"properties.data": {"$elemMatch": {"mode": "TLS", "quality": {"$lte": 2}}}}``
into one boolean Column.  What a path means is decided by a *scope*: a columnar
document, one array element, a VARIANT, or relational header + element tables.

Rules that every scope keeps:

* a path through an array holds if any element satisfies it, and several
  operators on a path are judged independently of each other;
* ``$elemMatch`` binds its conditions to one element;
* comparisons only match values of the same type; null never compares;
* ``$ne``/``$nin``/``$not``/``$nor`` negate the whole any-element test, so a
  document without the key matches;
* ``$exists`` tests the key, not the value;
* an array or object equals a value with the same members (of an object in any order).

SQL's unknown is harmless in a ``where`` unless it is negated, so it is turned
into false exactly there (``_negate``); leaves stay bare and push down.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import geo
from ..model import FLAG, NUMBER, TEXT
from . import values

_COMPARISONS = {"$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}
_LOGICAL = ("$and", "$or", "$nor")


def _negate(condition: Column) -> Column:
    return ~F.coalesce(condition, F.lit(False))


def _all(conditions: list[Column]) -> Column:
    return reduce(operator.and_, conditions) if conditions else F.lit(True)


def _any(conditions: list[Column]) -> Column:
    return reduce(operator.or_, conditions) if conditions else F.lit(False)


def kind_of(value: Any) -> str:
    if isinstance(value, bool):
        return FLAG
    if isinstance(value, (int, float)):
        return NUMBER
    if isinstance(value, str):
        return TEXT
    raise ValueError(f"cannot compare with a value of type {type(value).__name__}: {value!r}")


# ---------------------------------------------------------------- scopes
class ElementScope:
    """Fields of one array element: typed columns or struct members.

    ``complete`` says that the fields hold everything the element may contain
    (relational tables).  Otherwise a question they cannot answer raises
    ``KeyError`` and the caller turns to the VARIANT.
    """

    def __init__(
        self,
        value: Callable[[str], Column],
        has: Callable[[str], Column],
        fields: Mapping[str, str],
        complete: bool = False,
    ):
        self._value, self._has, self._fields, self._complete = value, has, fields, complete

    def _unanswered(self, path: str) -> Column:
        if not self._complete:
            raise KeyError(path)
        return F.lit(False)

    def any(self, path: str, kind: str, test: Callable[[Column], Column]) -> Column:
        return test(self._value(path)) if self._fields.get(path) == kind else self._unanswered(path)

    def has(self, path: str) -> Column:
        return self._unanswered(path) if "." in path else self._has(path)

    def is_null(self, path: str) -> Column:
        if self._complete and path in self._fields:
            return self._has(path) & self._value(path).isNull()
        return self._unanswered(path)

    def lacks(self, path: str) -> Column:
        return F.lit(False)  # an element is no array: ``has`` says it all

    def size(self, path: str, n: int) -> Column:
        return self._unanswered(path)

    def value(self, path: str, test: Callable[[Column], Column]) -> Column:
        return self._unanswered(path)

    def element(self, path: str, build: Callable) -> Column:
        return self._unanswered(path)

    def itself(self) -> ValueScope:
        self._unanswered("")
        return ValueScope(None)


class ValueScope:
    """A bare array member, addressed by the empty path; ``None`` for a member that is an object."""

    def __init__(self, value: Column | None):
        self._value = value

    def any(self, path: str, kind: str, test: Callable[[Column], Column]) -> Column:
        return F.lit(False) if self._value is None else test(model.typed(self._value, kind))

    def has(self, path: str) -> Column:
        return F.lit(True)

    def is_null(self, path: str) -> Column:
        return F.lit(False) if self._value is None else F.is_variant_null(self._value)

    def lacks(self, path: str) -> Column:
        return F.lit(False)

    def size(self, path: str, n: int) -> Column:
        return F.lit(False) if self._value is None else F.size(model.as_array(self._value)) == n

    def value(self, path: str, test: Callable[[Column], Column]) -> Column:
        return F.lit(False) if self._value is None else test(self._value)

    def element(self, path: str, build: Callable) -> Column:
        if self._value is None:
            return F.lit(False)
        return F.exists(model.as_array(self._value), lambda v: build(VariantScope(v)))


class VariantScope:
    """Any path of a VARIANT value, with array fan-out at every step."""

    def __init__(self, value: Column):
        self._root = value

    def values(self, path: str) -> Column:
        return reduce(self._step, path.split("."), F.array(self._root))

    @staticmethod
    def _step(found: Column, name: str) -> Column:
        opened = F.flatten(F.transform(found, lambda v: F.coalesce(model.as_array(v), F.array(v))))
        below = F.transform(opened, lambda v: model.child(v, name))
        if name.isdigit():  # a number also addresses an array position
            below = F.concat(below, F.transform(found, lambda v: F.try_variant_get(v, f"$[{name}]", "variant")))
        return F.filter(below, lambda v: v.isNotNull())

    def leaves(self, path: str) -> Column:
        none = F.array().cast("array<variant>")
        return F.flatten(
            F.transform(self.values(path), lambda v: F.concat(F.array(v), F.coalesce(model.as_array(v), none)))
        )

    def any(self, path: str, kind: str, test: Callable[[Column], Column]) -> Column:
        return F.exists(self.leaves(path), lambda v: test(model.typed(v, kind)))

    def has(self, path: str) -> Column:
        return F.size(self.values(path)) > 0

    def is_null(self, path: str) -> Column:
        return F.exists(self.leaves(path), lambda v: F.is_variant_null(v))

    def lacks(self, path: str) -> Column:
        """Some array element on the way is an object without the next key."""
        found, missing = F.array(self._root), []
        for name in path.split("."):
            none = F.array().cast("array<variant>")
            members = F.flatten(F.transform(found, lambda v: F.coalesce(model.as_array(v), none)))
            if not name.isdigit():
                missing.append(
                    F.exists(members, lambda v: F.schema_of_variant(v).startswith("OBJECT") & model.child(v, name).isNull())
                )
            found = self._step(found, name)
        return _any(missing)

    def size(self, path: str, n: int) -> Column:
        return F.exists(self.values(path), lambda v: F.size(model.as_array(v)) == n)

    def value(self, path: str, test: Callable[[Column], Column]) -> Column:
        """A value under the path, or a member of one that is an array, passes the test."""
        return F.exists(self.leaves(path), test)

    def itself(self) -> ValueScope:
        return ValueScope(self._root)

    def element(self, path: str, build: Callable) -> Column:
        none = F.array().cast("array<variant>")
        members = F.flatten(F.transform(self.values(path), lambda v: F.coalesce(model.as_array(v), none)))
        return F.exists(members, lambda v: build(VariantScope(v)))


class DocumentScope:
    """Columnar documents: typed leaves where they exist, the VARIANT otherwise."""

    def __init__(self, columns: Sequence[str] = ()) -> None:
        self._variant, self._columns = VariantScope(F.col("doc")), frozenset(columns)

    @staticmethod
    def _member(path: str) -> tuple[str, str, Mapping[str, str]] | None:
        for prefix, (column, fields) in model.ARRAYS.items():
            if path.startswith(prefix + "."):
                return column, path[len(prefix) + 1 :], fields
        return None

    def any(self, path: str, kind: str, test: Callable[[Column], Column]) -> Column:
        if path in model.SCALARS:
            stored, column = model.SCALARS[path]
            if stored == kind:
                return test(F.col(column))
            if path in model.METADATA:
                return F.lit(False)
        member = self._member(path)
        if member and member[2].get(member[1]) == kind:
            return F.exists(F.col(f"{member[0]}.`{member[1]}`"), test)
        return self._variant.any(path, kind, test)

    def has(self, path: str) -> Column:
        if path in model.METADATA:
            return F.col(path).isNotNull()
        member = self._member(path)
        if member and "." not in member[1]:
            return F.exists(F.col(f"{member[0]}._keys"), lambda keys: F.array_contains(keys, member[1]))
        above, _, name = path.rpartition(".")
        if above == "properties" and model.SHAPE in self._columns and (held := model.shape_holds(name)) is not None:
            return held
        return self._variant.has(path)

    def is_null(self, path: str) -> Column:
        return F.col(path).isNull() if path in model.METADATA else self._variant.is_null(path)

    def lacks(self, path: str) -> Column:
        if path in model.METADATA:
            return F.lit(False)
        member = self._member(path)
        if member and "." not in member[1]:
            return F.exists(F.col(f"{member[0]}._keys"), lambda keys: ~F.array_contains(keys, member[1]))
        return self._variant.lacks(path)

    def size(self, path: str, n: int) -> Column:
        return self._variant.size(path, n)

    def value(self, path: str, test: Callable[[Column], Column]) -> Column:
        return F.lit(False) if path in model.METADATA else self._variant.value(path, test)

    def element(self, path: str, build: Callable) -> Column:
        if path not in model.ARRAYS:
            return self._variant.element(path, build)
        column, fields = model.ARRAYS[path]
        used: dict[str, None] = {}

        def note(name: str) -> Column:
            used[name] = None
            return F.col(f"{column}.`{name}`")

        try:  # first pass finds the members needed, so that only those are read
            build(ElementScope(note, lambda name: F.array_contains(note("_keys"), name), fields))
        except KeyError:
            return self._variant.element(path, build)
        if not used:
            used["_keys"] = None
        members = F.arrays_zip(*[F.col(f"{column}.`{name}`") for name in used])
        return F.exists(
            members,
            lambda e: build(ElementScope(lambda n: e.getField(n), lambda n: F.array_contains(e["_keys"], n), fields)),
        )

    def point(self) -> tuple[Column, Column]:
        return F.col("lon"), F.col("lat")


class RelationalScope:
    """Header + element tables.  Element conditions are collected as named flags."""

    def __init__(self, docs: model.RelationalDocs):
        self._docs = docs
        self.flags: dict[str, dict[str, Column]] = {}

    def _flag(self, table: str, condition: Column) -> Column:
        flags = self.flags.setdefault(table, {})
        name = f"_{table}_{len(flags)}"
        flags[name] = condition
        return F.col(name)

    def _member(self, path: str) -> tuple[str, str, Mapping[str, model.ElementField]]:
        for prefix, (table, fields) in self._docs.arrays.items():
            if path.startswith(prefix + "."):
                return table, path[len(prefix) + 1 :], fields
        raise ValueError(f"no such path in these tables: {path}")

    @staticmethod
    def _element(fields: Mapping[str, model.ElementField]) -> ElementScope:
        return ElementScope(
            lambda name: fields[name].value,
            lambda name: fields[name].has() if name in fields else F.lit(False),
            {name: f.kind for name, f in fields.items()},
            complete=True,
        )

    def any(self, path: str, kind: str, test: Callable[[Column], Column]) -> Column:
        if path in self._docs.scalars:
            stored, column = self._docs.scalars[path]
            return test(F.col(column)) if stored == kind else F.lit(False)
        table, name, fields = self._member(path)
        if name not in fields or fields[name].kind != kind:
            return F.lit(False)
        return self._flag(table, test(fields[name].value))

    def moment(self, path: str) -> Callable[[Callable[[Column], Column]], Column] | None:
        """For a path with a stored date: a function that turns a test of it into an any-element condition."""
        if path in self._docs.scalars:
            return None
        table, name, fields = self._member(path)
        stored = fields[name].moment if name in fields else None
        return None if stored is None else lambda test: self._flag(table, test(stored))

    def has(self, path: str) -> Column:
        if path in self._docs.scalars:
            return F.col(self._docs.scalars[path][1]).isNotNull()
        table, name, fields = self._member(path)
        return self._flag(table, fields[name].has()) if name in fields else F.lit(False)

    def is_null(self, path: str) -> Column:
        if path in self._docs.scalars:
            return F.col(self._docs.scalars[path][1]).isNull()
        table, name, fields = self._member(path)
        return self._flag(table, self._element(fields).is_null(name)) if name in fields else F.lit(False)

    def lacks(self, path: str) -> Column:
        if path in self._docs.scalars:
            return F.lit(False)
        table, name, fields = self._member(path)
        return self._flag(table, _negate(fields[name].has())) if name in fields else F.lit(False)

    def size(self, path: str, n: int) -> Column:
        raise ValueError(f"$size on {path} needs columnar documents")

    def value(self, path: str, test: Callable[[Column], Column]) -> Column:
        raise ValueError(f"arrays, objects and their types under {path} need columnar documents")

    def element(self, path: str, build: Callable) -> Column:
        if path not in self._docs.arrays:
            raise ValueError(f"no such array in these tables: {path}")
        table, fields = self._docs.arrays[path]
        return self._flag(table, build(self._element(fields)))

    def point(self) -> tuple[Column, Column]:
        return F.col("lon"), F.col("lat")


# ---------------------------------------------------------------- the fold
def compile_filter(query: Mapping[str, Any], scope) -> Column:
    """Boolean Column for a filter document; raises ``ValueError`` on a bad one."""
    if not isinstance(query, Mapping):
        raise ValueError(f"a filter must be a mapping, got {type(query).__name__}")
    terms = []
    for key, spec in query.items():
        if key in _LOGICAL:
            if not isinstance(spec, (list, tuple)) or not spec:
                raise ValueError(f"{key} needs a non-empty list of filters")
            parts = [compile_filter(part, scope) for part in spec]
            terms.append({"$and": _all, "$or": _any, "$nor": lambda p: _negate(_any(p))}[key](parts))
        elif key.startswith("$"):
            raise ValueError(f"unknown top-level operator {key}")
        else:
            terms.append(_field(key, spec, scope))
    return _all(terms)


def _field(path: str, spec: Any, scope) -> Column:
    if not isinstance(spec, Mapping):
        return _equals(path, spec, scope)
    if not any(name.startswith("$") for name in spec):
        return _equals(path, spec, scope)
    if not all(name.startswith("$") for name in spec):
        raise ValueError(f"operators and keys are mixed for {path}: {spec!r}")
    return _all([_operator(path, name, value, spec, scope) for name, value in spec.items() if name != "$options"])


def _equals(path: str, value: Any, scope) -> Column:
    if value is None:  # matches a null value and a missing key alike, in any element
        return _negate(scope.has(path)) | _any([F.coalesce(c, F.lit(False)) for c in (scope.is_null(path), scope.lacks(path))])
    if isinstance(value, (Mapping, list, tuple)):
        return scope.value(path, lambda v: values.equals(v, value))
    return scope.any(path, kind_of(value), lambda c: c == F.lit(value))


def _one_of(path: str, wanted: Any, scope) -> Column:
    if not isinstance(wanted, (list, tuple)):
        raise ValueError(f"$in/$nin on {path} need a list")
    by_kind: dict[str, list[Any]] = {}
    whole = [value for value in wanted if isinstance(value, (Mapping, list, tuple))]
    for value in wanted:
        if value is not None and not isinstance(value, (Mapping, list, tuple)):
            by_kind.setdefault(kind_of(value), []).append(value)

    def listed(members: list[Any]) -> Callable[[Column], Column]:
        return lambda c: c.isin(members)

    tests = [scope.any(path, kind, listed(members)) for kind, members in by_kind.items()]
    tests += [_equals(path, value, scope) for value in whole]
    return _any(tests + [_equals(path, None, scope)] if None in wanted else tests)


def _regex(path: str, pattern: Any, options: str, scope) -> Column:
    if not isinstance(pattern, str):
        raise ValueError(f"$regex on {path} needs a string")
    flags = f"(?{options})" if options else ""
    return scope.any(path, TEXT, lambda c: c.rlike(flags + pattern))


def _of_type(path: str, given: Any, scope) -> Column:
    """``$type``: a name or number of a type, or a list of them; typed columns answer what they can."""
    names = [values.type_name(one) for one in (given if isinstance(given, (list, tuple)) else [given])]
    if not names:
        raise ValueError(f"$type on {path} needs a type")
    simple = {"string": TEXT, "number": NUMBER, "bool": FLAG}

    def one(name: str) -> Column:
        if name in simple:
            return scope.any(path, simple[name], lambda c: c.isNotNull())
        return scope.is_null(path) if name == "null" else scope.value(path, lambda v: values.has_type(v, name))

    return _any([F.coalesce(one(name), F.lit(False)) for name in names])


def _operator(path: str, name: str, value: Any, spec: Mapping[str, Any], scope) -> Column:
    if name in _COMPARISONS:
        return scope.any(path, kind_of(value), lambda c: _COMPARISONS[name](c, F.lit(value)))
    if name == "$eq":
        return _equals(path, value, scope)
    if name == "$ne":
        return _negate(_equals(path, value, scope))
    if name == "$in":
        return _one_of(path, value, scope)
    if name == "$nin":
        return _negate(_one_of(path, value, scope))
    if name == "$regex":
        return _regex(path, value, spec.get("$options", ""), scope)
    if name == "$exists":
        found = scope.has(path)
        return found if value else _negate(found)
    if name == "$not":
        return _negate(_field(path, value, scope))
    if name == "$elemMatch":
        if isinstance(value, Mapping) and value and all(key.startswith("$") and key not in _LOGICAL for key in value):
            return scope.element(path, lambda inner: _field("", value, inner.itself()))
        return scope.element(path, lambda inner: compile_filter(value, inner))
    if name == "$all":
        if not isinstance(value, (list, tuple)):
            raise ValueError(f"$all on {path} needs a list")
        return _all([_equals(path, member, scope) for member in value]) if value else F.lit(False)
    if name == "$type":
        return _of_type(path, value, scope)
    if name == "$size":
        return scope.size(path, int(value))
    if name == "$mod":
        divisor, rest = value
        return scope.any(path, NUMBER, lambda c: F.try_mod(c.cast("bigint"), F.lit(int(divisor))) == int(rest))
    if name == "$geoWithin":
        return geo.within_polygon(value["$geometry"], *scope.point())
    if name == "$nearSphere":
        return geo.within_distance(value["$geometry"], value.get("$maxDistance", 0.0), *scope.point())
    raise ValueError(f"unknown operator {name} on {path}")


# ---------------------------------------------------------------- application
def where(docs, query: Mapping[str, Any]) -> DataFrame:
    """Documents matching a filter, for either layout."""
    return where_scope(docs, lambda scope: compile_filter(query, scope))


def where_scope(docs, build: Callable[[Any], Column]) -> DataFrame:
    """Documents for which ``build(scope)`` holds.

    Columnar documents: a plain ``where``.  Relational documents: each element
    table is scanned once, rows that meet no condition are dropped at the scan,
    and the rest is reduced to one row of flags per document.  ``bool_or``
    combines map-side, so a document owning a third of the rows sends one
    partial row per task.
    """
    if isinstance(docs, DataFrame):
        return docs.where(build(DocumentScope(docs.columns)))
    scope = RelationalScope(docs)
    condition = build(scope)
    return _with_flags(docs, scope).where(condition).select(*docs.header.columns)


def with_conditions(docs, queries: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """All documents plus one boolean column per named filter, from one scan."""
    scope = DocumentScope(docs.columns) if isinstance(docs, DataFrame) else RelationalScope(docs)
    held = {name: F.coalesce(compile_filter(q, scope), F.lit(False)) for name, q in queries.items()}
    if isinstance(docs, DataFrame):
        return docs.withColumns(held)
    return _with_flags(docs, scope).select(*docs.header.columns, *[c.alias(name) for name, c in held.items()])


def _with_flags(docs: model.RelationalDocs, scope: RelationalScope) -> DataFrame:
    joined = docs.header
    for table, flags in scope.flags.items():
        hits = (
            docs.tables[table]
            .where(_any(list(flags.values())))
            .groupBy(F.col(docs.element_key).alias(docs.key))
            .agg(*[F.bool_or(c).alias(name) for name, c in flags.items()])
        )
        joined = joined.join(hits, docs.key, "left")
    return joined
