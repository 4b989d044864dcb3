"""Whole JSON values: equality with arrays and objects, type tests, and an order over all types."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..model import FLAG, NUMBER, TEXT

# ---------------------------------------------------------------- equality
def equals(value: Column, wanted: Any) -> Column:
    """A VARIANT equals a JSON value: numbers by value, arrays by order, objects by their members in any order."""
    if wanted is None:
        return F.is_variant_null(value)
    if isinstance(wanted, bool):
        return model.typed(value, FLAG) == F.lit(wanted)
    if isinstance(wanted, (int, float)):
        return model.typed(value, NUMBER) == F.lit(float(wanted))
    if isinstance(wanted, str):
        return model.typed(value, TEXT) == F.lit(wanted)
    if isinstance(wanted, (list, tuple)):
        parts = [F.size(model.as_array(value)) == len(wanted)]
        parts += [equals(F.try_variant_get(value, f"$[{i}]", "variant"), member) for i, member in enumerate(wanted)]
    elif isinstance(wanted, Mapping):
        parts = [F.schema_of_variant(value).startswith("OBJECT"), F.size(model.as_map(value)) == len(wanted)]
        parts += [equals(model.child(value, name), member) for name, member in wanted.items()]
    else:
        raise ValueError(f"cannot compare with a value of type {type(wanted).__name__}: {wanted!r}")
    return reduce(and_, [F.coalesce(part, F.lit(False)) for part in parts])


# ---------------------------------------------------------------- types
# Names and numbers of the document types.
TYPE_NUMBERS = {1: "double", 2: "string", 3: "object", 4: "array", 8: "bool", 10: "null", 16: "int", 18: "long"}
TYPE_NAMES = (*TYPE_NUMBERS.values(), "number")


def type_name(given: Any) -> str:
    name = TYPE_NUMBERS.get(given) if isinstance(given, int) and not isinstance(given, bool) else given
    if name not in TYPE_NAMES:
        raise ValueError(f"unknown type {given!r}")
    return name


def has_type(value: Column, name: str) -> Column:
    """A VARIANT is of this type; whole numbers written without a point are int or long, by their size."""
    stored = F.schema_of_variant(value)
    whole = stored == "BIGINT"
    small = F.try_variant_get(value, "$", "bigint").between(-(1 << 31), (1 << 31) - 1)
    return {
        "string": stored == "STRING",
        "bool": stored == "BOOLEAN",
        "null": F.is_variant_null(value),
        "array": stored.startswith("ARRAY"),
        "object": stored.startswith("OBJECT"),
        "number": model.typed(value, NUMBER).isNotNull(),
        "double": ~whole & model.typed(value, NUMBER).isNotNull(),
        "int": whole & small,
        "long": whole & ~small,
    }[name]


# ---------------------------------------------------------------- order
def _ranked(rank: int, number: Column | None = None, text: Column | None = None) -> Column:
    number, text = (F.lit(None) if c is None else c for c in (number, text))
    return F.struct(F.lit(rank).alias("rank"), number.cast("double").alias("number"), text.cast("string").alias("text"))


NOTHING, NULL, NUMBERS, TEXTS, OBJECTS, ARRAYS, FLAGS = range(7)  # an empty array comes before everything


def value_key(value: Column) -> Column:
    """Sortable form of a VARIANT: null, numbers, text, objects, arrays, booleans. Objects and arrays compare by their text."""
    stored = F.schema_of_variant(value)
    return (
        F.when(F.is_variant_null(value), _ranked(NULL))
        .when(stored == "STRING", _ranked(TEXTS, text=F.try_variant_get(value, "$", "string")))
        .when(stored == "BOOLEAN", _ranked(FLAGS, F.try_variant_get(value, "$", "boolean").cast("int")))
        .when(stored.startswith("OBJECT"), _ranked(OBJECTS, text=F.to_json(value)))
        .when(stored.startswith("ARRAY"), _ranked(ARRAYS, text=F.to_json(value)))
        .otherwise(_ranked(NUMBERS, F.try_variant_get(value, "$", "double")))
    )


def sort_key(docs: DataFrame, path: str, way: int = 1) -> Column:
    """Sort column for a dotted path through arrays, ascending (1) or descending (-1).

    A document with several values counts by its least one when ascending and by
    its greatest one when descending; a missing value counts as null.
    """
    from .match import VariantScope

    kind, column = model.SCALARS.get(path, (None, None))
    typed = None if column not in docs.columns else {TEXT: _ranked(TEXTS, text=F.col(column)), NUMBER: _ranked(NUMBERS, F.col(column))}.get(kind)
    if path in model.METADATA:
        return F.col(path).asc_nulls_first() if way > 0 else F.col(path).desc_nulls_last()
    if "doc" in docs.columns:
        scope = VariantScope(F.col("doc"))

        def keys(value: Column) -> Column:
            members = model.as_array(value)
            several = F.when(F.size(members) == 0, F.array(_ranked(NOTHING))).otherwise(F.transform(members, value_key))
            return F.when(members.isNotNull(), several).otherwise(F.array(value_key(value)))

        found = F.flatten(F.transform(scope.values(path), keys))
        found = F.concat(found, F.when(scope.lacks(path), F.array(_ranked(NULL))).otherwise(F.filter(found, lambda k: F.lit(False))))
        general = F.coalesce(F.array_min(found) if way > 0 else F.array_max(found), _ranked(NULL))
        key = general if typed is None else F.when(F.col(column).isNotNull(), typed).otherwise(general)
    elif typed is not None:
        key = F.when(F.col(column).isNotNull(), typed).otherwise(_ranked(NULL))
    else:
        raise ValueError(f"these documents have no {path} to sort by")
    return key.asc() if way > 0 else key.desc()
