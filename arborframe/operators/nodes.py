"""Leaves and keyed values of documents at any depth.

The walk itself runs in Arrow batches on the executors; every condition on the
values is a Spark expression.
"""

from __future__ import annotations

import json
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..functions import scalars, workers

COMPARATORS = {
    "lt": operator.lt,
    "le": operator.le,
    "eq": operator.eq,
    "ne": operator.ne,
    "ge": operator.ge,
    "gt": operator.gt,
}


def _comparator(name: str):
    if name not in COMPARATORS:
        raise ValueError(f"unknown comparator {name!r}; use one of {', '.join(COMPARATORS)}")
    return COMPARATORS[name]


def _keyed_text(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataType]:
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")), docs.schema[key].dataType


def flatten_docs(docs: DataFrame, key: str = "_id_x", text: str = "raw") -> DataFrame:
    """One row per leaf: ``path`` joined by ``_``, the unambiguous ``exact_path``, ``value``, ``type``.

    Empty objects and arrays leave no row; null leaves do.
    """
    pairs, kind = _keyed_text(docs, key, text)
    leaves = pairs.mapInArrow(workers.leaf_rows, f"key {kind.simpleString()}, {workers.LEAF_FIELDS}")
    return leaves.withColumnRenamed("key", key)


def _may_hold(text: Column, name: str) -> Column:
    """False only for a text without the key: it is neither there in quotes nor spelt with escapes."""
    plain = text.contains(json.dumps(name, ensure_ascii=False))
    always_escaped = any(c in '"\\/' or ord(c) < 32 for c in name)
    return plain | text.contains("\\" if always_escaped else "\\u")


def extract_key(docs: DataFrame, name: str, key: str = "_id_x", text: str = "raw") -> DataFrame:
    """Every value stored under ``name``, parents before children (``ord``).

    Only texts that may hold the key are walked.
    """
    pairs, kind = _keyed_text(docs, key, text)
    nodes = pairs.where(_may_hold(F.col("text"), name)).mapInArrow(workers.node_rows([name]), f"key {kind.simpleString()}, {workers.NODE_FIELDS}")
    return nodes.withColumnRenamed("key", key)


def extract_key_regex(docs: DataFrame, name: str, regex: str, **columns: str) -> DataFrame:
    """Text values under ``name`` matching a regular expression, ignoring case."""
    return extract_key(docs, name, **columns).where((F.col("type") == "string") & F.col("value").rlike(f"(?i){regex}"))


def extract_key_exact(docs: DataFrame, name: str, value: str | float | bool | None, **columns: str) -> DataFrame:
    """Values under ``name`` equal to ``value`` (same JSON type)."""
    nodes = extract_key(docs, name, **columns)
    if value is None:
        return nodes.where(F.col("type") == "null")
    if isinstance(value, bool):
        return nodes.where((F.col("type") == "boolean") & (F.col("value") == str(value).lower()))
    if isinstance(value, str):
        return nodes.where((F.col("type") == "string") & (F.col("value") == value))
    return nodes.where((F.col("type") == "number") & (F.col("value").try_cast("double") == float(value)))


def extract_key_numeric(docs: DataFrame, name: str, op: str, value: float, **columns: str) -> DataFrame:
    """Numbers, or texts holding one, under ``name`` for which ``op`` holds."""
    number = F.when(F.col("type").isin("number", "string"), scalars.number(F.col("value")))
    return extract_key(docs, name, **columns).where(_comparator(op)(number, F.lit(float(value))))


def extract_key_date(docs: DataFrame, name: str, op: str, day: str, **columns: str) -> DataFrame:
    """``Y-M-D`` texts under ``name`` for which ``op`` holds; other values are ignored."""
    found = F.when(F.col("type") == "string", scalars.lenient_date(F.col("value")))
    return extract_key(docs, name, **columns).where(_comparator(op)(found, F.lit(day).cast("date")))
