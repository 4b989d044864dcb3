"""Validation against the required leaf paths, and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model


def _is_leaf(value: Column) -> Column:
    return ~F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)")


def _leaf_names(doc: Column, path: str, prefix: str) -> Column:
    """Names of the scalar members of the object at a VARIANT path, prefixed."""
    members = F.try_variant_get(doc, path, "map<string,variant>")
    leaves = F.map_keys(F.map_filter(members, lambda _, value: _is_leaf(value)))
    return F.coalesce(F.transform(leaves, lambda name: F.concat(F.lit(prefix), name)), F.array().cast("array<string>"))


def _coordinate_names(doc: Column) -> Column:
    values = F.try_variant_get(doc, "$.geometry.coordinates", "array<variant>")
    names = F.transform(
        values, lambda v, i: F.when(_is_leaf(v), F.concat(F.lit("geometry_coordinates_"), i.cast("string")))
    )
    return F.coalesce(names, F.array().cast("array<string>"))


def validate_docs(docs: DataFrame) -> DataFrame:
    """Add ``missing ARRAY<STRING>`` and ``valid BOOLEAN``; null leaves count as present."""
    doc = F.col("doc")
    present = F.concat(
        _leaf_names(doc, "$", ""),
        _leaf_names(doc, "$.properties", "properties_"),
        _leaf_names(doc, "$.properties.measurements[0]", "properties_measurements_0_"),
        _leaf_names(doc, "$.properties.data[0]", "properties_data_0_"),
        _leaf_names(doc, "$.geometry", "geometry_"),
        _coordinate_names(doc),
    )
    required = F.array(*map(F.lit, model.REQUIRED_LEAVES))
    return docs.withColumn("missing", F.array_except(required, present)).withColumn("valid", F.size("missing") == 0)


def accepted(docs: DataFrame) -> DataFrame:
    """Documents that pass validation."""
    return validate_docs(docs).where("valid").drop("missing", "valid")


def reject_docs(docs: DataFrame) -> DataFrame:
    """``_file, reason`` of documents that are unreadable or incomplete."""
    reason = F.when(F.col("doc").isNull(), "not valid JSON").otherwise(
        F.concat(F.lit("missing: "), F.array_join("missing", ", "))
    )
    return validate_docs(docs).where(~F.col("valid")).select("_file", reason.alias("reason"))
