"""Relational views of the nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from .stats import measurement_keys

MEASUREMENTS = "properties.measurements"


def _plain(value: Column) -> Column:
    """VARIANT as CSV text: strings bare, null as NULL, anything else as JSON."""
    return F.when(~F.is_variant_null(value), F.coalesce(model.typed(value, model.TEXT), F.to_json(value)))


def tree_general(docs: DataFrame) -> DataFrame:
    """One row per tree; ``x, y, z, xyz_crs`` only if any tree has a position.

    Of several positions in a tree the last one counts.
    """
    base = [
        F.col("id").alias("tree_id"),
        "species",
        F.col("lat").alias("lat_epsg4326"),
        F.col("lon").alias("long_epsg4326"),
        F.col("elev").alias("elev_epsg4326"),
    ]
    if not docs.agg(F.bool_or(F.col(model.POSITION).isNotNull()).alias("any")).first()["any"]:
        return docs.select(*base)
    place = [F.col(f"{model.POSITION}.{n}").alias(n) for n in "xyz"]
    return docs.select(*base, *place, F.col(f"{model.POSITION}.crs").alias("xyz_crs"))


def tree_metrics(docs: DataFrame) -> DataFrame:
    """One row per measurement with a source: ``tree_id`` and every measurement key.

    The columns are the keys that occur anywhere, sorted, so their number is
    the width of the result and fits the driver.
    """
    keys = {row["key"] for row in measurement_keys(docs).collect()}
    if "position_xyz" in keys:
        keys -= {"crs", "position_xyz"}
    rows = model.variant_elements(docs, MEASUREMENTS, F.col("id").alias("tree_id"))
    sourced = rows.where(model.child(F.col("element"), "source").isNotNull())
    return sourced.select("tree_id", *[_plain(model.child(F.col("element"), k)).alias(k) for k in sorted(keys)])
