"""Statistics, distinct values, histograms and map clusters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import geo
from .access import header
from .match import VariantScope, with_conditions


def stats(docs) -> DataFrame:
    """``n_trees, n_species``."""
    return header(docs).agg(
        F.count(F.lit(1)).alias("n_trees"), F.count_distinct("species").alias("n_species")
    )


def list_species(docs) -> DataFrame:
    return header(docs).where(F.col("species").isNotNull()).select("species").distinct()


def distinct_any_path(docs, path: str) -> DataFrame:
    """Distinct values (as text) at any dotted path, arrays unwound."""
    if isinstance(docs, model.RelationalDocs):
        if path in docs.scalars:
            values = docs.header.select(F.col(docs.scalars[path][1]).cast("string").alias("value"))
        else:
            array, _, name = path.rpartition(".")
            values = docs.rows(array).select(F.col(name).cast("string").alias("value"))
        return values.where(F.col("value").isNotNull()).distinct()
    if path in model.SCALARS:
        values = docs.select(F.col(model.SCALARS[path][1]).cast("string").alias("value"))
    else:
        leaves = VariantScope(F.col("doc")).leaves(path)
        text = F.transform(leaves, lambda v: F.coalesce(model.typed(v, model.TEXT), F.to_json(v)))
        values = docs.select(F.explode(F.array_distinct(text)).alias("value"))
    return values.where(F.col("value").isNotNull()).distinct()


def shared_properties(docs: DataFrame) -> DataFrame:
    """Keys of ``properties`` present in every document, sorted.

    The documents are counted by shape, and only the shapes are looked into.
    """
    shapes = docs.where(~F.col(model.SHAPE).startswith("*")).groupBy(model.SHAPE).agg(F.count(F.lit(1)).alias("n"))
    keys = shapes.select(F.explode(F.from_json(model.SHAPE, "array<string>")).alias("key"), "n")
    total = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    counted = keys.groupBy("key").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") == total).select("key").orderBy("key")


def measurement_keys(docs: DataFrame) -> DataFrame:
    """Union of the keys of all measurements."""
    keys = F.array_distinct(F.flatten(F.filter(F.col("measurements._keys"), lambda k: k.isNotNull())))
    return docs.select(F.explode(keys).alias("key")).distinct()


def count_by(docs, groups: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Number of documents per named filter, all from one scan: ``name, n``."""
    names = list(groups)
    counts = with_conditions(docs, groups).agg(*[F.count_if(F.col(name)).alias(name) for name in names])
    return counts.unpivot([], names, "name", "n")


def histogram(rows: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between minimum and maximum, the last one closed: ``bin, n``.

    Empty bins are left out; a single distinct value falls into the middle bin.
    """
    values = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    ends = values.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    low, high = ends.select("low").scalar(), ends.select("high").scalar()
    place = F.floor((F.col("v") - low) / (high - low) * bins)
    number = F.when(low == high, F.lit(bins // 2)).otherwise(F.least(place, F.lit(bins - 1))).cast("int")
    return values.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def species_crown_height(docs: DataFrame, element: Mapping[str, Any] | None = None) -> tuple[DataFrame, DataFrame]:
    """Crown diameter against height: the points, and a summary per species."""
    chosen = {"source": "ULS", "canopy_condition": "leaf-on"} if element is None else dict(element)
    rows = model.elements(docs, "properties.measurements", "_id_x", "species")
    both = F.array_contains("_keys", "height_m") & F.array_contains("_keys", "mean_crown_diameter_m")
    for name, wanted in chosen.items():
        both = both & (F.col(name) == wanted)
    points = rows.where(both).select("_id_x", "species", "height_m", "mean_crown_diameter_m")
    return points, crown_summary(points)


def crown_summary(points: DataFrame) -> DataFrame:
    return points.groupBy("species").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("height_m").alias("min_height_m"),
        F.max("height_m").alias("max_height_m"),
        F.avg("height_m").alias("avg_height_m"),
        F.max("mean_crown_diameter_m").alias("max_crown_m"),
        F.avg("mean_crown_diameter_m").alias("avg_crown_m"),
    )


def rows_per_source(rows: DataFrame) -> DataFrame:
    """Number of measurement rows per source; rows without one are not counted."""
    return rows.where(F.col("source").isNotNull()).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# Marker clustering of the map.
CLUSTER_RADIUS, TILE_EXTENT, MAX_ZOOM = 60, 256, 18
CLUSTER_SIZES = ((100, "small"), (1000, "medium"))


def _size_class(count: Column) -> Column:
    (few, small), (some, medium) = CLUSTER_SIZES
    return F.when(count < few, small).when(count < some, medium).otherwise("large")


#: Zoom levels that are counted from one finer level; a cell is repeated once for each of them.
LEVELS_AT_ONCE = 4


def map_clusters(docs, zooms: Sequence[int] = range(MAX_ZOOM + 1), box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Markers per map grid cell and zoom level: count, mean place, size class.

    Cells of one level are quarters of a cell one level up. The documents are
    reduced to the finest cells, and each group of ``LEVELS_AT_ONCE`` levels is
    summed from the coarsest level of the group below it. ``box`` is a map view
    ``(west, south, east, north)`` that reaches the scan.
    """
    table = header(docs)
    if box is not None:
        table = table.where(geo.within_viewport(*box, F.col("lon"), F.col("lat")))
    wanted = sorted({int(z) for z in zooms}, reverse=True)
    source, x, y = wanted[0], *geo.mercator(F.col("lon"), F.col("lat"))
    cells = float(2**source) * TILE_EXTENT / CLUSTER_RADIUS
    sums = [F.sum(c).alias(c) for c in ("n", "slon", "slat")]
    below = (
        table.groupBy(F.floor(x * cells).alias("gx"), F.floor(y * cells).alias("gy"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("lon").alias("slon"), F.sum("lat").alias("slat"))
        .withColumn("zoom", F.lit(source))
    )
    levels, rest = [below], wanted[1:]
    while rest:
        group, rest = rest[:LEVELS_AT_ONCE], rest[LEVELS_AT_ONCE:]
        up = below.drop("zoom").withColumn("zoom", F.explode(F.array(*map(F.lit, group))))
        step = F.lit(source) - F.col("zoom")
        halved = [F.call_function("shiftright", F.col(c), step).alias(c) for c in ("gx", "gy")]
        summed = up.groupBy("zoom", *halved).agg(*sums)
        levels.append(summed)
        source = group[-1]
        below = summed.where(F.col("zoom") == source)
    counted = reduce(DataFrame.unionByName, levels)
    place = [(F.col(s) / F.col("n")).alias(c) for s, c in (("slon", "lon"), ("slat", "lat"))]
    return counted.select("zoom", "gx", "gy", "n", *place, _size_class(F.col("n")).alias("size"))
