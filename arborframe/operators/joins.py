"""Joins and set operations over document ids, and row-local pairings."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import geo
from ..session import saved
from .match import ElementScope, compile_filter


def semi_join_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id occurs in ``ids`` (an empty list gives none)."""
    return docs.join(ids.select("_id_x"), "_id_x", "left_semi")


def intersect_results(*results: DataFrame) -> DataFrame:
    """Documents found by every sub-query."""
    return reduce(semi_join_ids, results)


def union_results(*results: DataFrame) -> DataFrame:
    """Documents found by any sub-query, each once."""
    return reduce(DataFrame.unionByName, results).dropDuplicates(["_id_x"])


def union_append(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both collections; repeats are kept."""
    return first.unionByName(second, allowMissingColumns=True)


def anti_join_missing_source(docs: model.RelationalDocs, sources: Sequence[str]) -> DataFrame:
    """Documents with no measurement from any of ``sources``.

    The element side is cut to distinct ids first, so a document with very many
    matching rows contributes one.
    """
    rows = docs.rows("properties.measurements")
    found = rows.where(F.col("source").isin(list(sources))).select(docs.key).distinct()
    return docs.header.join(found, docs.key, "left_anti")


# ---------------------------------------------------------------- row-local pairings
def _matching(path: str, query: Mapping[str, Any], wanted: Sequence[str]) -> Column:
    """Array elements that satisfy an element filter, as structs of the members needed."""
    column, fields = model.ARRAYS[path]
    used = dict.fromkeys(wanted)

    def note(name: str) -> Column:
        used[name] = None
        return F.col(f"{column}.`{name}`")

    def held(value, keys) -> Column:
        return compile_filter(query, ElementScope(value, lambda n: F.array_contains(keys(), n), fields, complete=True))

    held(note, lambda: note("_keys"))
    members = F.arrays_zip(*[F.col(f"{column}.`{name}`") for name in used])
    return F.filter(members, lambda e: held(e.getField, lambda: e["_keys"]))


def _pairs(docs: DataFrame, left: Column, right: Column, keep: Sequence[str]) -> DataFrame:
    """All (left, right) element pairs inside each document, by two explodes."""
    return docs.select(*keep, F.explode(left).alias("l"), right.alias("rs")).select(*keep, "l", F.explode("rs").alias("r"))


def merge_data_measurements(docs: DataFrame, data: Mapping[str, Any], measurements: Mapping[str, Any]) -> DataFrame:
    """Scans and measurements of one tree side by side (inner, many-to-many).

    ``data`` and ``measurements`` are element filters.  Both arrays live in the
    same row, so the join on the tree needs no shuffle.
    """
    scan = [n for n in model.DATA_FIELDS if n not in ("date", "crs", "canopy_condition")]
    measured = [n for n in model.MEASUREMENT_FIELDS if n != "crs"]
    pairs = _pairs(
        docs,
        _matching("properties.data", data, scan),
        _matching("properties.measurements", measurements, measured),
        ("_id_x", "id"),
    )
    return pairs.select(
        "_id_x",
        "id",
        *[F.col(f"l.`{n}`").alias(n) for n in scan],
        *[F.col(f"r.`{n}`").alias(n) for n in measured],
    )


def pair_sources(
    docs: DataFrame,
    left: Mapping[str, Any],
    left_value: str,
    right: Mapping[str, Any],
    right_value: str,
) -> DataFrame:
    """Two measurements of the same tree for comparison: ``left_value, right_value``.

    ``left`` and ``right`` are element filters, for example leaf-on ALS against
    leaf-on ULS heights.
    """
    path = "properties.measurements"
    pairs = _pairs(
        docs, _matching(path, left, [left_value]), _matching(path, right, [right_value]), ("_id_x", "id", "species")
    )
    return pairs.select(
        "_id_x",
        "id",
        "species",
        F.col(f"l.`{left_value}`").alias("left_value"),
        F.col(f"r.`{right_value}`").alias("right_value"),
    )


# ---------------------------------------------------------------- spatial joins
class _Grid:
    """Grid cells on which documents and search areas meet.

    Rows of cells are equally high; the nearer to a pole, the fewer cells a row
    has, so all cells are about as wide as they are high.  A document lives in one
    cell; a search is copied to every cell its bounding box touches.  The join
    is a sort-merge join: neither side is broadcast, whatever it grows to, and
    adaptive execution splits the documents of a cell that holds most of them by
    their measured size.  The height of a cell may be a column.
    """

    KEYS = ("_x", "_y")

    def __init__(self, degrees: float | Column, rows: int | Column | None = None):
        self.degrees = degrees
        self.rows = math.ceil(180.0 / degrees) if rows is None else rows

    def _y(self, lat: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.floor((lat + 90.0) / self.degrees), F.lit(self.rows - 1))).cast("int")

    def _width(self, y: Column) -> Column:
        """Cells of a row, by the circle of its edge that is nearer to the equator."""
        south, north = y * self.degrees - 90.0, (y + 1) * self.degrees - 90.0
        nearest = F.when((south < 0) & (north > 0), 0.0).otherwise(F.least(F.abs(south), F.abs(north)))
        return F.greatest(F.lit(1), F.ceil(F.cos(F.radians(nearest)) * (360.0 / self.degrees))).cast("int")

    def _x(self, lon: Column, width: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.floor((lon + 180.0) / 360.0 * width).cast("int"), width - 1))

    def documents(self, docs: DataFrame) -> DataFrame:
        y = self._y(F.col("lat"))
        return docs.select("_id_x", "lon", "lat", self._x(F.col("lon"), self._width(y)).alias("_x"), y.alias("_y"))

    def _columns_between(self, west: Column, east: Column, width: Column) -> Column:
        """Cells of a longitude range that may run over the date line on one side."""
        first, last = F.lit(0), width - 1
        left, right = self._x(west, width), self._x(east, width)
        parts = (
            F.when(east - west >= 360.0, F.array(F.sequence(first, last)))
            .when(west < -180.0, F.array(F.sequence(self._x(west + 360.0, width), last), F.sequence(first, right)))
            .when(east > 180.0, F.array(F.sequence(left, last), F.sequence(first, self._x(east - 360.0, width))))
            .otherwise(F.array(F.sequence(left, right)))
        )
        return F.array_distinct(F.flatten(parts))

    def searches(self, boxed: DataFrame) -> DataFrame:
        """One row per cell that the box ``_box`` touches."""
        low, high = F.greatest(F.col("_box.s"), F.lit(-90.0)), F.least(F.col("_box.n"), F.lit(90.0))
        rows = boxed.withColumn("_y", F.explode(F.sequence(self._y(low), self._y(high))))
        rows = rows.withColumn("_width", self._width(F.col("_y")))
        return rows.withColumn("_x", F.explode(self._columns_between(F.col("_box.w"), F.col("_box.e"), F.col("_width")))).drop("_box", "_width")


def _boxed(searches: DataFrame, west: Column, south: Column, east: Column, north: Column) -> DataFrame:
    return model.computed_once(searches, "_box", F.struct(west.alias("w"), south.alias("s"), east.alias("e"), north.alias("n")))


_SLACK = 1e-9  # degrees; keeps rounding from cutting a bounding box short


def spatial_join(
    docs: DataFrame, searches: DataFrame, max_distance: float, cell_degrees: float | None = None
) -> DataFrame:
    """Documents within a radius of each search point: ``search_id, _id_x, dist_m``.

    ``searches`` has ``search_id, lon, lat, radius_m`` with radii of at most
    ``max_distance``; larger ones raise.  The default cell is as wide as that
    distance, so a circle touches few cells.
    """
    reach = math.degrees(max_distance / geo.EARTH_RADIUS_M)
    grid = _Grid(cell_degrees or min(max(reach, 0.01), 90.0))
    radius = F.when(F.col("radius_m") <= max_distance, F.col("radius_m")).otherwise(
        F.raise_error(F.lit("search radius exceeds max_distance")).cast("double")
    )
    lon, lat, angle = F.col("_lon"), F.col("_lat"), F.col("_radius") / geo.EARTH_RADIUS_M
    degrees = F.degrees(angle) + _SLACK
    narrow = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(angle) / F.cos(F.radians(lat))))) + _SLACK
    spread = F.when(F.abs(lat) + degrees >= 90.0, 180.0).otherwise(narrow)
    points = searches.select(
        "search_id", F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), radius.alias("_radius")
    )
    placed = grid.searches(_boxed(points, lon - spread, lat - degrees, lon + spread, lat + degrees))
    distance = geo.distance_m(F.col("lon"), F.col("lat"), lon, lat)
    return (
        grid.documents(docs)
        .join(placed.hint("merge"), list(_Grid.KEYS))
        .withColumn("dist_m", distance)
        .where(F.col("dist_m") <= F.col("_radius"))
        .select("search_id", "_id_x", "dist_m")
    )


#: Levels of the covering: a cell of level n is 180 / 2**n degrees high. Only even ones occur, as each is a copy of the documents.
_COARSEST, _FINEST = 2, 16
#: Edges of a border cell that the join compares as plain columns.
_PLAIN_EDGES = 4


def _level_grid() -> _Grid:
    rows = F.expr("shiftleft(1, _level)")
    return _Grid(F.lit(180.0) / rows, rows)


def ring_cover(searches: DataFrame, cells_across: float = 8.0) -> DataFrame:
    """Cells of each search ring: ``search_id, _level, _x, _y, _whole, _flip, _edges``.

    A search has cells of one size, by its own area, so that about
    ``cells_across`` of them lie side by side whatever the others need; a long
    and narrow one has up to eight times as many along its length. A cell
    that no side of the ring can reach is dropped where its centre is outside
    and is ``_whole`` where it is inside; only the cells on the border carry
    those of the ring's edges that tell their points apart (see
    ``geo.edges_in_cell``).
    """
    ring, sides, walk = F.col("ring"), F.col("_sides"), F.col("_walk")
    rings = model.computed_once(searches.select("search_id", "ring"), "_sides", geo.ring_sides(ring))
    rings = model.computed_once(rings, "_walk", geo.ring_walk(ring, sides))
    rings = model.computed_once(rings, "_ring", geo.ring_shape(ring, sides, walk))
    rings = model.computed_once(rings, "_arcs", geo.ring_arcs(sides))
    box = [F.col(f"_ring.{name}") for name in ("west", "south", "east", "north")]
    boxed = _boxed(rings, *[c + s for c, s in zip(box, (-_SLACK, -_SLACK, _SLACK, _SLACK))])
    south, north = F.col("_box.s"), F.col("_box.n")
    nearest = F.when((south < 0) & (north > 0), 0.0).otherwise(F.least(F.abs(south), F.abs(north)))
    high, wide = north - south, (F.col("_box.e") - F.col("_box.w")) * F.cos(F.radians(nearest))
    size = F.greatest(F.sqrt(high * F.abs(wide)), high / 8, wide / 8, F.lit(1e-6))
    level = 2 * F.round(F.log2(F.lit(180.0 * cells_across) / size) / 2)
    boxed = model.computed_once(boxed, "_level", F.greatest(F.lit(_COARSEST), F.least(F.lit(_FINEST), level)).cast("int"))
    grid = _level_grid()
    placed = grid.searches(boxed.select("search_id", "_ring", "_arcs", "_box", "_level"))
    placed = model.computed_once(placed, "_wide", F.lit(360.0) / grid._width(F.col("_y")))
    width = F.col("_wide")
    lon, lat = (F.col("_x") + 0.5) * width - 180.0, (F.col("_y") + 0.5) * grid.degrees - 90.0
    # The point of a cell that is farthest from its centre is a corner.
    corners = [geo.distance_m(lon, lat, lon + width / 2, lat + way * grid.degrees / 2) for way in (-1, 1)]
    radius = F.greatest(*corners) / geo.EARTH_RADIUS_M + _SLACK
    west = F.col("_x") * width - 180.0
    centre = model.computed_once(placed, "_at", F.struct(lon.alias("lon"), lat.alias("lat"), radius.alias("radius"), west.alias("west"), *[c.alias(n) for n, c in zip("xyz", geo.unit_columns(lon, lat))]))
    near = geo.any_arc_within(F.col("_arcs"), *[F.col(f"_at.{n}") for n in "xyz"], F.col("_at.radius"))
    edges = F.col("_ring.edges")
    part = geo.edges_in_cell(edges, F.col("_at.west"), width, F.col("_at"), _SLACK)
    judged = model.computed_once(centre, "_kinds", F.when(near, part))
    judged = model.computed_once(judged, "_part", F.when(F.col("_kinds").isNotNull(), geo.open_edges(F.col("_kinds"))))
    judged = model.computed_once(judged, "_border", F.coalesce(F.size("_part.open") > 0, F.lit(False)))
    kept = judged.where(F.col("_border") | geo.inside_ring(edges, F.col("_at.lon"), F.col("_at.lat")))
    within = [(~F.col("_border")).alias("_whole"), F.when(F.col("_border"), F.col("_part.flip")).alias("_flip"), F.when(F.col("_border"), F.col("_part.open")).alias("_edges")]
    return kept.select("search_id", "_level", *_Grid.KEYS, *within)


def spatial_join_polygons(docs: DataFrame, searches: DataFrame, cells_across: float = 8.0) -> DataFrame:
    """Documents inside each search polygon: ``search_id, _id_x``.

    ``searches`` has ``search_id`` and ``ring ARRAY<ARRAY<DOUBLE>>``, a closed
    ring with great-circle edges that lies within one hemisphere and encloses no
    pole; other rings raise (use ``within_polygon`` for those).

    Searches are covered by cells of a size of their own (see ``ring_cover``);
    a document joins once per size that occurs, of which there are at most 8,
    and only pairs in cells on a border are tested, with the few edges that the
    cell leaves open. These are plain columns, so that the join is compiled code;
    border cells with more than ``_PLAIN_EDGES`` open edges join apart.
    """
    # Few bytes of searches make many cells: by their bytes alone one task would cover them all.
    dealt = searches.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "search_id")
    cover = saved(ring_cover(dealt, cells_across), "cover")
    found = cover.groupBy("_level").agg(F.max(F.size("_edges")).alias("edges")).collect()  # at most 8
    levels, most = sorted(r["_level"] for r in found) or [_COARSEST], max((r["edges"] for r in found), default=0)
    lon, lat = geo.wrapped(F.col("lon")), F.col("lat")
    point = [lon.alias("_lon"), *[c.alias(f"_{n}p") for n, c in zip("xyz", geo.unit_columns(F.col("lon"), lat))]]
    lived = docs.select("_id_x", lat.alias("_lat"), *point, F.explode(F.array(*map(F.lit, levels))).alias("_level"))
    grid, y = _level_grid(), _level_grid()._y(F.col("_lat"))
    lived = lived.select("*", grid._x(F.col("_lon"), grid._width(y)).alias("_x"), y.alias("_y")).drop("_lat")
    keys, at = ["_level", *_Grid.KEYS], [F.col(n) for n in ("_lon", "_xp", "_yp", "_zp")]

    slots = range(min(max(most, 0), _PLAIN_EDGES))
    plain = [F.get("_edges", i)[n].alias(f"_{n}{i}") for i in slots for n in "wexyz"]
    odd = reduce(lambda a, b: a != b, [geo.crosses({n: F.col(f"_{n}{i}") for n in "wexyz"}, *at) for i in slots], F.col("_flip"))
    few = cover.where(F.col("_whole") | (F.size("_edges") <= _PLAIN_EDGES)).select("search_id", *keys, "_whole", "_flip", *plain)
    hits = lived.join(few.hint("merge"), keys).where(F.col("_whole") | odd).select("search_id", "_id_x")
    if most <= _PLAIN_EDGES:
        return hits
    many = cover.where(F.size("_edges") > _PLAIN_EDGES).select("search_id", *keys, "_flip", "_edges")
    crossed = geo.crossings(F.col("_edges"), *at) % 2 == 1
    return hits.unionByName(lived.join(many.hint("merge"), keys).where(crossed != F.col("_flip")).select("search_id", "_id_x"))
