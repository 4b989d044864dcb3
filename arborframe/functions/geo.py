"""Spherical geometry as Spark expressions.

Everything here is a Column built from constants and ``lon``/``lat`` columns
(degrees), so it stays inside whole-stage codegen.  Each test starts with a
plain range condition on ``lon``/``lat`` that reaches the Parquet scan and that
short-circuits the trigonometry.
"""

from __future__ import annotations

import json
import math
import operator
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_378_100.0  # fixed value: sphere radius behind the distance search
STRICT_WINDING = "urn:x-mongodb:crs:strictwinding:EPSG:4326"  # fixed value: CRS name

Vector = tuple[float, float, float]


# ---------------------------------------------------------------- arguments
def search_geometry(geom: Mapping[str, Any] | str) -> dict[str, Any]:
    """Point or Polygon given as a mapping or JSON text; ``ValueError`` otherwise."""
    if isinstance(geom, str):
        try:
            geom = json.loads(geom)
        except json.JSONDecodeError as err:
            raise ValueError(f"search geometry is not valid JSON: {err}") from err
    if not isinstance(geom, Mapping) or geom.get("type") not in ("Point", "Polygon"):
        kind = geom.get("type") if isinstance(geom, Mapping) else type(geom).__name__
        raise ValueError(f"search geometry must be a Point or a Polygon, got {kind}")
    if not geom.get("coordinates"):
        raise ValueError("search geometry has no coordinates")
    return dict(geom)


# ---------------------------------------------------------------- distance
def distance_m(lon: Column, lat: Column, lon0: Column | float, lat0: Column | float) -> Column:
    """Great-circle distance in metres (haversine)."""
    lon0, lat0 = (c if isinstance(c, Column) else F.lit(float(c)) for c in (lon0, lat0))
    half = F.sin(F.radians(lat - lat0) / 2)
    across = F.sin(F.radians(lon - lon0) / 2)
    h = half * half + F.cos(F.radians(lat0)) * F.cos(F.radians(lat)) * across * across
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def _lon_between(lon: Column, west: float, east: float) -> Column:
    """Longitude range that may run over the date line (``east`` may exceed 180)."""
    if east - west >= 360:
        return F.lit(True)
    if west < -180:
        return (lon >= west + 360) | (lon <= east)
    if east > 180:
        return (lon >= west) | (lon <= east - 360)
    return lon.between(west, east)


def _cap_box(lon0: float, lat0: float, metres: float, lon: Column, lat: Column) -> Column:
    slack = 1e-9
    reach = metres / EARTH_RADIUS_M
    degrees = math.degrees(reach) + slack
    box = lat.between(lat0 - degrees, lat0 + degrees)
    if abs(lat0) + degrees < 90:
        spread = math.degrees(math.asin(min(1.0, math.sin(reach) / math.cos(math.radians(lat0))))) + slack
        box = box & _lon_between(lon, lon0 - spread, lon0 + spread)
    return box


def within_distance(geom: Mapping[str, Any] | str, metres: float, lon: Column, lat: Column) -> Column:
    """Great-circle distance to a Point is at most ``metres``."""
    geom = search_geometry(geom)
    if geom["type"] != "Point":
        raise ValueError("a distance search needs a Point")
    lon0, lat0 = map(float, geom["coordinates"][:2])
    exact = distance_m(lon, lat, lon0, lat0) <= float(metres)
    return _cap_box(lon0, lat0, float(metres), lon, lat) & exact


# ---------------------------------------------------------------- viewport
def clamp(value: float | Column, limit: float) -> float | Column:
    """Cut a coordinate to ``[-limit, limit]``."""
    if isinstance(value, Column):
        return F.greatest(F.lit(-limit), F.least(F.lit(limit), value))
    return max(-limit, min(limit, float(value)))


def within_viewport(west: float, south: float, east: float, north: float, lon: Column, lat: Column) -> Column:
    """Inside a map view whose edges are first cut to the valid lon/lat range."""
    return lon.between(clamp(west, 180.0), clamp(east, 180.0)) & lat.between(clamp(south, 90.0), clamp(north, 90.0))


# ---------------------------------------------------------------- polygons
def _unit(lon: float, lat: float) -> Vector:
    phi, lam = math.radians(lat), math.radians(lon)
    return math.cos(phi) * math.cos(lam), math.cos(phi) * math.sin(lam), math.sin(phi)


def _wrapped(lon: float) -> float:
    """Longitude in [-180, 180), untouched if it is there already."""
    return lon if -180.0 <= lon < 180.0 else (lon + 180.0) % 360.0 - 180.0


def _cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _dot(a: Vector, b: Vector) -> float:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _scaled(a: Vector) -> Vector:
    size = math.sqrt(_dot(a, a))
    return a[0] / size, a[1] / size, a[2] / size


def _plane(a: Vector, b: Vector) -> Vector:
    """Normal of the great circle a->b; the sum/difference form keeps short edges exact."""
    diff = tuple(q - p for p, q in zip(a, b))
    total = tuple(p + q for p, q in zip(a, b))
    return _cross(total, diff)


class Ring:
    """Closed ring on the sphere with great-circle edges.

    A point is classified by counting the edges between it and the north pole
    on its meridian.  Edges are stored west-to-east as ``(west, east, normal)``:
    such an edge is crossed iff the point's longitude lies in ``[west, east)``
    and the point is south of the edge plane.  Longitudes are compared as
    given, never after arithmetic, so neighbouring edges share no point and
    leave none out.
    """

    def __init__(self, vertices: Sequence[Sequence[float]], strict: bool):
        points = [(float(v[0]), float(v[1])) for v in vertices]
        if len(points) < 4 or points[0] != points[-1]:
            raise ValueError("a polygon ring needs at least four positions and must be closed")
        self.sides = [(a, b) for a, b in zip(points, points[1:]) if a != b]
        if len(self.sides) < 3:
            raise ValueError("a polygon ring needs three distinct positions")
        self.edges: list[tuple[float, float, Vector]] = []  # east < west: over the date line
        for a, b in self.sides:
            turn = (b[0] - a[0] + 540.0) % 360.0 - 180.0
            if turn == -180.0:
                raise ValueError("a polygon edge must not span half the globe")
            if turn:
                west, east = (a, b) if turn > 0 else (b, a)
                self.edges.append((_wrapped(west[0]), _wrapped(east[0]), _plane(_unit(*west), _unit(*east))))
        self.north_inside = False
        left_inside = strict or self._left_area() <= 2 * math.pi
        self.north_inside = self._holds(*self._left_neighbour()) != left_inside

    def _left_area(self) -> float:
        """Area on the left of the ring, from the signed areas between edges and the equator."""
        total, turns = 0.0, 0.0
        for (lon_a, lat_a), (lon_b, lat_b) in self.sides:
            turn = (lon_b - lon_a + 540.0) % 360.0 - 180.0
            turns += turn
            ta, tb = math.tan(math.radians(lat_a) / 2), math.tan(math.radians(lat_b) / 2)
            total += 2 * math.atan2(math.tan(math.radians(turn) / 2) * (ta + tb), 1 + ta * tb)
        area = (2 * math.pi if abs(turns) > 180 else 0.0) - total
        return area % (4 * math.pi)

    def _left_neighbour(self) -> tuple[float, float]:
        """A position a hair to the left of the middle of the longest side."""
        a, b = max(
            ((_unit(*p), _unit(*q)) for p, q in self.sides), key=lambda s: sum((x - y) ** 2 for x, y in zip(*s))
        )
        middle, left = _scaled(tuple(p + q for p, q in zip(a, b))), _scaled(_plane(a, b))
        x, y, z = _scaled(tuple(m + 1e-8 * n for m, n in zip(middle, left)))
        return math.degrees(math.atan2(y, x)), math.degrees(math.asin(z))

    def _holds(self, lon: float, lat: float) -> bool:
        p, lon = _unit(lon, lat), _wrapped(lon)
        crossed = 0
        for west, east, normal in self.edges:
            facing = west <= lon < east if west < east else lon >= west or lon < east
            crossed += facing and _dot(normal, p) < 0
        return (crossed % 2 == 1) != self.north_inside

    def _box(self, lon: Column, lat: Column) -> Column | None:
        """Range condition implied by membership; None if the inside holds a pole."""
        if self.north_inside or self._holds(self.sides[0][0][0] + 1e-7, -90.0):
            return None
        here, lons = self.sides[0][0][0], []
        lats = [p[1] for p, _ in self.sides]
        for p, q in self.sides:
            lons.append(here)
            here += (q[0] - p[0] + 540.0) % 360.0 - 180.0
            a, b = _unit(*p), _unit(*q)
            normal = _plane(a, b)
            apex = (-normal[0] * normal[2], -normal[1] * normal[2], normal[0] ** 2 + normal[1] ** 2)
            if any(apex):
                apex = _scaled(apex)
                for top in (apex, tuple(-c for c in apex)):  # great circles bulge beyond their ends
                    if _dot(_cross(a, top), normal) > 0 and _dot(_cross(top, b), normal) > 0:
                        lats.append(math.degrees(math.asin(top[2])))
        slack = 1e-9
        low, high = min(lons), max(lons)
        shift = -360.0 if low > 180 else 360.0 if high < -180 else 0.0
        return lat.between(min(lats) - slack, max(lats) + slack) & _lon_between(
            lon, low + shift - slack, high + shift + slack
        )

    def contains(self, lon: Column, lat: Column) -> Column:
        point, at = unit_columns(lon, lat), wrapped(lon)
        edges = F.array(
            *[F.struct(*[F.lit(v).alias(k) for k, v in zip("wexyz", (west, east, *n))]) for west, east, n in self.edges]
        )
        crossed = crossings(edges, at, *point)
        inside = (crossed % 2 == 1) != F.lit(self.north_inside)
        box = self._box(lon, lat)
        return inside if box is None else box & inside


def unit_columns(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def wrapped(lon: Column) -> Column:
    """Longitude column in [-180, 180), untouched where it is there already."""
    return F.when((lon >= -180.0) & (lon < 180.0), lon).otherwise(F.pmod(lon + 180.0, F.lit(360.0)) - 180.0)


def _between(lon: Column, west: Column, east: Column) -> Column:
    return F.when(west < east, (lon >= west) & (lon < east)).otherwise((lon >= west) | (lon < east))


def crossings(edges: Column, lon: Column, x: Column, y: Column, z: Column) -> Column:
    """Edges of an ``array<struct<w,e,x,y,z>>`` crossed on the way to the north pole."""

    def crossed(edge: Column) -> Column:
        return _between(lon, edge["w"], edge["e"]) & (x * edge["x"] + y * edge["y"] + z * edge["z"] < 0)

    return F.size(F.filter(edges, crossed))


def inside_ring(edges: Column, lon: Column, lat: Column) -> Column:
    """Inside a ring, given its edges, that does not enclose the north pole."""
    point = wrapped(lon), *unit_columns(lon, lat)
    few = reduce(operator.ne, [crosses(e, *point) for e in _first(edges)])
    return F.when(F.size(edges) <= WRITTEN_OUT, few).otherwise(crossings(edges, *point) % 2 == 1)


#: Members up to which a test of all members of an array is written out, as compiled code; a lambda is interpreted.
WRITTEN_OUT = 8


def _first(array: Column) -> list[Column]:
    """The members of an array of up to ``WRITTEN_OUT``, NULL beyond its end."""
    return [F.get(array, i) for i in range(WRITTEN_OUT)]


def edges_in_cell(edges: Column, west: Column, width: Column, centre: Column, slack: float) -> Column:
    """How a ring's edges have to be tested for points of one cell: the ``edges`` with their ``kinds``, for ``open_edges``.

    An edge that every point of the cell lies north of, or whose longitudes the
    cell has none of, is crossed by none; one that spans the cell and that every
    point lies south of is crossed by all, and their number only says whether to
    flip. ``centre`` is the cell's middle ``x, y, z`` with its ``radius``; all
    limits are wider than rounding, so the remaining edges give the same result
    as all of them.
    """
    west, width = west - slack, width + 2 * slack

    def kind(e: Column) -> Column:
        """0 for an edge that none crosses, 1 for one that all cross, 2 for the others."""
        span = F.pmod(e["e"] - e["w"], F.lit(360.0))
        past, ahead = F.pmod(west - e["w"], F.lit(360.0)), F.pmod(e["w"] - west, F.lit(360.0))
        height = centre["x"] * e["x"] + centre["y"] * e["y"] + centre["z"] * e["z"]
        reach = F.sqrt(e["x"] * e["x"] + e["y"] * e["y"] + e["z"] * e["z"]) * centre["radius"]
        never = (height > reach) | ((past > span + slack) & (ahead > width))
        always = (height < -reach) & (past + width < span)
        return F.when(never, 0).when(always, 1).otherwise(2)

    few = F.size(edges) <= WRITTEN_OUT
    kinds = F.when(few, F.array(*map(kind, _first(edges)))).otherwise(F.transform(edges, kind))
    return F.struct(edges.alias("edges"), kinds.alias("kinds"))


def open_edges(part: Column) -> Column:
    """The ``open`` edges of a cell and its ``flip``, from the ``edges`` and their ``kinds``."""
    edges, kinds = part["edges"], part["kinds"]
    few = F.size(edges) <= WRITTEN_OUT
    some = F.array_compact(F.array(*[F.when(k == 2, e) for e, k in zip(_first(edges), _first(kinds))]))
    every = F.transform(F.filter(F.arrays_zip(edges.alias("edge"), kinds.alias("kind")), lambda z: z["kind"] == 2), lambda z: z["edge"])
    odd = reduce(operator.ne, [e.isNotNull() & (k == 1) for e, k in zip(_first(edges), _first(kinds))])
    all_odd = F.size(F.filter(kinds, lambda k: k == 1)) % 2 == 1
    return F.struct(F.when(few, some).otherwise(every).alias("open"), F.when(few, odd).otherwise(all_odd).alias("flip"))


def crosses(edge: Mapping[str, Column], lon: Column, x: Column, y: Column, z: Column) -> Column:
    """Whether one edge, NULL for none, is crossed on the way to the north pole: the test of ``crossings``."""
    return F.coalesce(_between(lon, edge["w"], edge["e"]) & (x * edge["x"] + y * edge["y"] + z * edge["z"] < 0), F.lit(False))


def ring_sides(ring: Column) -> Column:
    """Sides of a ring column ``array<array<double>>`` as west-to-east edges.

    Besides the edge (``w, e`` and the plane ``x, y, z``) each carries the turn
    in longitude and the latitudes ``a, b`` in ring order.
    """

    def side(p: Column, q: Column) -> Column:
        turn = F.pmod(q[0] - p[0] + 540.0, F.lit(360.0)) - 180.0
        west, east = F.when(turn > 0, p).otherwise(q), F.when(turn > 0, q).otherwise(p)
        return F.struct(west.alias("west"), east.alias("east"), turn.alias("turn"), p[1].alias("a"), q[1].alias("b"))

    def with_units(s: Column) -> Column:
        units = [F.struct(*[c.alias(n) for n, c in zip("xyz", unit_columns(s[end][0], s[end][1]))]) for end in ("west", "east")]
        return F.struct(s.alias("s"), units[0].alias("p"), units[1].alias("q"))

    def with_plane(u: Column) -> Column:
        p, q = ([u[end][n] for n in "xyz"] for end in "pq")
        plane = _cross([i + j for i, j in zip(p, q)], [j - i for i, j in zip(p, q)])
        ends = [wrapped(u["s"]["west"][0]).alias("w"), wrapped(u["s"]["east"][0]).alias("e")]
        rest = [u["s"][n].alias(n) for n in ("turn", "a", "b")]
        return F.struct(*ends, *[c.alias(n) for n, c in zip("xyz", plane)], *rest)

    steps = F.size(ring) - 1
    sides = F.zip_with(F.slice(ring, 1, steps), F.slice(ring, 2, steps), side)
    return F.transform(F.transform(sides, with_units), with_plane)


def ring_walk(ring: Column, sides: Column) -> Column:
    """Longitudes met on the way round (``at, low, high``) and the signed area passed."""

    def area(s: Column) -> Column:
        ta, tb = (F.tan(F.radians(s[n]) / 2) for n in ("a", "b"))
        return 2 * F.atan2(F.tan(F.radians(s["turn"]) / 2) * (ta + tb), 1 + ta * tb)

    start = F.element_at(ring, 1)[0]
    return F.aggregate(
        sides,
        F.struct(start.alias("at"), start.alias("low"), start.alias("high"), F.lit(0.0).alias("area")),
        lambda acc, s: F.struct(
            (acc["at"] + s["turn"]).alias("at"),
            F.least(acc["low"], acc["at"] + s["turn"]).alias("low"),
            F.greatest(acc["high"], acc["at"] + s["turn"]).alias("high"),
            (acc["area"] + area(s)).alias("area"),
        ),
    )


def ring_shape(ring: Column, sides: Column, walk: Column) -> Column:
    """Edges and bounding box of a ring, from its sides and the walk round it.

    Raises for rings that are open, enclose a pole or cover more than a hemisphere.
    """

    def apex(s: Column, sign: int) -> Column:
        """Latitude of the great circle's northern (1) or southern (-1) apex if it is on the side."""
        lon = F.degrees(F.atan2(-sign * s["y"] * s["z"], -sign * s["x"] * s["z"]))
        height = F.degrees(F.atan2(F.sqrt(s["x"] * s["x"] + s["y"] * s["y"]), F.abs(s["z"])))
        on_side = (s["turn"] != 0) & _between(wrapped(lon), s["w"], s["e"])
        return F.when(on_side, sign * height).otherwise(s["a"])

    usable = (
        (F.size(ring) >= 4)
        & (F.element_at(ring, 1) == F.element_at(ring, -1))
        & (F.abs(walk["at"] - F.element_at(ring, 1)[0]) < 180.0)
        & (F.abs(walk["area"]) <= 2 * math.pi)
    )
    shift = wrapped(walk["low"]) - walk["low"]  # the box starts in [-180, 180)
    shape = F.struct(
        F.transform(
            F.filter(sides, lambda s: s["turn"] != 0), lambda s: F.struct(*[s[n].alias(n) for n in "wexyz"])
        ).alias("edges"),
        (walk["low"] + shift).alias("west"),
        (walk["high"] + shift).alias("east"),
        F.array_min(F.transform(sides, lambda s: F.least(s["a"], apex(s, -1)))).alias("south"),
        F.array_max(F.transform(sides, lambda s: F.greatest(s["a"], apex(s, 1)))).alias("north"),
    )
    return F.when(usable, shape).otherwise(
        F.raise_error(F.lit("search ring must be closed, within a hemisphere and without a pole"))
    )


def ring_arcs(sides: Column) -> Column:
    """Sides of a ring as arcs: unit normal ``x, y, z``, middle ``mx, my, mz`` and half the length."""

    def ends(s: Column) -> Column:
        west_lat, east_lat = F.when(s["turn"] > 0, s["a"]).otherwise(s["b"]), F.when(s["turn"] > 0, s["b"]).otherwise(s["a"])
        units = [F.struct(*[c.alias(n) for n, c in zip("xyz", unit_columns(lon, lat))]) for lon, lat in ((s["w"], west_lat), (s["e"], east_lat))]
        return F.struct(s.alias("s"), units[0].alias("p"), units[1].alias("q"))

    def arc(u: Column) -> Column:
        p, q, n = ([u[end][k] for k in "xyz"] for end in "pqs")
        length = F.sqrt(_dot(n, n))
        middle = [i + j for i, j in zip(p, q)]
        scale = F.sqrt(_dot(middle, middle))
        normal = [F.when(length > 0, k / length).otherwise(0.0).alias(c) for c, k in zip("xyz", n)]
        centre = [F.when(scale > 0, k / scale).otherwise(0.0).alias(f"m{c}") for c, k in zip("xyz", middle)]
        chord = [i - j for i, j in zip(p, q)]
        return F.struct(*normal, *centre, F.asin(F.least(F.lit(1.0), F.sqrt(_dot(chord, chord)) / 2)).alias("half"))

    return F.transform(F.transform(sides, ends), arc)


def any_arc_within(arcs: Column, x: Column, y: Column, z: Column, radius: Column) -> Column:
    """False only if no arc comes within ``radius`` (an angle) of the point.

    An arc is at least as far away as its great circle, and as its middle less
    half its length.
    """

    def near(a: Column) -> Column:
        circle = F.abs(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x * a["x"] + y * a["y"] + z * a["z"]))))
        middle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x * a["mx"] + y * a["my"] + z * a["mz"])))
        return (circle <= radius) & (middle <= radius + a["half"] + 1e-9)

    few = reduce(operator.or_, [F.coalesce(near(a), F.lit(False)) for a in _first(arcs)])
    return F.when(F.size(arcs) <= WRITTEN_OUT, few).otherwise(F.exists(arcs, near))


def is_strict(geom: Mapping[str, Any]) -> bool:
    crs = geom.get("crs") or {}
    return (crs.get("properties") or {}).get("name") == STRICT_WINDING


def within_polygon(geom: Mapping[str, Any] | str, lon: Column, lat: Column) -> Column:
    """Inside a Polygon with great-circle edges; further rings are holes.

    Without a CRS the smaller side of the outer ring is meant; with the
    strict-winding CRS it is the side on the left of the ring, however large.
    """
    geom = search_geometry(geom)
    if geom["type"] != "Polygon":
        raise ValueError("a containment search needs a Polygon")
    outer, *holes = geom["coordinates"]
    condition = Ring(outer, is_strict(geom)).contains(lon, lat)
    for hole in holes:
        condition = condition & ~Ring(hole, False).contains(lon, lat)
    return condition


# ---------------------------------------------------------------- map projection
def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web-Mercator position in the unit square (origin at the north-west corner)."""
    s = F.sin(F.radians(lat))
    y = F.lit(0.5) - F.lit(0.25) * F.ln((1 + s) / (1 - s)) / F.lit(math.pi)
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), y))
    return lon / 360.0 + 0.5, F.when(s >= 1, 0.0).when(s <= -1, 1.0).otherwise(inside)
