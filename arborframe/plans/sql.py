"""SQL twins of the benchmark views: ANSI-style text over the flat tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

TREES = """t AS (SELECT o_orderkey AS _id_x, 'T' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS id,
  'T' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || '.geojson' AS _file, o_orderpriority AS species,
  (o_orderkey % 3600 - 1800) / CAST(10 AS DOUBLE) AS lon, ((o_orderkey * 7) % 1700 - 850) / CAST(10 AS DOUBLE) AS lat
  FROM orders)"""

KIND = "CASE o_custkey % 3 WHEN 0 THEN 'TLS' WHEN 1 THEN 'ULS' ELSE 'ALS' END"
CANOPY = "CASE WHEN o_orderkey % 2 = 0 THEN 'leaf-on' ELSE 'leaf-off' END"
DAY = "strftime(o_orderdate, '%Y-%m-%d')"
LATER = "strftime(o_orderdate + INTERVAL 1 DAY * CAST(o_custkey % 300 AS INTEGER), '%Y-%m-%d')"
MONTH = "strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d')"

MEASUREMENTS = f"""m AS (
  SELECT o_orderkey AS _id_x, 0 AS pos, CASE WHEN o_custkey % 10 <> 9 THEN 'FI' END AS source, {DAY} AS date,
    CAST(NULL AS VARCHAR) AS canopy, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS dbh,
    CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice END AS height, CAST(NULL AS DOUBLE) AS crown, 'alive' AS state,
    CAST(NULL AS VARCHAR) AS crs, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y, CAST(NULL AS DOUBLE) AS z FROM orders
  UNION ALL
  SELECT o_orderkey, 1, {KIND}, {LATER}, {CANOPY}, NULL, o_totalprice,
    CASE WHEN o_custkey % 15 <> 0 THEN CAST(o_custkey % 15 AS DOUBLE) END, NULL, NULL, NULL, NULL, NULL FROM orders
  UNION ALL
  SELECT o_orderkey, 2, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'epsg:25832',
    CAST(o_custkey AS DOUBLE), CAST(o_orderkey AS DOUBLE), 0.5 FROM orders WHERE o_orderkey % 4 <> 3)"""

SCANS = f"""s AS (
  SELECT o_orderkey AS _id_x, 0 AS pos, {KIND} AS mode, {DAY} AS date, {CANOPY} AS canopy, o_orderkey * 10 AS point_count,
    'https://example.org/t/' || o_orderkey || '_0.laz' AS file, o_custkey % 5 + 1 AS quality, CAST(NULL AS VARCHAR) AS labels
    FROM orders WHERE o_custkey % 7 <> 6
  UNION ALL
  SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 6 THEN 1 ELSE 0 END, 'ULS', {MONTH}, 'leaf-off', o_custkey,
    'https://example.org/t/' || o_orderkey || '_1.laz', o_orderkey % 5 + 1, CASE WHEN o_orderkey % 3 = 0 THEN 'true' END
    FROM orders WHERE o_orderstatus <> 'F')"""

IDS = "t._id_x, t.id, t.species"


def with_trees(body: str) -> str:
    return f"WITH {TREES} {body}"


def with_documents(body: str) -> str:
    return f"WITH {TREES}, {MEASUREMENTS}, {SCANS} {body}"


def trees_where(condition: str, select: str = IDS, tail: str = "") -> str:
    return with_trees(f"SELECT {select} FROM t WHERE {condition} {tail}")


def documents_where(condition: str) -> str:
    return with_documents(f"SELECT {IDS} FROM t WHERE {condition}")


def any_line(condition: str) -> str:
    return f"EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = t._id_x AND {condition})"


def any_scan(condition: str) -> str:
    return f"EXISTS (SELECT 1 FROM s WHERE s._id_x = t._id_x AND {condition})"


def any_measurement(condition: str) -> str:
    return f"EXISTS (SELECT 1 FROM m WHERE m._id_x = t._id_x AND {condition})"


def flag(value: str) -> str:
    return f"l.l_returnflag = '{value}'"


# ---------------------------------------------------------------- places
def haversine(lon_a: str, lat_a: str, lon_b: str, lat_b: str) -> str:
    return (
        f"2 * 6378100.0 * asin(least(1.0, sqrt(pow(sin(radians({lat_a} - {lat_b}) / 2), 2) + cos(radians({lat_a})) "
        f"* cos(radians({lat_b})) * pow(sin(radians({lon_a} - {lon_b}) / 2), 2))))"
    )


def near(lon: float, lat: float, condition: str, tail: str = "", select: str = "_id_x, round(dist_m, 1) AS dist_m") -> str:
    distance = haversine("lon", "lat", str(lon), str(lat))
    return with_trees(
        f"SELECT {select} FROM (SELECT * FROM (SELECT *, {distance} AS dist_m FROM t) WHERE {condition} {tail})"
    )


def winding(ring: Sequence[tuple[float, float]]) -> str:
    """Turn of the bearing along a counter-clockwise ring seen from ``p``, over pi: 2 iff inside."""

    def unit(lon: float, lat: float) -> tuple[float, float, float]:
        a, b = math.radians(lon), math.radians(lat)
        return math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), math.sin(b)

    def dot(v: Sequence[float]) -> str:
        return f"({v[0]!r} * p.x + {v[1]!r} * p.y + {v[2]!r} * p.z)"

    turns = []
    for (a, b) in ((unit(*p), unit(*q)) for p, q in zip(ring, ring[1:])):
        normal = (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
        cosine = sum(i * j for i, j in zip(a, b))
        turns.append(f"atan2({dot(normal)}, {cosine!r} - {dot(a)} * {dot(b)})")
    return f"({' + '.join(turns)}) / pi()"


def polygon(condition: str, select: str = IDS) -> str:
    return with_documents(
        f"""SELECT {select} FROM (SELECT t.*, cos(radians(lat)) * cos(radians(lon)) AS x,
        cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM t) p, t
        WHERE p._id_x = t._id_x AND {condition}"""
    )


SPATIAL_JOIN = with_trees(
    f"""SELECT search_id, count(*) AS n, CAST(sum(_id_x) AS BIGINT) AS ids, round(min(dist_m), 1) AS nearest_m FROM (
    SELECT s.search_id, t._id_x, s.radius_m, {haversine('t.lon', 't.lat', 's.lon', 's.lat')} AS dist_m
    FROM t, (SELECT s_suppkey AS search_id, (s_suppkey * 37 % 3600 - 1800) / CAST(10 AS DOUBLE) AS lon,
      (s_suppkey * 53 % 1800 - 900) / CAST(10 AS DOUBLE) AS lat, 50000.0 + s_suppkey % 5 * 20000.0 AS radius_m FROM supplier) s)
    WHERE dist_m <= radius_m GROUP BY search_id"""
)

_CORNERS = [(-9.03, -1.53), (9.47, -1.53), (9.47, 2.07), (-9.03, 2.07)]


def _corner(i: int) -> str:
    dx, dy = _CORNERS[i]
    lon, lat = f"radians(lon + {dx})", f"radians(lat + {dy})"
    return f"cos({lat}) * cos({lon}) AS x{i}, cos({lat}) * sin({lon}) AS y{i}, sin({lat}) AS z{i}"


def _turn(i: int, j: int) -> str:
    normal = (
        f"((s.y{i} * s.z{j} - s.z{i} * s.y{j}) * t.x + (s.z{i} * s.x{j} - s.x{i} * s.z{j}) * t.y "
        f"+ (s.x{i} * s.y{j} - s.y{i} * s.x{j}) * t.z)"
    )
    seen = [f"(s.x{k} * t.x + s.y{k} * t.y + s.z{k} * t.z)" for k in (i, j)]
    return f"atan2({normal}, s.x{i} * s.x{j} + s.y{i} * s.y{j} + s.z{i} * s.z{j} - {seen[0]} * {seen[1]})"


POLYGON_JOIN = with_trees(
    f"""SELECT search_id, count(*) AS n, CAST(sum(_id_x) AS BIGINT) AS ids FROM (
    SELECT _id_x, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM t) t,
    (SELECT search_id, {", ".join(map(_corner, range(4)))} FROM (SELECT s_suppkey AS search_id,
      (s_suppkey * 37 % 3600 - 1800) / CAST(10 AS DOUBLE) AS lon, (s_suppkey * 53 % 1700 - 850) / CAST(10 AS DOUBLE) AS lat FROM supplier)) s
    WHERE {" + ".join(_turn(i, (i + 1) % 4) for i in range(4))} > 3 GROUP BY search_id"""
)

def _scaled_corner(i: int) -> str:
    dx, dy = _CORNERS[i]
    lon, lat = f"radians(lon + f * {dx})", f"radians(lat + f * {dy})"
    return f"cos({lat}) * cos({lon}) AS x{i}, cos({lat}) * sin({lon}) AS y{i}, sin({lat}) AS z{i}"


POLYGON_JOIN_SIZES = with_trees(
    f"""SELECT search_id, count(*) AS n, CAST(sum(_id_x) AS BIGINT) AS ids FROM (
    SELECT _id_x, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM t) t,
    (SELECT search_id, {", ".join(map(_scaled_corner, range(4)))} FROM (SELECT s_suppkey AS search_id,
      CASE s_suppkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 0.05 WHEN 2 THEN 0.3 ELSE 1 END AS f,
      (s_suppkey * 37 % 3600 - 1800) / CAST(10 AS DOUBLE) AS lon, (s_suppkey * 53 % 1400 - 700) / CAST(10 AS DOUBLE) AS lat FROM supplier)) s
    WHERE {" + ".join(_turn(i, (i + 1) % 4) for i in range(4))} > 3 GROUP BY search_id"""
)

MAP_CLUSTERS = with_trees(
    """SELECT zoom, gx, gy, count(*) AS n, CASE WHEN count(*) < 100 THEN 'small' WHEN count(*) < 1000 THEN 'medium' ELSE 'large' END AS size,
    CAST(sum(_id_x % 3600 - 1800) AS BIGINT) AS lon_tenths, CAST(sum((_id_x * 7) % 1700 - 850) AS BIGINT) AS lat_tenths FROM (
    SELECT *, CAST(z.range AS INTEGER) AS zoom, CAST(floor((lon / 360.0 + 0.5) * pow(2.0, z.range) * 256 / 60) AS BIGINT) AS gx,
      CAST(floor((0.5 - 0.25 * ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / pi()) * pow(2.0, z.range) * 256 / 60) AS BIGINT) AS gy
    FROM t, range(19) z) GROUP BY zoom, gx, gy"""
)

# ---------------------------------------------------------------- documents as text
def _price(column: str) -> str:
    return f"CAST({column} AS VARCHAR)"


def _member(name: str, value: str) -> str:
    """``,"name":value`` or nothing when the SQL value is NULL."""
    return f"""coalesce(',"{name}":' || {value}, '')"""


def _quoted(value: str) -> str:
    return f"""('"' || {value} || '"')"""


_PLACE = "CAST(t.lon AS VARCHAR) || ',' || CAST(t.lat AS VARCHAR) || ',0.0'"
_SCAN_TEXT = (
    """'{"type":"pointcloud","mode":"' || s.mode || '","date":"' || s.date || '","canopy_condition":"' || s.canopy
    || '","sensor":"S1","point_count":' || s.point_count || ',"crs":"epsg:25832","file":"' || s.file
    || '","metadata-url":"https://example.org/m","quality":' || s.quality"""
    + " || "
    + _member("has_labels", _quoted("s.labels"))
    + " || '}'"
)
_MEASUREMENT_TEXT = (
    "'{' || substr("
    + " || ".join(
        [
            _member("source", _quoted("m.source")),
            _member("date", _quoted("m.date")),
            _member("canopy_condition", _quoted("m.canopy")),
            _member("DBH_cm", _price("m.dbh")),
            "CASE WHEN m.pos = 2 THEN '' ELSE ',\"height_m\":' || coalesce(" + _price("m.height") + ", 'null') END",
            _member("mean_crown_diameter_m", _price("m.crown")),
            _member("state", _quoted("m.state")),
            _member("crs", _quoted("m.crs")),
            _member("position_xyz", "('[' || CAST(m.x AS VARCHAR) || ',' || CAST(m.y AS VARCHAR) || ',0.5]')"),
        ]
    )
    + ", 2) || '}'"
)
DOC_TEXT = f"""('{{"type":"Feature","properties":{{"id":"' || t.id || '","species":"' || t.species
  || '","source":"synthetic","measurements":[' || (SELECT string_agg({_MEASUREMENT_TEXT}, ',' ORDER BY m.pos) FROM m WHERE m._id_x = t._id_x)
  || '],"measurements_metadata":[{{"reference-url":"https://example.org/ref"}}],"data":['
  || coalesce((SELECT string_agg({_SCAN_TEXT}, ',' ORDER BY s.pos) FROM s WHERE s._id_x = t._id_x), '')
  || ']}},"geometry":{{"type":"Point","coordinates":[' || {_PLACE} || ']}}}}')"""

_TREE_LEAVES = {
    "type": "'Feature'",
    "properties_id": "t.id",
    "properties_species": "t.species",
    "properties_source": "'synthetic'",
    "properties_measurements_metadata_0_reference-url": "'https://example.org/ref'",
    "geometry_type": "'Point'",
    "geometry_coordinates_0": "CAST(t.lon AS VARCHAR)",
    "geometry_coordinates_1": "CAST(t.lat AS VARCHAR)",
    "geometry_coordinates_2": "'0.0'",
}
_SCAN_LEAVES = {
    "type": "'pointcloud'",
    "mode": "s.mode",
    "date": "s.date",
    "canopy_condition": "s.canopy",
    "sensor": "'S1'",
    "point_count": "CAST(s.point_count AS VARCHAR)",
    "crs": "'epsg:25832'",
    "file": "s.file",
    "metadata-url": "'https://example.org/m'",
    "quality": "CAST(s.quality AS VARCHAR)",
    "has_labels": "s.labels",
}
_MEASUREMENT_LEAVES = {
    "source": "m.source",
    "date": "m.date",
    "canopy_condition": "m.canopy",
    "DBH_cm": "CAST(m.dbh AS VARCHAR)",
    "mean_crown_diameter_m": "CAST(m.crown AS VARCHAR)",
    "state": "m.state",
    "crs": "m.crs",
    "position_xyz_0": "CAST(m.x AS VARCHAR)",
    "position_xyz_1": "CAST(m.y AS VARCHAR)",
    "position_xyz_2": "CAST(m.z AS VARCHAR)",
}


def _kind(path: str) -> str:
    numeric = path.startswith("geometry_coordinates") or path.startswith("position_xyz")
    return "number" if numeric or path in ("point_count", "quality", "DBH_cm", "mean_crown_diameter_m") else "string"


def _leaf(alias: str, path: str, name: str, value: str) -> str:
    return f"SELECT {alias}._id_x, {path} AS path, {value} AS value, '{_kind(name)}' AS type FROM {alias} WHERE {value} IS NOT NULL"


FLATTEN = with_documents(
    " UNION ALL ".join(
        [_leaf("t", f"'{name}'", name, value) for name, value in _TREE_LEAVES.items()]
        + [_leaf("s", f"'properties_data_' || s.pos || '_{name}'", name, value) for name, value in _SCAN_LEAVES.items()]
        + [
            _leaf("m", f"'properties_measurements_' || m.pos || '_{name}'", name, value)
            for name, value in _MEASUREMENT_LEAVES.items()
        ]
        + [
            "SELECT m._id_x, 'properties_measurements_' || m.pos || '_height_m' AS path, CAST(m.height AS VARCHAR) AS value, "
            "CASE WHEN m.height IS NULL THEN 'null' ELSE 'number' END AS type FROM m WHERE m.pos < 2"
        ]
    )
)

INVENTORY = """SELECT 'tree_id_' || c_custkey || '.geojson' AS _file, c_name AS id, c_mktsegment AS species,
  CAST('16.' || (c_custkey % 90 + 10) AS DOUBLE) AS lon, CAST('48.' || (c_custkey % 80 + 10) AS DOUBLE) AS lat,
  CAST(c_custkey % 300 AS DOUBLE) AS dbh, CAST(c_custkey % 20 + 2.5 AS DOUBLE) AS height, CAST(c_custkey % 9 + 1 AS DOUBLE) AS crown,
  '2024-05-01' AS date FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AND c_custkey % 17 <> 0"""
