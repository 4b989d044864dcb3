"""Every operator as a named query over the benchmark tables, with its SQL twin.

Each entry is ``(run(spark, sf_dir) -> DataFrame, sql or None)``.  The SQL is
written against the flat tables and shares no code with the Spark side.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import geo, scalars
from ..operators import access, filters, joins, match, nodes, stats, validate
from ..operators import views as tables
from ..session import scratch_path
from ..sources import readers, stamp, writers
from . import sql
from .views import order_documents, order_text, relational, stored_documents, table

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}
IDS = ("_id_x", "id", "species")


def query(name: str, twin: str | None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        CATALOG[name] = (run, twin)
        return run

    return add


def relational_filter(name: str, condition: dict, twin: str) -> None:
    """Filter over header + element tables; output ids."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return match.where(relational(spark, sf_dir), condition).select(*IDS)

    CATALOG[name] = (run, sql.trees_where(twin))


def document_filter(name: str, condition: dict, twin: str) -> None:
    """The same filter language over columnar documents; output ids."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return match.where(order_documents(spark, sf_dir), condition).select(*IDS)

    CATALOG[name] = (run, sql.documents_where(twin))


any_line, any_scan, any_measurement = sql.any_line, sql.any_scan, sql.any_measurement
DATA, MEASURED = "properties.data", "properties.measurements"
ELEM = {DATA: {"$elemMatch": {"quality": {"$lte": 2}, "mode": "R"}}}
DAY = "strftime(l.l_shipdate, '%Y-%m-%d')"
HEIGHT = "CASE WHEN l.l_discount >= 0.02 THEN l.l_extendedprice END"

# ---------------------------------------------------------------- predicates, relational documents
relational_filter("eq_scalar", {"properties.species": "2-HIGH"}, "t.species = '2-HIGH'")
relational_filter("eq_any_element", {f"{DATA}.mode": "A"}, any_line("l.l_returnflag = 'A'"))
relational_filter("cmp_gt", {f"{MEASURED}.height_m": {"$gt": 80000}}, any_line(f"{HEIGHT} > 80000"))
relational_filter("cmp_gte", {f"{MEASURED}.DBH_cm": {"$gte": 50}}, any_line("l.l_returnflag = 'A' AND l.l_quantity >= 50"))
relational_filter("cmp_lt", {f"{MEASURED}.height_m": {"$lt": 2000}}, any_line(f"{HEIGHT} < 2000"))
relational_filter("cmp_lte", {f"{DATA}.quality": {"$lte": 1}}, any_line("l.l_linenumber <= 1"))
relational_filter(
    "cmp_range_any",
    {f"{MEASURED}.DBH_cm": {"$lt": 5, "$gt": 45}},
    any_line("l.l_returnflag = 'A' AND l.l_quantity < 5") + " AND " + any_line("l.l_returnflag = 'A' AND l.l_quantity > 45"),
)
relational_filter("op_eq", {f"{DATA}.point_count": {"$eq": 17}}, any_line("l.l_quantity = 17"))
relational_filter("op_ne", {f"{DATA}.mode": {"$ne": "R"}}, "NOT " + any_line("l.l_returnflag = 'R'"))
relational_filter("op_in", {f"{DATA}.quality": {"$in": [6, 7]}}, any_line("l.l_linenumber IN (6, 7)"))
relational_filter(
    "op_nin",
    {f"{MEASURED}.canopy_condition": {"$nin": ["F"]}},
    "NOT " + any_line("l.l_linenumber <> 1 AND l.l_linestatus = 'F'"),
)
relational_filter(
    "logical_and",
    {"$and": [{f"{DATA}.quality": {"$lte": 2}}, {f"{DATA}.mode": "R"}]},
    any_line("l.l_linenumber <= 2") + " AND " + any_line("l.l_returnflag = 'R'"),
)
relational_filter(
    "logical_or",
    {"$or": [ELEM, {"$and": [{f"{DATA}.mode": "N"}, {f"{MEASURED}.DBH_cm": {"$gt": 48}}]}]},
    f"({any_line("l.l_linenumber <= 2 AND l.l_returnflag = 'R'")} OR ("
    + any_line("l.l_returnflag = 'N'")
    + " AND "
    + any_line("l.l_returnflag = 'A' AND l.l_quantity > 48")
    + "))",
)
relational_filter(
    "logical_nor",
    {"$nor": [{f"{DATA}.mode": "A"}, {f"{DATA}.mode": "N"}]},
    f"NOT ({any_line(sql.flag('A'))} OR {any_line(sql.flag('N'))})",
)
relational_filter(
    "not_regex",
    {f"{DATA}.file": {"$not": {"$regex": "_[1-3]_A"}}},
    "NOT " + any_line("l.l_returnflag = 'A' AND l.l_linenumber BETWEEN 1 AND 3"),
)
relational_filter("elem_match", ELEM, any_line("l.l_linenumber <= 2 AND l.l_returnflag = 'R'"))
relational_filter(
    "elem_match_nested",
    {MEASURED: {"$elemMatch": {"$and": [{"source": "A"}, {"height_m": {"$exists": True}}], "DBH_cm": {"$gt": 20, "$lt": 30}}}},
    any_line("l.l_returnflag = 'A' AND l.l_quantity > 20 AND l.l_quantity < 30"),
)
relational_filter("key_exists", {f"{MEASURED}.canopy_condition": {"$exists": 1}}, any_line("l.l_linenumber <> 1"))
relational_filter("key_exists_null", {f"{MEASURED}.height_m": {"$exists": True}}, any_line("TRUE"))
relational_filter(
    "dotted_implicit_and",
    {"properties.species": "1-URGENT", f"{DATA}.canopy_condition": "O", f"{DATA}.quality": 3},
    "t.species = '1-URGENT' AND " + any_line("l.l_linestatus = 'O'") + " AND " + any_line("l.l_linenumber = 3"),
)
FORM_ROWS = (
    [("mode", "R"), ("quality", [1, 2]), ("species", "5-LOW"), ("dbh", (10, 20)), ("source", "A"), ("labels", "Not set")],
    ["", "AND", "OR", "AND", "AND", "AND"],
    [0, 0, 1, 1, 1, 0],
)


def form_condition() -> dict:
    rows, operands, brackets = FORM_ROWS
    return filters.compose_filters([filters.form_filter(*row) for row in rows], operands, brackets, elem_match=True)


relational_filter(
    "compose_filters",
    form_condition(),
    f"(({any_line(sql.flag('R'))} AND ({any_line('l.l_linenumber = 1')} OR {any_line('l.l_linenumber = 2')})) OR "
    f"(t.species = '5-LOW' AND {any_line(sql.flag('A') + ' AND l.l_quantity > 10 AND l.l_quantity < 20')}))",
)

# ---------------------------------------------------------------- predicates, columnar documents
document_filter(
    "doc_elem_match",
    {DATA: {"$elemMatch": {"quality": {"$lte": 2}, "mode": "ULS"}}},
    any_scan("s.quality <= 2 AND s.mode = 'ULS'"),
)
document_filter(
    "doc_any_element",
    {f"{DATA}.quality": {"$lte": 2}, f"{DATA}.mode": "ULS"},
    any_scan("s.quality <= 2") + " AND " + any_scan("s.mode = 'ULS'"),
)
document_filter(
    "doc_not_nor",
    {"$nor": [{f"{MEASURED}.source": "FI"}, {f"{DATA}.file": {"$regex": "7_1.laz$"}}]},
    f"NOT ({any_measurement("m.source = 'FI'")} OR {any_scan("regexp_matches(s.file, '7_1.laz$')")})",
)
document_filter(
    "doc_key_exists",
    {f"{MEASURED}.mean_crown_diameter_m": {"$exists": False}},
    "NOT " + any_measurement("m.crown IS NOT NULL"),
)
document_filter(
    "doc_null_is_present",
    {MEASURED: {"$elemMatch": {"source": "FI", "height_m": {"$exists": True}, "$nor": [{"height_m": {"$gt": 0}}]}}},
    any_measurement("m.source = 'FI' AND m.height IS NULL"),
)
document_filter("doc_untyped_path", {f"{MEASURED}.position_xyz": {"$gt": 14000}}, any_measurement("greatest(m.x, m.y, m.z) > 14000"))
document_filter(
    "doc_labels_not_set", {f"{DATA}.has_labels": {"$nin": ["true", "false"]}}, "NOT " + any_scan("s.labels IS NOT NULL")
)


# ---------------------------------------------------------------- named filters
@query("species_regex", sql.trees_where("regexp_matches(t.species, '[0-9]-[HL]')"))
def _(spark, sf):
    return filters.by_species(relational(spark, sf), "[0-9]-[HL]").select(*IDS)


@query("key_value", sql.trees_where(any_line("l.l_linenumber BETWEEN 5 AND 7 AND l.l_returnflag = 'N'")))
def _(spark, sf):
    return filters.by_key_value(relational(spark, sf), f"{DATA}.file", "_[5-7]_N").select(*IDS)


@query(
    "date_range",
    sql.trees_where(any_line(f"{DAY} >= '1998-01-01T00:00:00'") + " AND " + any_line(f"{DAY} <= '1998-06-30T00:00:00'")),
)
def _(spark, sf):
    return filters.by_date(relational(spark, sf), f"{DATA}.date", "1998-01-01", "1998-06-30").select(*IDS)


@query(
    "date_range_same_element",
    sql.trees_where(any_line("CAST(l.l_shipdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-06-30'")),
)
def _(spark, sf):
    return filters.by_date_same_element(relational(spark, sf), f"{DATA}.date", "1998-01-01", "1998-06-30").select(*IDS)


POINT = {"type": "Point", "coordinates": [8.7, 49.0]}


@query("near_point", sql.near(8.7, 49.0, "dist_m <= 900000"))
def _(spark, sf):
    hits = filters.near_point(relational(spark, sf), POINT, 900_000.0)
    return hits.select("_id_x", F.round("dist_m", 1).alias("dist_m"))


@query("nearest_k", sql.near(8.7, 49.0, "TRUE", "ORDER BY dist_m, _id_x LIMIT 25"))
def _(spark, sf):
    hits = filters.nearest_k(relational(spark, sf), POINT, 25)
    return hits.select("_id_x", F.round("dist_m", 1).alias("dist_m"))


# Ring corners lie between the tree positions: a tree exactly on an edge has no defined side.
PLOT = [(10.05, 40.05), (20.55, 40.05), (20.55, 60.05), (10.05, 60.05), (10.05, 40.05)]
HOLE = [(13.05, 45.05), (17.05, 45.05), (17.05, 50.05), (13.05, 50.05), (13.05, 45.05)]


def circle(lon: float, lat: float, degrees: float, corners: int) -> list[tuple[float, float]]:
    """A closed ring of points at one distance from a centre, which lies to the right of it."""
    a, b, d = math.radians(lon), math.radians(lat), math.radians(degrees)
    ring = []
    for bearing in (math.tau * i / corners for i in range(corners)):
        up = math.asin(math.sin(b) * math.cos(d) + math.cos(b) * math.sin(d) * math.cos(bearing))
        east = math.atan2(math.sin(bearing) * math.sin(d) * math.cos(b), math.cos(d) - math.sin(b) * math.sin(up))
        ring.append(((math.degrees(a + east) + 540.0) % 360.0 - 180.0, math.degrees(up)))
    return [*ring, ring[0]]


#: The left side of this ring is all but a circle of 77 degrees.
HUGE = circle(171.13, -4.27, 77.0, 7)


@query("within_polygon", sql.polygon(f"{sql.winding(PLOT)} > 1"))
def _(spark, sf):
    return filters.within_polygon(relational(spark, sf), {"type": "Polygon", "coordinates": [PLOT]}).select(*IDS)


@query("within_polygon_holes", sql.polygon(f"{sql.winding(PLOT)} > 1 AND NOT {sql.winding(HOLE)} > 1"))
def _(spark, sf):
    return filters.within_polygon(relational(spark, sf), {"type": "Polygon", "coordinates": [PLOT, HOLE]}).select(*IDS)


@query("within_polygon_strict", sql.polygon(f"NOT {sql.winding(HUGE[::-1])} > 1"))
def _(spark, sf):
    huge = {"type": "Polygon", "coordinates": [HUGE], "crs": {"type": "name", "properties": {"name": geo.STRICT_WINDING}}}
    return filters.within_polygon(relational(spark, sf), huge).select(*IDS)


@query(
    "within_viewport",
    sql.trees_where("t.lon BETWEEN 160.5 AND 180 AND t.lat BETWEEN -90 AND 20.5 AND " + any_line(sql.flag("A"))),
)
def _(spark, sf):
    view = (160.5, -120.0, 999.0, 20.5)
    return filters.within_viewport(relational(spark, sf), view, {f"{DATA}.mode": "A"}).select(*IDS)


@query(
    "range_or_missing",
    f"""SELECT l_orderkey AS _id_x, l_quantity AS dbh, l_extendedprice AS height FROM (
        SELECT l_orderkey, CASE WHEN l_returnflag = 'A' THEN l_quantity END AS l_quantity, l_returnflag,
               {HEIGHT} AS l_extendedprice FROM lineitem l)
        WHERE (l_extendedprice BETWEEN 0 AND 50000 OR l_extendedprice IS NULL)
          AND (l_quantity BETWEEN 10 AND 999 OR l_quantity IS NULL) AND l_returnflag IN ('A', 'N')""",
)
def _(spark, sf):
    rows = relational(spark, sf).rows(MEASURED)
    kept = filters.range_or_missing(rows, {"height_m": (None, 50000), "DBH_cm": (10, None)}, {"source": ["A", "N"]})
    return kept.select("_id_x", F.col("DBH_cm").alias("dbh"), F.col("height_m").alias("height"))


# ---------------------------------------------------------------- access, projection, limit
@query("get_item", sql.trees_where("t._id_x = (SELECT max(o_orderkey) FROM orders) - 6"))
def _(spark, sf):
    return access.get_item(relational(spark, sf), -7).select(*IDS)


@query(
    "get_items",
    sql.with_trees("SELECT CAST(i.pos AS BIGINT) AS pos, t._id_x, t.id, t.species FROM (VALUES (0, 100), (1, 7), (2, 100), (3, 1499)) i(pos, n) JOIN t ON t._id_x = i.n"),
)
def _(spark, sf):
    return access.get_items(relational(spark, sf), [100, 7, 100, 1499]).select("pos", *IDS)


@query("slice_items", sql.trees_where("t._id_x BETWEEN 3 AND (SELECT max(o_orderkey) FROM orders) - 1 AND (t._id_x - 3) % 7 = 0"))
def _(spark, sf):
    return access.slice_items(relational(spark, sf), 3, -1, 7).select(*IDS)


@query("count_docs", "SELECT count(*) AS n FROM orders")
def _(spark, sf):
    return access.count_docs(relational(spark, sf))


@query("get_ids", sql.trees_where(any_line("l.l_linenumber <= 2 AND l.l_returnflag = 'R'"), "t._id_x"))
def _(spark, sf):
    return access.get_ids(match.where(relational(spark, sf), ELEM))


LINK = "'https://example.org/t/' || l_orderkey || '_' || l_linenumber || '_' || l_returnflag || '.laz'"
ELEM_SQL = "SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 2 AND l_returnflag = 'R'"


@query("pointcloud_urls", f"SELECT l_orderkey AS _id_x, {LINK} AS file FROM lineitem WHERE l_orderkey IN ({ELEM_SQL})")
def _(spark, sf):
    trees = relational(spark, sf)
    return access.pointcloud_urls(trees, match.where(trees, ELEM))


@query("pointcloud_urls_doc", sql.with_documents("SELECT _id_x, pos, file FROM s"))
def _(spark, sf):
    links = access.pointcloud_urls(order_documents(spark, sf))
    return links.select("_id_x", F.col("pos").cast("int").alias("pos"), "file")


@query(
    "project_include",
    sql.with_documents(
        """SELECT t._id_x, '{"data":[' || coalesce((SELECT string_agg('{"file":"' || s.file || '"}', ',' ORDER BY s.pos)
           FROM s WHERE s._id_x = t._id_x), '') || '],"id":"' || t.id || '"}' AS properties, 'Feature' AS type FROM t"""
    ),
)
def _(spark, sf):
    kept = access.project_include(model.parsed(order_text(spark, sf)), ["_id_x", "type", "properties.id", f"{DATA}.file"])
    return kept.select(
        "_id_x",
        F.to_json(model.child(F.col("doc"), "properties")).alias("properties"),
        F.try_variant_get("doc", "$.type", "string").alias("type"),
    )


@query(
    "project_exclude",
    sql.with_documents(
        """SELECT t._id_x, '{"id":"' || t.id || '","measurements_metadata":[{"reference-url":"https://example.org/ref"}],'
           || '"source":"synthetic","species":"' || t.species || '"}' AS properties, CAST(NULL AS VARCHAR) AS geometry FROM t"""
    ),
)
def _(spark, sf):
    kept = access.project_exclude(model.parsed(order_text(spark, sf)), ["_date", "_file", "geometry", DATA, MEASURED])
    return kept.select(
        "_id_x",
        F.to_json(model.child(F.col("doc"), "properties")).alias("properties"),
        F.try_variant_get("doc", "$.geometry.type", "string").alias("geometry"),
    )


@query("limit_skip", sql.trees_where("t.species = '3-MEDIUM'", tail="ORDER BY t._id_x LIMIT 50 OFFSET 120"))
def _(spark, sf):
    return access.limit_skip(filters.by_species(relational(spark, sf), "MEDIUM"), 120, 50).select(*IDS)


@query(
    "page_results",
    sql.with_trees(
        f"""SELECT h._id_x, h.id, h.species, n.num_res FROM (SELECT * FROM t WHERE {any_line("l.l_linenumber = 7")}
            ORDER BY _id_x LIMIT 10 OFFSET 20) h, (SELECT count(*) AS num_res FROM t WHERE {any_line("l.l_linenumber = 7")}) n"""
    ),
)
def _(spark, sf):
    page, total, _ = access.page_results(relational(spark, sf), {f"{DATA}.quality": 7}, 10, 2)
    return page.select(*IDS).withColumn("num_res", total.scalar())


@query("field_projection", sql.trees_where(any_line(sql.flag("N")), "t._id_x, t.id, t.species, t.lon, t.lat, CAST(0 AS DOUBLE) AS elev"))
def _(spark, sf):
    return access.field_projection(match.where(relational(spark, sf), {f"{DATA}.mode": "N"}))


# ---------------------------------------------------------------- joins and sets
@query("semi_join_ids", sql.trees_where(any_line("l.l_linenumber <= 2 AND l.l_returnflag = 'R'")))
def _(spark, sf):
    trees = relational(spark, sf)
    return joins.semi_join_ids(trees.header, access.get_ids(match.where(trees, ELEM))).select(*IDS)


@query(
    "merge_data_measurements",
    sql.with_documents(
        """SELECT s._id_x, s.mode, s.quality, s.file, m.source, m.height AS height_m, m.crown AS mean_crown_diameter_m
           FROM s JOIN m ON m._id_x = s._id_x
           WHERE s.mode = 'ULS' AND s.canopy = 'leaf-off' AND s.quality IN (1, 2, 3) AND m.source IN ('FI', 'ULS')
             AND (m.height BETWEEN 0 AND 300000 OR m.height IS NULL)"""
    ),
)
def _(spark, sf):
    merged = joins.merge_data_measurements(
        order_documents(spark, sf),
        {"mode": "ULS", "canopy_condition": "leaf-off", "quality": {"$in": [1, 2, 3]}},
        {
            "source": {"$in": ["FI", "ULS"]},
            "$or": [{"height_m": {"$gte": 0, "$lte": 300000}}, {"height_m": None}],
        },
    )
    return merged.select(
        "_id_x", "mode", F.col("quality").cast("bigint").alias("quality"), "file", "source", "height_m", "mean_crown_diameter_m"
    )


@query(
    "pair_sources",
    sql.with_documents(
        """SELECT a._id_x, a.height AS left_value, b.height AS right_value FROM m a JOIN m b ON a._id_x = b._id_x
           WHERE a.source = 'FI' AND b.source = 'TLS' AND b.canopy = 'leaf-on'"""
    ),
)
def _(spark, sf):
    pairs = joins.pair_sources(
        order_documents(spark, sf), {"source": "FI"}, "height_m", {"source": "TLS", "canopy_condition": "leaf-on"}, "height_m"
    )
    return pairs.select("_id_x", "left_value", "right_value")


@query("anti_join_missing_source", sql.trees_where(f"NOT ({any_line(sql.flag('A'))} OR {any_line(sql.flag('N'))})"))
def _(spark, sf):
    return joins.anti_join_missing_source(relational(spark, sf), ["A", "N"]).select(*IDS)


@query("spatial_join", sql.SPATIAL_JOIN)
def _(spark, sf):
    key = F.col("s_suppkey")
    searches = table(spark, sf, "supplier").select(
        key.alias("search_id"),
        ((key * 37 % 3600 - 1800) / F.lit(10.0)).alias("lon"),
        ((key * 53 % 1800 - 900) / F.lit(10.0)).alias("lat"),
        (F.lit(50000.0) + key % 5 * 20000.0).alias("radius_m"),
    )
    hits = joins.spatial_join(relational(spark, sf).header, searches, 130_000.0)
    return hits.groupBy("search_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_id_x").alias("ids"), F.round(F.min("dist_m"), 1).alias("nearest_m")
    )


@query("spatial_join_polygons", sql.POLYGON_JOIN)
def _(spark, sf):
    key = F.col("s_suppkey")
    lon, lat = (key * 37 % 3600 - 1800) / F.lit(10.0), (key * 53 % 1700 - 850) / F.lit(10.0)
    corners = [(-9.03, -1.53), (9.47, -1.53), (9.47, 2.07), (-9.03, 2.07), (-9.03, -1.53)]
    ring = F.array(*[F.array(lon + x, lat + y) for x, y in corners])
    searches = table(spark, sf, "supplier").select(key.alias("search_id"), ring.alias("ring"))
    hits = joins.spatial_join_polygons(relational(spark, sf).header, searches)
    return hits.groupBy("search_id").agg(F.count(F.lit(1)).alias("n"), F.sum("_id_x").alias("ids"))


@query("spatial_join_polygon_sizes", sql.POLYGON_JOIN_SIZES)
def _(spark, sf):
    """Searches whose sizes differ by a factor of 60."""
    key = F.col("s_suppkey")
    lon, lat = (key * 37 % 3600 - 1800) / F.lit(10.0), (key * 53 % 1400 - 700) / F.lit(10.0)
    corners = [(-9.03, -1.53), (9.47, -1.53), (9.47, 2.07), (-9.03, 2.07), (-9.03, -1.53)]
    factor = F.element_at(F.array(*map(F.lit, (3.0, 0.05, 0.3, 1.0))), (key % 4 + 1).cast("int"))
    ring = F.array(*[F.array(lon + factor * x, lat + factor * y) for x, y in corners])
    searches = table(spark, sf, "supplier").select(key.alias("search_id"), ring.alias("ring"))
    hits = joins.spatial_join_polygons(relational(spark, sf).header, searches)
    return hits.groupBy("search_id").agg(F.count(F.lit(1)).alias("n"), F.sum("_id_x").alias("ids"))


@query("intersect_results", sql.trees_where(any_line("l.l_linenumber <= 2") + " AND " + any_line(sql.flag("R"))))
def _(spark, sf):
    trees = relational(spark, sf)
    parts = [match.where(trees, q) for q in ({f"{DATA}.quality": {"$lte": 2}}, {f"{DATA}.mode": "R"})]
    return joins.intersect_results(*parts).select(*IDS)


@query("union_results", sql.trees_where("t.species = '5-LOW' OR " + any_line("l.l_linenumber = 7")))
def _(spark, sf):
    trees = relational(spark, sf)
    parts = [match.where(trees, q) for q in ({"properties.species": "5-LOW"}, {f"{DATA}.quality": 7})]
    return joins.union_results(*parts).select(*IDS)


@query(
    "union_append",
    sql.with_trees(f"SELECT _id_x, id, species FROM t WHERE species = '5-LOW' UNION ALL SELECT _id_x, id, species FROM t WHERE {any_line('l.l_linenumber = 7')}"),
)
def _(spark, sf):
    trees = relational(spark, sf)
    low, seven = (match.where(trees, q) for q in ({"properties.species": "5-LOW"}, {f"{DATA}.quality": 7}))
    return joins.union_append(low, seven).select(*IDS)


# ---------------------------------------------------------------- statistics
@query("stats", "SELECT count(*) AS n_trees, count(DISTINCT o_orderpriority) AS n_species FROM orders")
def _(spark, sf):
    return stats.stats(relational(spark, sf))


@query("list_species", "SELECT DISTINCT o_orderpriority AS species FROM orders")
def _(spark, sf):
    return stats.list_species(relational(spark, sf))


@query("distinct_any_path", "SELECT DISTINCT CAST(l_linenumber AS VARCHAR) AS value FROM lineitem")
def _(spark, sf):
    return stats.distinct_any_path(relational(spark, sf), f"{DATA}.quality")


@query("distinct_any_path_doc", sql.with_documents("SELECT DISTINCT date AS value FROM m WHERE date IS NOT NULL"))
def _(spark, sf):
    return stats.distinct_any_path(order_documents(spark, sf), f"{MEASURED}.date")


@query(
    "shared_properties",
    "SELECT unnest(['data', 'id', 'measurements', 'measurements_metadata', 'source', 'species']) AS key WHERE (SELECT count(*) FROM orders) > 0",
)
def _(spark, sf):
    return stats.shared_properties(stored_documents(spark, sf))


@query(
    "measurement_keys",
    sql.with_documents(
        """SELECT 'date' AS key FROM m WHERE date IS NOT NULL UNION SELECT 'source' FROM m WHERE source IS NOT NULL
           UNION SELECT 'canopy_condition' FROM m WHERE canopy IS NOT NULL UNION SELECT 'DBH_cm' FROM m WHERE dbh IS NOT NULL
           UNION SELECT 'height_m' FROM m WHERE pos < 2 UNION SELECT 'state' FROM m WHERE state IS NOT NULL
           UNION SELECT 'mean_crown_diameter_m' FROM m WHERE crown IS NOT NULL
           UNION SELECT 'crs' FROM m WHERE crs IS NOT NULL UNION SELECT 'position_xyz' FROM m WHERE x IS NOT NULL"""
    ),
)
def _(spark, sf):
    return stats.measurement_keys(order_documents(spark, sf))


@query(
    "count_by_mode_canopy",
    sql.with_trees(
        " UNION ALL ".join(
            f"SELECT '{name}' AS name, count(*) AS n FROM t WHERE {any_line(condition)}"
            for name, condition in {
                "A": "l.l_returnflag = 'A'",
                "R_F": "l.l_returnflag = 'R' AND l.l_linestatus = 'F'",
                "R_O": "l.l_returnflag = 'R' AND l.l_linestatus = 'O'",
                "N": "l.l_returnflag = 'N'",
            }.items()
        )
    ),
)
def _(spark, sf):
    groups = {
        "A": {f"{DATA}.mode": "A"},
        "R_F": {DATA: {"$elemMatch": {"mode": "R", "canopy_condition": "F"}}},
        "R_O": {DATA: {"$elemMatch": {"mode": "R", "canopy_condition": "O"}}},
        "N": {f"{DATA}.mode": "N"},
    }
    return stats.count_by(relational(spark, sf), groups)


@query(
    "histogram",
    f"""WITH v AS (SELECT {HEIGHT} AS v FROM lineitem l WHERE l_returnflag = 'A'),
        e AS (SELECT min(v) AS low, max(v) AS high FROM v)
        SELECT CAST(least(floor((v - low) / (high - low) * 50), 49) AS INTEGER) AS bin, count(*) AS n
        FROM v, e WHERE v IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    rows = relational(spark, sf).rows(MEASURED).where(F.col("source") == "A")
    return stats.histogram(rows, "height_m", 50)


@query(
    "species_crown_height",
    sql.with_documents(
        """SELECT t.species, count(*) AS n, min(m.height) AS min_height_m, max(m.height) AS max_height_m,
           round(avg(m.height), 2) AS avg_height_m, max(m.crown) AS max_crown_m, round(avg(m.crown), 6) AS avg_crown_m
           FROM m JOIN t ON t._id_x = m._id_x WHERE m.source = 'ULS' AND m.canopy = 'leaf-on' AND m.crown IS NOT NULL GROUP BY 1"""
    ),
)
def _(spark, sf):
    _, summary = stats.species_crown_height(order_documents(spark, sf))
    return summary.withColumns(
        {"avg_height_m": F.round("avg_height_m", 2), "avg_crown_m": F.round("avg_crown_m", 6)}
    )


@query("map_clusters", sql.MAP_CLUSTERS)
def _(spark, sf):
    clusters = stats.map_clusters(relational(spark, sf))
    return clusters.select(
        "zoom",
        "gx",
        "gy",
        "n",
        "size",
        F.round(F.col("lon") * F.col("n") * 10).cast("bigint").alias("lon_tenths"),
        F.round(F.col("lat") * F.col("n") * 10).cast("bigint").alias("lat_tenths"),
    )


@query("rows_per_source", "SELECT l_returnflag AS source, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, sf):
    return stats.rows_per_source(relational(spark, sf).rows(MEASURED))


# ---------------------------------------------------------------- relational views
@query(
    "csv_general",
    sql.with_documents(
        """SELECT t.id AS tree_id, t.species, t.lat AS lat_epsg4326, t.lon AS long_epsg4326, CAST(0 AS DOUBLE) AS elev_epsg4326,
           m.x, m.y, m.z, m.crs AS xyz_crs FROM t LEFT JOIN m ON m._id_x = t._id_x AND m.crs IS NOT NULL"""
    ),
)
def _(spark, sf):
    return tables.tree_general(stored_documents(spark, sf))


@query(
    "csv_metrics",
    sql.with_documents(
        """SELECT t.id AS tree_id, m.dbh AS "DBH_cm", m.canopy AS canopy_condition, m.date, m.height AS height_m,
           m.crown AS mean_crown_diameter_m, m.source, m.state FROM m JOIN t ON t._id_x = m._id_x WHERE m.source IS NOT NULL"""
    ),
)
def _(spark, sf):
    wide = tables.tree_metrics(stored_documents(spark, sf))
    return wide.withColumns({c: F.col(c).cast("double") for c in ("DBH_cm", "height_m", "mean_crown_diameter_m")})


@query(
    "write_csv",
    "SELECT o_orderkey AS _id_x, CASE WHEN o_orderstatus = 'F' THEN 'oak, \"red\"' END AS species, o_totalprice AS price FROM orders",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("_id_x"),
        F.when(F.col("o_orderstatus") == "F", 'oak, "red"').alias("species"),
        F.col("o_totalprice").alias("price"),
    )
    path = scratch_path(spark, "csv")
    writers.write_csv(rows, path)
    return spark.read.option("header", True).option("escape", '"').schema("_id_x long, species string, price double").csv(path)


# ---------------------------------------------------------------- nodes
@query("flatten_docs", sql.FLATTEN)
def _(spark, sf):
    return nodes.flatten_docs(order_text(spark, sf)).select("_id_x", "path", "value", "type")


@query("extract_key", "SELECT event_id, 'k' AS name, regexp_extract(props, '([0-9]+)', 1) AS value, 'number' AS type FROM events")
def _(spark, sf):
    found = nodes.extract_key(table(spark, sf, "events"), "k", key="event_id", text="props")
    return found.select("event_id", "name", "value", "type")


@query("extract_key_regex", sql.with_documents("SELECT _id_x, mode AS value FROM s WHERE mode IN ('TLS', 'ULS')"))
def _(spark, sf):
    return nodes.extract_key_regex(order_text(spark, sf), "mode", "^[tu]ls").select("_id_x", "value")


@query("extract_key_exact", sql.with_documents("SELECT _id_x, CAST(quality AS VARCHAR) AS value FROM s WHERE quality = 2"))
def _(spark, sf):
    return nodes.extract_key_exact(order_text(spark, sf), "quality", 2).select("_id_x", "value")


@query("extract_key_numeric", "SELECT event_id, v AS value FROM (SELECT event_id, regexp_extract(props, '([0-9]+)', 1) AS v FROM events) WHERE CAST(v AS DOUBLE) > 50")
def _(spark, sf):
    found = nodes.extract_key_numeric(table(spark, sf, "events"), "k", "gt", 50, key="event_id", text="props")
    return found.select("event_id", "value")


@query(
    "extract_key_date",
    sql.with_documents("SELECT _id_x, date AS value FROM (SELECT _id_x, date FROM s UNION ALL SELECT _id_x, date FROM m) WHERE date < '1997-03-01'"),
)
def _(spark, sf):
    return nodes.extract_key_date(order_text(spark, sf), "date", "lt", "1997-03-01").select("_id_x", "value")


# ---------------------------------------------------------------- sources and sinks
SUMMARY_SQL = "t.id, t.species, t.lon, t.lat, (SELECT count(*) FROM s WHERE s._id_x = t._id_x) AS n_scans"


def _summary(docs: DataFrame, *extra: str) -> DataFrame:
    return docs.select(*extra, "id", "species", "lon", "lat", F.size("data.mode").cast("bigint").alias("n_scans"))


@query("import_docs", sql.with_documents(f"SELECT t._file, {SUMMARY_SQL} FROM t"))
def _(spark, sf):
    outdir = scratch_path(spark, "geojson")
    writers.export_docs(order_documents(spark, sf), outdir).count()
    return _summary(model.documents(readers.import_docs(spark, outdir)), "_file")


@query("export_docs", sql.with_documents("SELECT t._id_x, t._file FROM t"))
def _(spark, sf):
    return writers.export_docs(order_documents(spark, sf), scratch_path(spark, "geojson")).select("_id_x", "_file")


@query("import_stamped", sql.with_documents(f"SELECT t._id_x, t._file, {SUMMARY_SQL} FROM t JOIN orders ON o_orderkey = t._id_x"))
def _(spark, sf):
    """Files numbered in path order: their names sort as their ids do."""
    outdir = scratch_path(spark, "geojson")
    writers.export_docs(order_documents(spark, sf), outdir).count()
    rows = readers.import_docs(spark, outdir)
    return _summary(model.documents(stamp.stamp_files(rows, rows)), "_id_x", "_file")


@query("import_zip", sql.with_documents(f"SELECT t._file, {SUMMARY_SQL} FROM t"))
def _(spark, sf):
    folder = scratch_path(spark, "archives")
    writers.save_archives(order_text(spark, sf), folder)
    return _summary(model.documents(readers.import_zip(spark, folder)), "_file")


@query("import_dump", sql.with_documents(f"SELECT t._id_x, t._file, {SUMMARY_SQL} FROM t"))
def _(spark, sf):
    folder = scratch_path(spark, "arrays")
    writers.save_arrays(order_text(spark, sf), folder)
    rows = readers.read_dump(spark, folder).where("rejected IS NULL").select("path", "place", "_file", "raw")
    return _summary(model.documents(stamp.stamp_members(rows)), "_id_x", "_file")


@query("import_dump_lines", sql.with_documents(f"SELECT t._file, t._id_x AS stored_id, {SUMMARY_SQL} FROM t"))
def _(spark, sf):
    """The splittable dump is a sequence of values to the scanner."""
    path = scratch_path(spark, "dump")
    writers.save_dump(order_text(spark, sf), path)
    return _summary(readers.load_dump(spark, path, form="array"), "_file", "_id_x").withColumnRenamed("_id_x", "stored_id")


@query("save_dump", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM orders")
def _(spark, sf):
    path = scratch_path(spark, "dump")
    writers.save_dump(order_text(spark, sf), path)
    ids = F.get_json_object("value", "$._id_x").cast("bigint")
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("n"), F.sum(ids).alias("ids"))


@query("load_dump", sql.with_documents(f"SELECT t._id_x, t._file, '2024-01-01T00:00:00' AS _date, {SUMMARY_SQL} FROM t"))
def _(spark, sf):
    path = scratch_path(spark, "dump")
    writers.save_dump(order_text(spark, sf), path)
    return _summary(readers.load_dump(spark, path, form="lines"), "_id_x", "_file", "_date")


@query("stamp_metadata", "SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS _id_x, o_orderkey AS key FROM orders")
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return stamp.stamp_metadata(rows, "o_custkey", "o_orderkey").select("_id_x", F.col("o_orderkey").alias("key"))


@query(
    "append_import",
    """SELECT o_orderkey AS _id_x, o_orderkey AS key FROM orders UNION ALL
       SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY o_orderkey) AS _id_x, o_orderkey AS key
       FROM orders WHERE o_orderstatus = 'F'""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus")
    existing = orders.select(F.col("key").alias("_id_x"), "key")
    fresh = orders.where(F.col("o_orderstatus") == "F").select("key")
    return stamp.append_import(existing, fresh, "key").select("_id_x", "key")


@query(
    "replicate_docs",
    """SELECT c.range * (SELECT count(*) FROM orders) + o_orderkey AS _id_x, o_orderpriority AS species
       FROM orders, range(3) c""",
)
def _(spark, sf):
    return stamp.replicate_docs(relational(spark, sf).header, 3).select("_id_x", "species")


@query(
    "validate_docs",
    sql.with_documents(
        """SELECT t._id_x, CASE WHEN o_custkey % 10 = 9 THEN 1 ELSE 0 END
           + CASE WHEN o_custkey % 7 = 6 AND o_orderstatus = 'F' THEN 9 ELSE 0 END AS n_missing,
           NOT (o_custkey % 10 = 9 OR (o_custkey % 7 = 6 AND o_orderstatus = 'F')) AS valid
           FROM t JOIN orders ON o_orderkey = t._id_x"""
    ),
)
def _(spark, sf):
    checked = validate.validate_docs(model.parsed(order_text(spark, sf)))
    return checked.select("_id_x", F.size("missing").alias("n_missing"), "valid")


@query(
    "reject_docs",
    sql.with_documents(
        """SELECT t._file, CASE WHEN o_orderstatus = 'P' THEN 'not valid JSON' WHEN o_custkey % 7 = 6 AND o_orderstatus = 'F'
           THEN 'missing: ' || CASE WHEN o_custkey % 10 = 9 THEN 'properties_measurements_0_source, ' ELSE '' END
             || 'properties_data_0_type, properties_data_0_mode, properties_data_0_file, properties_data_0_date, '
             || 'properties_data_0_canopy_condition, properties_data_0_point_count, properties_data_0_metadata-url, '
             || 'properties_data_0_crs, properties_data_0_quality'
           ELSE 'missing: properties_measurements_0_source' END AS reason
           FROM t JOIN orders ON o_orderkey = t._id_x
           WHERE o_orderstatus = 'P' OR o_custkey % 10 = 9 OR (o_custkey % 7 = 6 AND o_orderstatus = 'F')"""
    ),
)
def _(spark, sf):
    cut = F.when(F.col("o_orderstatus") == "P", F.left("raw", F.length("raw") - 1)).otherwise(F.col("raw"))
    return validate.reject_docs(model.parsed(order_text(spark, sf).withColumn("raw", cut)))


@query("doc_json", sql.with_documents(f"SELECT t._id_x, {sql.DOC_TEXT} AS json FROM t JOIN orders ON o_orderkey = t._id_x"))
def _(spark, sf):
    return writers.doc_json(order_text(spark, sf))


@query(
    "feature_collection",
    sql.with_documents(
        f"""SELECT 1 AS kind, t._id_x, CASE WHEN t._id_x = e.low THEN '' ELSE ',' END || {sql.DOC_TEXT} AS line
            FROM t JOIN orders ON o_orderkey = t._id_x, (SELECT min(_id_x) AS low FROM t WHERE species = '2-HIGH') e
            WHERE t.species = '2-HIGH'
            UNION ALL SELECT 0, NULL, '{{"type":"FeatureCollection","features":['
            UNION ALL SELECT 2, NULL, ']}}'"""
    ),
)
def _(spark, sf):
    return writers.feature_collection(match.where(stored_documents(spark, sf), {"properties.species": "2-HIGH"}))


@query("link_manifest", f"SELECT l_orderkey AS _id_x, {LINK} AS file, l_orderkey || '_' || l_linenumber || '_' || l_returnflag || '.laz' AS filename FROM lineitem")
def _(spark, sf):
    return writers.link_manifest(access.pointcloud_urls(relational(spark, sf)))


@query("url_filename", r"SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*[^?#]*/([^/?#]*)', 1) AS filename FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", scalars.url_filename(F.col("url")).alias("filename"))


@query("import_inventory_csv", sql.INVENTORY)
def _(spark, sf):
    key = F.col("c_custkey")
    number = key.cast("string")
    inventory = table(spark, sf, "customer").select(
        number.alias("OBJECTID"),
        F.col("c_name").alias("BAUM_ID"),
        F.col("c_mktsegment").alias("GATTUNG_ART"),
        F.when(key % 11 == 0, "unknown").otherwise(F.concat((key % 300).cast("string"), F.lit(" cm"))).alias("STAMMUMFANG_TXT"),
        F.when(key % 13 == 0, F.lit(None)).otherwise(F.concat((key % 9).cast("string"), F.lit("-"), (key % 9 + 2).cast("string"), F.lit("m"))).alias("KRONENDURCHMESSER_TXT"),
        F.when(key % 17 == 0, ">35m").otherwise(F.concat((key % 20).cast("string"), F.lit("-"), (key % 20 + 5).cast("string"), F.lit("m"))).alias("BAUMHOEHE_TXT"),
        F.concat(F.lit("POINT (16."), (key % 90 + 10).cast("string"), F.lit(" 48."), (key % 80 + 10).cast("string"), F.lit(")")).alias("SHAPE"),
    )
    path = scratch_path(spark, "inventory")
    inventory.write.option("header", True).csv(path)
    rows = readers.inventory_documents(readers.read_inventory(spark, path), "https://example.org/wfs", "2024-05-01", "https://example.org/meta")
    docs = model.documents(rows.where("imported"))
    return docs.select(
        "_file",
        "id",
        "species",
        "lon",
        "lat",
        F.get("measurements.DBH_cm", 0).alias("dbh"),
        F.get("measurements.height_m", 0).alias("height"),
        F.try_variant_get("doc", "$.properties.measurements[0].crown_diameter_m", "double").alias("crown"),
        F.get("measurements.date", 0).alias("date"),
    )


@query("file_fingerprint", "SELECT doc_id, sha1(text) AS sha1 FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", writers.fingerprint(F.col("text")).alias("sha1"))
