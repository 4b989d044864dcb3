from __future__ import annotations

import json
import math
import random
import re

import pytest
from conftest import SF_DIR, ids, tree
from pyspark.sql import functions as F

from arborframe.functions import geo
from arborframe.operators import filters, joins, match, stats
from arborframe.plans.catalog import circle
from arborframe.plans.views import relational

HUGE = circle(-175.0, 3.0, 64.0, 9)


def polygon(*rings, strict=False):
    shape = {"type": "Polygon", "coordinates": [list(map(list, r)) for r in rings]}
    if strict:
        shape["crs"] = {"type": "name", "properties": {"name": geo.STRICT_WINDING}}
    return shape


def box(west, south, east, north):
    return [(west, south), (east, south), (east, north), (west, north), (west, south)]


def north_of(lat, metres):
    return lat + math.degrees(metres / geo.EARTH_RADIUS_M)


def test_distance_boundary_and_order(collection):
    docs = collection(
        tree(0, lat=north_of(49.0, 151)), tree(1, lat=north_of(49.0, 149)), tree(2, lat=49.0), tree(3, lat=north_of(49.0, 20))
    )
    point = {"type": "Point", "coordinates": [8.7, 49.0]}
    near = filters.near_point(docs, json.dumps(point), 150.0)
    assert [r["_id_x"] for r in near.collect()] == [2, 3, 1]
    assert ids(filters.near_point(docs, point)) == [2]
    assert [r["_id_x"] for r in filters.nearest_k(docs, point, 2).collect()] == [2, 3]


def test_distance_over_date_line_and_pole(collection):
    docs = collection(tree(0, lon=179.9, lat=0.0), tree(1, lon=-179.9, lat=0.0), tree(2, lon=10.0, lat=89.9), tree(3, lon=-170.0, lat=89.9))
    assert ids(filters.near_point(docs, {"type": "Point", "coordinates": [180, 0]}, 20_000)) == [0, 1]
    assert ids(filters.near_point(docs, {"type": "Point", "coordinates": [-179.95, 0]}, 20_000)) == [0, 1]
    assert ids(filters.near_point(docs, {"type": "Point", "coordinates": [10, 89.95]}, 20_000)) == [2, 3]


def test_geometry_arguments(collection):
    docs = collection(tree(0))
    for bad in ("{not json", {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, {"type": "Point"}, "[]"):
        with pytest.raises(ValueError):
            filters.by_geometry(docs, bad)
    with pytest.raises(ValueError):
        filters.by_geometry(docs, polygon([(0, 0), (1, 1), (0, 1)]))
    with pytest.raises(ValueError):
        filters.by_geometry(docs, polygon([(0, 0), (180, 0), (90, 10), (0, 0)]))


def test_polygon_orientation_does_not_matter_without_crs(collection):
    docs = collection(tree(0, lon=5, lat=5), tree(1, lon=15, lat=5), tree(2, lon=-175, lat=-5))
    ring = box(0, 0, 10, 10)
    assert ids(filters.within_polygon(docs, polygon(ring))) == [0]
    assert ids(filters.within_polygon(docs, polygon(ring[::-1]))) == [0]
    assert ids(filters.within_polygon(docs, polygon(ring, strict=True))) == [0]
    assert ids(filters.within_polygon(docs, polygon(ring[::-1], strict=True))) == [1, 2]


def test_polygon_with_hole_and_long_ring(collection):
    docs = collection(tree(0, lon=5, lat=5), tree(1, lon=1, lat=1), tree(2, lon=9.5, lat=5), tree(3, lon=20, lat=5))
    assert ids(filters.within_polygon(docs, polygon(box(0, 0, 10, 10), box(4, 4, 6, 6)))) == [1, 2]
    circle = [(5 + 5 * math.cos(a), 5 + 5 * math.sin(a)) for a in (2 * math.pi * i / 200 for i in range(200))]
    assert ids(filters.within_polygon(docs, polygon(circle + circle[:1]))) == [0, 2]
    assert ids(filters.within_polygon(docs, polygon((circle[::5] + circle[:1])))) == [0, 2]


def test_edges_are_great_circles(collection):
    # the northern edge at 50 N bulges to about 51.4 N half-way along 40 degrees of longitude
    docs = collection(tree(0, lon=20, lat=51.0), tree(1, lon=20, lat=52.0), tree(2, lon=1, lat=50.5), tree(3, lon=20, lat=40.5))
    assert ids(filters.within_polygon(docs, polygon(box(0, 40, 40, 50)))) == [0]


def test_polygon_over_date_line_and_pole(collection):
    docs = collection(tree(0, lon=175, lat=0), tree(1, lon=-175, lat=0), tree(2, lon=0, lat=85), tree(3, lon=0, lat=-85))
    assert ids(filters.within_polygon(docs, polygon([(170, -5), (-170, -5), (-170, 5), (170, 5), (170, -5)]))) == [0, 1]
    cap = [(lon, 70) for lon in (-180, -120, -60, 0, 60, 120, -180)]
    assert ids(filters.within_polygon(docs, polygon(cap))) == [2]
    assert ids(filters.within_polygon(docs, polygon(cap[::-1]))) == [2]
    assert ids(filters.within_polygon(docs, polygon(cap[::-1], strict=True))) == [0, 1, 3]


def test_polygon_larger_than_a_hemisphere(collection):
    docs = collection(tree(0, lon=8.7, lat=49.0), tree(1, lon=180.0, lat=0.0))
    assert ids(filters.within_polygon(docs, polygon(HUGE, strict=True))) == [0]
    assert ids(filters.within_polygon(docs, polygon(HUGE))) == [1]


def test_viewport_is_clamped(collection):
    docs = collection(tree(0, lon=179.0, lat=89.0), tree(1, lon=-179.0, lat=0.0), tree(2, lon=100.0, lat=-90.0))
    assert ids(filters.within_viewport(docs, (90, -200, 500, 200))) == [0, 2]
    assert ids(filters.within_viewport(docs, (90, -200, 500, 200), {"properties.id": "T2"})) == [2]


def test_box_reaches_the_scan(spark, collection, tmp_path):
    path = str(tmp_path / "docs")
    collection(tree(0)).write.parquet(path)
    docs = spark.read.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    for hits in (
        filters.near_point(docs, {"type": "Point", "coordinates": [8.7, 49.0]}, 100.0),
        filters.within_polygon(docs, polygon(box(8, 48, 9, 50))),
    ):
        plan = hits.select("_id_x")._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(lat" in plan and "LessThanOrEqual(lon" in plan


def test_filters_read_only_the_leaves_they_name(spark, collection, tmp_path):
    path = str(tmp_path / "docs")
    collection(tree(0)).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    same = {"properties.data": {"$elemMatch": {"quality": {"$lte": 3}, "mode": "ALS"}}}
    plan = match.where(spark.read.parquet(path), same).select("_id_x")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<_id_x:bigint,data:struct<mode:array<string>,quality:array<double>>>" in plan
    assert "Exchange" not in plan


def test_date_ranges_reach_the_scan(spark):
    docs = relational(spark, SF_DIR)
    for by in (filters.by_date, filters.by_date_same_element):
        plan = by(docs, "properties.data.date", "1998-01-01", "1998-06-30")._jdf.queryExecution().executedPlan().toString()
        pushed = [line for line in plan.split("\n") if "PushedFilters" in line and "l_shipdate" in line]
        assert pushed and "1998-0" in pushed[0].split("PushedFilters")[1]


def test_spatial_joins_do_not_broadcast(spark, collection):
    docs = collection(*[tree(i, lon=8.7, lat=49.0) for i in range(50)])
    searches = spark.createDataFrame([(1, 8.7, 49.0, 900.0), (2, 20.0, 89.9999, 150.0)], "search_id int, lon double, lat double, radius_m double")
    found = joins.spatial_join(docs, searches, 1000.0)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.groupBy("search_id").count().collect() == [(1, 50)]


def test_spatial_join_equals_pairwise_distances(spark, collection):
    spots = [(8.70, 49.00), (8.71, 49.01), (179.99, 10.0), (-179.99, 10.0), (0.0, 89.99), (120.0, 89.98), (-60.0, -30.0)]
    docs = collection(*[tree(i, lon=lon, lat=lat) for i, (lon, lat) in enumerate(spots * 3)])
    points = [(100 + i, lon + 0.002, lat - 0.001, r) for i, ((lon, lat), r) in enumerate(zip(spots, (900.0, 5000.0) * 4))]
    searches = spark.createDataFrame(points, "search_id long, lon double, lat double, radius_m double")
    got = {(r["search_id"], r["_id_x"]) for r in joins.spatial_join(docs, searches, 5000.0).collect()}

    def metres(a, b):
        (lon, lat), (lon0, lat0) = ((math.radians(x) for x in p) for p in (a, b))
        h = math.sin((lat - lat0) / 2) ** 2 + math.cos(lat) * math.cos(lat0) * math.sin((lon - lon0) / 2) ** 2
        return 2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(h))

    want = {(s, i) for s, lon, lat, r in points for i, spot in enumerate(spots * 3) if metres(spot, (lon, lat)) <= r}
    assert got == want and want
    with pytest.raises(Exception, match="max_distance"):
        joins.spatial_join(docs, searches, 100.0).collect()


def test_polygon_join_equals_single_searches(spark, collection):
    spots = [(lon, lat) for lon in (-179.5, -100.2, -1.0, 0.5, 20.0, 178.5) for lat in (-61.0, -10.5, 0.5, 49.8, 51.0)]
    docs = collection(*[tree(i, lon=lon, lat=lat) for i, (lon, lat) in enumerate(spots)])
    rings = [box(-2, -20, 2, 20), box(0, 40, 40, 50), box(170, -70, 190, 60), box(-190, -70, -175, 1)[::-1], box(-101, -62, 21, -60)]
    rings = [[list(map(float, p)) for p in r] for r in rings]
    searches = spark.createDataFrame(list(enumerate(rings)), "search_id int, ring array<array<double>>")
    got = {(r["search_id"], r["_id_x"]) for r in joins.spatial_join_polygons(docs, searches, 5.0).collect()}
    want = {(i, found) for i, r in enumerate(rings) for found in ids(filters.within_polygon(docs, polygon(r)))}
    assert got == want and {i for i, _ in want} == set(range(5))
    cap = [[float(lon), 70.0] for lon in (-180, -120, -60, 0, 60, 120, -180)]
    for bad in (cap, rings[0][:-1]):
        with pytest.raises(Exception, match="search ring"):
            joins.spatial_join_polygons(docs, spark.createDataFrame([(0, bad)], searches.schema)).collect()


def test_polygon_cover_follows_each_search(spark, collection):
    """One search of 20 degrees among twenty of 0.01: cells by each one's own size, whole ones without edges."""
    small = [box(x / 10, 50.0, x / 10 + 0.01, 50.01) for x in range(20)]
    star = [(10.0, 10.0), (14.0, 20.0), (10.0, 30.0), (20.0, 26.0), (30.0, 30.0), (26.0, 20.0), (30.0, 10.0), (20.0, 14.0), (10.0, 10.0)]
    wide = [box(0, 0, 20, 20), star, box(170, -70, 190, 60), box(-60, -89.5, 60, -80)]
    rings = [[list(map(float, p)) for p in r] for r in small + wide]
    searches = spark.createDataFrame(list(enumerate(rings)), "search_id int, ring array<array<double>>")
    cover = joins.ring_cover(searches).groupBy("search_id").agg(F.count("*").alias("n"), F.count_if("_whole").alias("whole"), F.min("_level").alias("level")).collect()
    assert max(r["n"] for r in cover) <= 150 and {r["level"] for r in cover if r["search_id"] < 20} == {16}
    by = {r["search_id"]: r for r in cover}
    assert by[20]["whole"] > 20 and by[20]["level"] == 6 and by[21]["whole"] >= 8
    spots = [(lon / 2 + 0.013, lat / 2 + 0.017) for lon in range(-10, 80) for lat in range(-4, 70)] + [(x / 10 + 0.005, 50.005) for x in range(20)] + [(179.9, -69.0), (-179.9, 59.0), (0.3, -85.0), (59.0, -81.0), (61.0, -81.0)]
    docs = collection(*[tree(i, lon=lon, lat=lat) for i, (lon, lat) in enumerate(spots)])
    joined = joins.spatial_join_polygons(docs, searches)
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    got = {(r["search_id"], r["_id_x"]) for r in joined.collect()}
    places = docs.select("_id_x", "lon", "lat").cache()
    want = {(i, found) for i, r in enumerate(rings) for found in ids(filters.within_polygon(places, polygon(r)))}
    assert got == want and {i for i, _ in want} == set(range(len(rings)))
    assert joins.spatial_join_polygons(docs, searches.limit(0)).count() == 0


def test_map_clusters(collection):
    docs = collection(*[tree(i, lon=8.7, lat=49.0) for i in range(100)], tree(100, lon=-120.0, lat=-90.0), tree(101, lon=180.0, lat=90.0))
    rows = stats.map_clusters(docs, [0, 3]).collect()
    assert sorted(r["n"] for r in rows if r["zoom"] == 3) == [1, 1, 100]
    assert {r["size"] for r in rows if r["n"] >= 100} == {"medium"}
    assert sum(r["n"] for r in rows if r["zoom"] == 0) == 102
    place = next(r for r in rows if r["zoom"] == 3 and r["n"] == 100)
    assert place["lon"] == pytest.approx(8.7) and place["lat"] == pytest.approx(49.0)


def test_map_clusters_of_a_view_and_levels(spark, collection):
    spots = [(8.7 + (i % 17) / 50, 49.0 + (i % 13) / 90) for i in range(90)] + [(-60.0, -30.0), (170.0, 60.0)]
    docs = collection(*[tree(i, lon=lon, lat=lat) for i, (lon, lat) in enumerate(spots)]).select("_id_x", "lon", "lat").cache()

    def plain(zooms, inside):
        out = {}
        for lon, lat in filter(inside, spots):
            s = math.sin(math.radians(lat))
            x, y = lon / 360 + 0.5, 0.5 - 0.25 * math.log((1 + s) / (1 - s)) / math.pi
            for z in zooms:
                key = z, math.floor(x * 2**z * 256 / 60), math.floor(y * 2**z * 256 / 60)
                n, a, b = out.get(key, (0, 0.0, 0.0))
                out[key] = n + 1, a + lon, b + lat
        return {k: (n, round(a / n, 9), round(b / n, 9)) for k, (n, a, b) in out.items()}

    def found(frame):
        return {(r["zoom"], r["gx"], r["gy"]): (r["n"], round(r["lon"], 9), round(r["lat"], 9)) for r in frame.collect()}

    assert found(stats.map_clusters(docs)) == plain(range(19), lambda p: True)
    view = (8.75, 48.0, 9.0, 49.1)
    inside = lambda p: view[0] <= p[0] <= view[2] and view[1] <= p[1] <= view[3]
    assert found(stats.map_clusters(docs, [12, 3, 3, 7], view)) == plain([12, 7, 3], inside)
    assert found(stats.map_clusters(docs, [9], view)) == plain([9], inside)
    clusters = stats.map_clusters(docs)
    clusters.collect()
    copies = [int(n) for n in re.findall(r"explode\(\[([^\]]*)\]", clusters._jdf.queryExecution().optimizedPlan().toString()) for n in [len(n.split(","))]]
    assert copies and max(copies) <= stats.LEVELS_AT_ONCE


def test_distance_column_accepts_columns(spark):
    row = spark.range(1).select(geo.distance_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d")).first()
    assert row["d"] == pytest.approx(math.radians(1) * geo.EARTH_RADIUS_M)


def test_polygon_join_of_wound_rings(spark, collection):
    """Rings of 4 to 300 sides, some with many sides in one cell, long and narrow, over the date line and at 180 degrees."""
    rng = random.Random(5)

    def star(lon, lat, size, n, least=0.2):
        turns = [((i + rng.random() * 0.9) / n * 2 * math.pi, size * rng.uniform(least, 1)) for i in range(n)]
        ring = [[lon + r * math.cos(t), lat + r * math.sin(t)] for t, r in turns]
        return [*ring, ring[0]]

    comb = [[x / 10 + d, 20.0 + 8 * up] for x in range(60) for d, up in ((0.0, x % 2), (0.05, x % 2))] + [[6.0, 19.0], [0.0, 19.0], [0.0, 20.0]]
    rings = [star(10, 10, 9, 300), star(179, -20, 8, 40), star(-100, 60, 20, 9), comb]
    rings += [[list(map(float, p)) for p in box(*b)] for b in ((-60, 30, 20, 30.4), (40, -50, 40.3, 50), (170, -5, 180, 5), (-180, -5, -170, 5), (-9.3, 48, 9.2, 51.6))]
    spots = [(rng.uniform(w, e), rng.uniform(s, n)) for w, s, e, n in ((0, 0, 20, 20), (171, -29, 180, -11), (-180, -29, -172, -11), (-125, 38, -78, 82), (0, 19, 6, 28), (-60, 29, 20, 33), (39.9, -50, 40.4, 50), (-10, 47, 10, 53)) for _ in range(150)]
    spots += [(float(lon), float(lat)) for lon in (-180, -175, -170, 170, 175, 180) for lat in (-5, 0, 5)]
    docs = collection(*[tree(i, lon=lon, lat=lat) for i, (lon, lat) in enumerate(spots)]).select("_id_x", "lon", "lat").cache()
    searches = spark.createDataFrame(list(enumerate(rings)), "search_id int, ring array<array<double>>")
    cover = joins.ring_cover(searches).where("NOT _whole").agg(F.min(F.size("_edges")), F.max(F.size("_edges"))).first()
    assert cover[0] >= 1 and cover[1] > joins._PLAIN_EDGES
    got = [(r["search_id"], r["_id_x"]) for r in joins.spatial_join_polygons(docs, searches).collect()]
    want = {(i, found) for i, r in enumerate(rings) for found in ids(docs.where(geo.Ring(r, False).contains(F.col("lon"), F.col("lat"))))}
    assert set(got) == want and len(got) == len(want) and {i for i, _ in want} == set(range(len(rings)))


def test_polygon_join_is_compiled(spark):
    """Interpreted lambdas for each pair took longer than all else; rings of few sides need none."""
    searches = spark.createDataFrame([(i, [list(map(float, p)) for p in box(i, 0, i + 5, 3)]) for i in range(40)], "search_id int, ring array<array<double>>")
    joined = joins.spatial_join_polygons(spark.createDataFrame([(0, 8.7, 1.0)], "_id_x long, lon double, lat double"), searches)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "lambda" not in plan
    assert sorted(r["search_id"] for r in joined.collect()) == [4, 5, 6, 7, 8]


def test_searches_are_covered_by_many_tasks(spark):
    """Searches of one small file, which by its bytes would be one task."""
    rings = [(i, [list(map(float, p)) for p in box(i, 0, i + 5, 3)]) for i in range(60)]
    searches = spark.createDataFrame(rings, "search_id int, ring array<array<double>>").coalesce(1)
    joined = joins.spatial_join_polygons(spark.createDataFrame([(0, 8.7, 1.0)], "_id_x long, lon double, lat double"), searches)
    assert len(joined.inputFiles()) > 1  # those of the stored cover
