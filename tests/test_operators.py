from __future__ import annotations

import json
import re

import numpy as np
import pytest
from conftest import ids, tree, without
from pyspark.sql import functions as F

from arborframe.operators import access, joins, match, nodes, positions, stats, views
from arborframe.store import TreeStore

M, D = "properties.measurements", "properties.data"


# ---------------------------------------------------------------- access
@pytest.fixture
def ten(collection):
    return collection(*[tree(i) for i in range(10)])


def order(frame):
    return [r["_id_x"] for r in frame.collect()]


def test_positions(ten):
    assert ids(access.get_item(ten, 3)) == [3]
    assert ids(access.get_item(ten, -1)) == [9]
    for bad in (10, -11):
        with pytest.raises(IndexError):
            access.get_item(ten, bad)
        with pytest.raises(IndexError):
            access.get_items(ten, [0, bad])
    assert order(access.get_items(ten, [5, 2, 5, -1])) == [5, 2, 5, 9]
    assert order(access.get_items(ten, np.array([1, 0]))) == [1, 0]


@pytest.mark.parametrize("part", [slice(2, 5), slice(None, None, 3), slice(-3, None), slice(8, 1, -3), slice(None, None, -1), slice(5, 2), slice(0, 99)])
def test_slices(ten, part):
    assert order(access.slice_items(ten, part.start, part.stop, part.step)) == list(range(10))[part]


def test_paging(ten):
    assert order(access.limit_skip(ten, 3, 4)) == [3, 4, 5, 6]
    assert order(access.limit_skip(ten, 8)) == [8, 9]
    assert order(access.limit_skip(ten)) == list(range(10))
    assert order(access.limit_skip(ten.where("_id_x % 2 = 1"), 1, 3)) == [3, 5, 7]
    page, total, markers = access.page_results(ten, {}, 3, 3)
    assert (order(page), total.first()["n"], markers.count()) == ([9], 10, 10)


def test_positions_count_rows_not_ids(collection):
    docs = collection(*[tree(i) for i in range(6)])
    moved = docs.withColumn("_id_x", F.col("_id_x") * 70_000 + 40)
    assert ids(access.get_item(moved, 0)) == [40] and ids(access.get_item(moved, -1)) == [350_040]
    assert order(access.slice_items(moved, 1, 4)) == [70_040, 140_040, 210_040]
    twice = docs.where("_id_x < 3").unionByName(docs)
    assert order(access.limit_skip(twice, 1, 3)) == [0, 1, 1]
    assert order(access.limit_skip(twice, 5)) == [2, 3, 4, 5]
    assert order(access.get_items(twice, [1, 0, 4, 8])) == [0, 0, 2, 5]
    assert ids(access.limit_skip(docs.where("_id_x < 0"), 0, 3)) == []


def shuffles(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"(?m)^[^\w]*Exchange ", plan))


@pytest.mark.parametrize("ranked", [2, 1 << 13])
def test_positions_at_all_depths(spark, monkeypatch, ranked):
    """Dense, sparse, negative and repeated ids, with ranges of few rows, against a plain list."""
    monkeypatch.setattr(positions, "RANKED", ranked)
    monkeypatch.setattr(positions, "SPLIT_BITS", 2)
    monkeypatch.setattr(positions, "STEP_BITS", 4)
    given = {
        "dense": list(range(60)),
        "sparse": [i * i * 977 for i in range(50)] + [10**15],
        "negative": [-(2**63), -5, -4, 0, 1, 2**63 - 1],
        "repeated": sorted([3] * 9 + [4] + [70_000] * 5 + list(range(100, 110))),
        "single": [8] * 6,
    }
    for name, numbers in given.items():
        rows = [(n, f"{at:03d}") for at, n in enumerate(numbers)]
        table = spark.createDataFrame([*rows[::-1], (None, "none")], "_id_x long, note string").repartition(3).cache()
        size = len(rows)
        picked = [0, size - 1, size // 2, -1, 1, size // 2]
        assert [(r["pos"], r["note"]) for r in access.get_items(table, picked).collect()] == [(p, rows[i][1]) for p, i in enumerate(picked)], name
        assert access.get_item(table, size - 2).first()["note"] == rows[-2][1]
        for skip, limit in ((size // 3, 4), (size - 2, 9), (2, None), (1, size - 2), (size, 2), (0, None)):
            page = access.limit_skip(table, skip, limit)
            assert [r["note"] for r in page.collect()] == [n for _, n in rows[skip:][: size if limit is None else limit]], (name, skip, limit)
        for part in (slice(1, -1), slice(None, None, 3), slice(-2, 1, -4)):
            assert [r["note"] for r in access.slice_items(table, part.start, part.stop, part.step).collect()] == [n for _, n in rows[part]], (name, part)
    nobody = spark.createDataFrame([(None, "x")], "_id_x long, note string")
    assert access.limit_skip(nobody, 0, 5).count() == access.slice_items(nobody).count() == access.get_items(nobody, []).count() == 0
    with pytest.raises(IndexError):
        access.get_item(nobody, 0)


def test_positions_read_only_their_ranges(spark, tmp_path):
    spark.range(200_000).select(F.col("id").alias("_id_x"), F.lit("x").alias("note")).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    for frame, most in ((access.get_item(table, 150_000), 1), (access.get_items(table, [150_000, 3, -1]), 2), (access.limit_skip(table, 123_456, 20), 2), (access.slice_items(table, 100, 900, 7), 2)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert shuffles(frame) <= most, plan
        assert "GreaterThanOrEqual(_id_x" in plan, plan
    page = access.limit_skip(table, 123_456, 20)
    assert order(page) == list(range(123_456, 123_476))
    scanned = page._jdf.queryExecution().executedPlan().toString()
    assert "_id_x#" in scanned and "Or(" not in scanned  # one range, of some thousand ids


def test_store_query_sorts(spark, collection):
    docs = collection(tree(0, species="c", lon=8.9), tree(1, species="a", lon=8.8), tree(2, species="b", lon=8.7))
    trees = TreeStore(spark, docs)
    near = {"geometry": {"$nearSphere": {"$geometry": {"type": "Point", "coordinates": [8.7, 49.0]}, "$maxDistance": 1e6}}}
    assert order(trees.query(near, limit=1)) == [2]
    assert order(trees.query(near, skip=1)) == [1, 0]
    assert order(trees.query({}, sort=[("properties.species", 1)], limit=2)) == [1, 2]
    assert order(trees.query({}, sort="properties.species")) == [1, 2, 0]
    assert order(trees.query({}, sort=[("properties.source", 1), ("properties.species", -1)])) == [0, 2, 1]


def test_projections(collection):
    docs = collection(tree(0, data=[{"mode": "TLS"}, {}]), without(tree(1), "properties", "data"), tree(2, note=None))
    kept = access.project_include(docs, ["_id_x", "type", f"{D}.mode", "properties.note"])
    rows = {r["_id_x"]: json.loads(str(r["doc"].toJson())) for r in kept.collect()}
    assert rows == {
        0: {"type": "Feature", "properties": {"data": [{"mode": "TLS"}, {"mode": "ALS"}]}},
        1: {"type": "Feature", "properties": {}},
        2: {"type": "Feature", "properties": {"data": [{"mode": "ALS"}], "note": None}},
    }
    cut = access.project_exclude(docs, ["_id", "_file", "geometry", M, f"{D}.file", "properties.nope"])
    assert cut.columns == ["_id_x", "_date", "doc"]
    rows = {r["_id_x"]: json.loads(str(r["doc"].toJson())) for r in cut.collect()}
    want = without(without(tree(2, note=None), "geometry"), "properties", "measurements")
    del want["properties"]["data"][0]["file"]
    assert rows[2] == want
    assert "data" not in rows[1]["properties"]


def test_links(collection):
    docs = collection(tree(0, data=[{"file": "a"}, {"file": "b"}]), without(tree(1), "properties", "data", 0, "file"), tree(2, data=[]))
    links = access.pointcloud_urls(docs)
    assert [(r["_id_x"], r["pos"], r["file"]) for r in links.orderBy("_id_x", "pos").collect()] == [(0, 0, "a"), (0, 1, "b")]
    assert access.pointcloud_urls(docs, docs.where("_id_x = 1")).count() == 0


# ---------------------------------------------------------------- joins
def test_pairs_inside_a_tree(collection):
    docs = collection(
        tree(
            0,
            data=[{"mode": "ULS", "quality": 1}, {"mode": "ULS", "quality": 5}, {"mode": "TLS"}],
            measurements=[{"source": "ULS", "height_m": 5}, {"source": "ULS"}, {"source": "FI", "height_m": 4}, {"source": "ULS", "height_m": 2000}],
        ),
        tree(1, data=[{"mode": "ULS"}], measurements=[{"source": "FI"}]),
    )
    merged = joins.merge_data_measurements(
        docs, {"mode": "ULS"}, {"source": "ULS", "$or": [{"height_m": {"$gte": 0, "$lte": 999}}, {"height_m": None}]}
    )
    got = sorted((r["_id_x"], r["quality"], r["height_m"] or -1.0) for r in merged.collect())
    assert got == [(0, 1.0, -1.0), (0, 1.0, 5.0), (0, 5.0, -1.0), (0, 5.0, 5.0)]
    assert not {"crs", "position_xyz"} & set(merged.columns)
    assert merged.first()["date"] == "2019-06-04"  # the measurement's date, not the scan's
    pairs = joins.pair_sources(docs, {"source": "ULS"}, "height_m", {"source": "FI"}, "height_m")
    assert sorted((r["left_value"] or -1.0, r["right_value"]) for r in pairs.collect()) == [(-1.0, 4.0), (5.0, 4.0), (2000.0, 4.0)]


def test_id_joins(ten):
    low, high = ten.where("_id_x < 6"), ten.where("_id_x > 3")
    assert ids(joins.semi_join_ids(ten, low.where("_id_x < 0"))) == []
    assert ids(joins.intersect_results(low, high, ten)) == [4, 5]
    assert ids(joins.union_results(low, high)) == list(range(10))
    assert joins.union_append(low, high).count() == 12


# ---------------------------------------------------------------- statistics
def test_statistics(collection):
    docs = collection(tree(0, species="A"), tree(1, species="B", extra=1), without(tree(2), "properties", "species"))
    assert stats.stats(docs).first().asDict() == {"n_trees": 3, "n_species": 2}
    assert sorted(r["species"] for r in stats.list_species(docs).collect()) == ["A", "B"]
    shared = [r["key"] for r in stats.shared_properties(docs).collect()]
    assert shared == ["data", "id", "measurements", "source"]
    assert stats.shared_properties(docs.where("_id_x < 0")).collect() == []
    assert stats.shared_properties(collection(tree(0), {"type": "Feature"}["type"])).collect() == []
    values = stats.distinct_any_path(docs, "geometry.coordinates").collect()
    assert sorted(r["value"] for r in values if not r["value"].startswith("[")) == ["1.5", "49", "8.7"]
    assert [r["value"] for r in stats.distinct_any_path(docs, f"{D}.mode").collect()] == ["ALS"]


def test_counts_per_filter(collection):
    docs = collection(tree(0, data=[{"mode": "ULS"}, {"mode": "TLS"}]), tree(1, data=[{"mode": "TLS"}]))
    groups = {"TLS": {f"{D}.mode": "TLS"}, "ULS": {f"{D}.mode": "ULS"}, "none": {f"{D}.mode": "MLS"}}
    assert {r["name"]: r["n"] for r in stats.count_by(docs, groups).collect()} == {"TLS": 2, "ULS": 1, "none": 0}


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.5, 9.0, 11.0, None], [3.0, 3.0], [0.1 * i for i in range(300)]])
def test_histogram(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["bin"]: r["n"] for r in stats.histogram(rows, "v", 50).collect()}
    given = np.array([v for v in values if v is not None])
    want, _ = np.histogram(given, 50)
    assert sum(got.values()) == len(given)
    if len(values) < 100:
        assert got == {i: n for i, n in enumerate(want) if n}
    else:  # values on bin edges may fall to either side by rounding
        assert sum(abs(got.get(i, 0) - n) for i, n in enumerate(want)) <= 10


def test_crown_height(collection):
    uls = {"source": "ULS", "canopy_condition": "leaf-on"}
    docs = collection(
        tree(0, measurements=[{**uls, "height_m": 10, "mean_crown_diameter_m": 4}, {**uls, "height_m": 30}]),
        tree(1, measurements=[{**uls, "height_m": 20, "mean_crown_diameter_m": 6}]),
        tree(2, species="B", measurements=[{**uls, "height_m": None, "mean_crown_diameter_m": 1}]),
    )
    points, summary = stats.species_crown_height(docs)
    assert points.count() == 3
    rows = {r["species"]: r for r in summary.collect()}
    assert (rows["Abies alba"]["n"], rows["Abies alba"]["avg_height_m"], rows["Abies alba"]["max_crown_m"]) == (2, 15.0, 6.0)
    assert rows["B"]["avg_height_m"] is None


# ---------------------------------------------------------------- views
def test_general_view(collection):
    plain = collection(tree(0))
    assert views.tree_general(plain).columns == ["tree_id", "species", "lat_epsg4326", "long_epsg4326", "elev_epsg4326"]
    two = tree(1)
    two["properties"]["measurements"] += [{"crs": "a", "position_xyz": [1, 2, 3]}, {"position_xyz": [4.5, 5, 6]}]
    rows = {r["tree_id"]: r for r in views.tree_general(collection(tree(0), two)).collect()}
    assert tuple(rows["T1"])[2:] == (49.0, 8.7, 1.5, 4.5, 5.0, 6.0, None)
    assert rows["T0"]["x"] is None


def test_metrics_view(collection):
    one = tree(0, measurements=[{"height_m": None, "note": "a,b", "DBH_cm": 14}, {"odd": [1, 2]}])
    one["properties"]["measurements"].append({"crs": "x", "position_xyz": [1, 2, 3]})
    table = views.tree_metrics(collection(one))
    assert table.columns == ["tree_id", "DBH_cm", "date", "height_m", "note", "odd", "source"]
    assert {tuple(r) for r in table.collect()} == {
        ("T0", "14", "2019-06-04", None, "a,b", None, "FI"),
        ("T0", None, "2019-06-04", None, None, "[1,2]", "FI"),
    }
    crs_only = tree(1, measurements=[{"crs": "kept"}])
    assert "crs" in views.tree_metrics(collection(crs_only)).columns


# ---------------------------------------------------------------- nodes
@pytest.fixture
def texts(spark):
    def build(*documents):
        return spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "_id_x long, raw string")

    return build


def test_leaves(texts):
    docs = texts({"a_b": 1, "a": {"b": None, "c": [], "d": {}}, "e": [True, {"f": "x"}, [2.5]]})
    rows = nodes.flatten_docs(docs).collect()
    assert [(r["path"], r["exact_path"], r["value"], r["type"]) for r in rows] == [
        ("a_b", "$.a_b", "1", "number"),
        ("a_b", "$.a.b", None, "null"),
        ("e_0", "$.e[0]", "true", "boolean"),
        ("e_1_f", "$.e[1].f", "x", "string"),
        ("e_2_0", "$.e[2][0]", "2.5", "number"),
    ]


def test_values_under_a_key(texts):
    docs = texts({"k": {"k": 1}, "x": [[{"k": 2}]], "y": [{"k": 3}], "k2": [{"z": {"k": "end"}}]})
    got = [r["value"] for r in nodes.extract_key(docs, "k").orderBy("ord").collect()]
    assert got == ['{"k": 1}', "1", "3", "end"]


def test_conditions_on_values(texts):
    docs = texts(
        {"v": "Quercus", "a": {"v": None}, "b": [{"v": 12}, {"v": "12"}, {"v": True}, {"v": "n/a"}]},
        {"v": "2019-1-1", "a": {"v": "2019-02-30"}, "b": [{"v": "2020-03-04-x"}, {"v": "2020-01-01T00"}, {"v": "0000-01-01"}]},
    )

    def got(frame):
        return sorted(r["value"] for r in frame.collect())

    assert got(nodes.extract_key_regex(docs, "v", "querc")) == ["Quercus"]
    assert got(nodes.extract_key_exact(docs, "v", "12")) == ["12"]
    assert nodes.extract_key_exact(docs, "v", 12.0).first()["type"] == "number"
    assert nodes.extract_key_exact(docs, "v", True).count() == 1
    assert nodes.extract_key_exact(docs, "v", None).count() == 1
    assert got(nodes.extract_key_numeric(docs, "v", "ge", 12)) == ["12", "12"]
    assert got(nodes.extract_key_numeric(docs, "v", "ne", 12)) == []
    assert got(nodes.extract_key_date(docs, "v", "le", "2019-06-01")) == ["2019-1-1"]
    assert got(nodes.extract_key_date(docs, "v", "ne", "2019-01-01")) == ["2020-03-04-x"]
    with pytest.raises(ValueError):
        nodes.extract_key_numeric(docs, "v", "like", 1)


def test_only_texts_that_may_hold_the_key_are_walked(spark):
    texts = ['{"k": 1}', '{"\\u006b": 2}', '{"a": "k"}', '{"a": {"k": null}}', '{"b/c": 3}', '{"b\\/c": 4}', '{"q\\"r": 5}', '{"ü": 6}', '{"\\u00fc": 7}', "k", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "_id_x long, raw string")
    for name, expected in (("k", [(0, "1"), (1, "2"), (3, None)]), ("b/c", [(4, "3"), (5, "4")]), ('q"r', [(6, "5")]), ("ü", [(7, "6"), (8, "7")])):
        assert sorted((r["_id_x"], r["value"]) for r in nodes.extract_key(docs, name).collect()) == expected
    plan = nodes.extract_key(docs, "k")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"MapInArrow.*\n.*(Filter|Project).*", plan) and "Contains" in plan


def test_projections_keep_values_as_stored(spark, collection):
    raw = {"type": "Feature", "properties": {"id": "T", "a": [{"x": 12.50, "y": 1}, {"y": 2}, 5, None], "n": None, "big": 12345678901234567890, "e": 1e-7, "s": "1"}}
    docs = collection(raw)
    kept = access.project_include(docs, ["_id_x", "properties.a.x", "properties.n", "properties.big", "properties.e", "properties.gone"])
    text = kept.select(F.to_json("doc").alias("t"), F.expr("schema_of_variant(doc:properties.big)").alias("kind")).first()
    assert json.loads(text["t"]) == {"properties": {"a": [{"x": 12.5}, {}, None, None], "n": None, "big": 12345678901234567890, "e": 1e-7}}
    assert text["kind"].startswith("DECIMAL")
    rest = access.project_exclude(docs, ["properties.a.x", "properties.id"])
    assert json.loads(rest.select(F.to_json("doc").alias("t")).first()["t"]) == {
        "type": "Feature",
        "properties": {"a": [{"y": 1}, {"y": 2}, 5, None], "n": None, "big": 12345678901234567890, "e": 1e-7, "s": "1"},
    }
    stored = docs.select("_id_x", "_file", "_date", "doc").cache()
    for frame in (access.project_include(stored, ["properties.a.x"]), access.project_exclude(stored, ["properties.a.x"])):
        assert "parse_json" not in frame._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]


def test_key_questions_do_not_read_the_document(spark, collection, tmp_path):
    raw = [tree(0, extra=1, **{"ü": None}), tree(1, measurements=[{}, {"position_xyz": [1, 2, 3], "crs": "c"}, {"position_xyz": [4, 5, 6]}]), {"properties": [{"id": 1, "extra": 2}, 5]}, {"properties": 3}, {}]
    raw += [{"properties": {'q"id"': 1, "a\\b": 2, "0": 3, "x/y": 4}}]
    collection(*raw).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))

    def read(frame):
        return " ".join(re.findall(r"ReadSchema: (.*)", frame._jdf.queryExecution().executedPlan().toString()))

    for name, rows in {"extra": [0, 2], "id": [0, 1, 2], "ü": [0], "a\\b": [5], "0": [2, 5], "x/y": [5], "gone": []}.items():
        assert ids(match.where(docs, {f"properties.{name}": {"$exists": True}})) == rows, name
        assert ids(match.where(docs, {f"properties.{name}": {"$exists": False}})) == [i for i in range(6) if i not in rows]
    assert "doc" not in read(match.where(docs, {"properties.extra": {"$exists": True}}).select("_id_x"))
    general = views.tree_general(docs)
    assert {r["tree_id"]: (r["x"], r["y"], r["z"], r["xyz_crs"]) for r in general.collect() if r["tree_id"]} == {"T0": (None,) * 4, "T1": (4.0, 5.0, 6.0, None)}
    assert "doc" not in read(general) and "doc" not in read(stats.shared_properties(docs))
    assert [r["key"] for r in stats.shared_properties(docs.where("_id_x in (0, 1)")).collect()] == ["data", "id", "measurements", "source", "species"]
    assert stats.shared_properties(docs.where("_id_x in (0, 2)")).collect() == []
