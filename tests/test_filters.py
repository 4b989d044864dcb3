"""Match semantics on hand-written documents, and against a brute-force matcher."""

from __future__ import annotations

import json
import random
import re

import pytest
from conftest import ids, tree, without
from pyspark.sql import functions as F

from arborframe import model
from arborframe.model import NUMBER, TEXT, ElementField, RelationalDocs
from arborframe.operators import filters, match

M, D = "properties.measurements", "properties.data"


def found(docs, query):
    return ids(match.where(docs, query))


def test_any_element_against_same_element(collection):
    docs = collection(
        tree(0, data=[{"quality": 2, "mode": "ALS"}, {"quality": 5, "mode": "TLS"}]), tree(1, data=[{"quality": 1, "mode": "TLS"}])
    )
    both = [{f"{D}.quality": {"$lte": 2}}, {f"{D}.mode": "TLS"}]
    assert found(docs, {"$and": both}) == [0, 1]
    assert found(docs, {f"{D}.quality": {"$lte": 2}, f"{D}.mode": "TLS"}) == [0, 1]
    assert found(docs, {D: {"$elemMatch": {"quality": {"$lte": 2}, "mode": "TLS"}}}) == [1]
    assert found(docs, {D: {"$elemMatch": {"$and": [{"quality": {"$lte": 2}}, {"mode": "TLS"}]}}}) == [1]


def test_operators_on_one_path_are_independent(collection):
    docs = collection(tree(0, measurements=[{"DBH_cm": 0.5}, {"DBH_cm": 20}]), tree(1, measurements=[{"DBH_cm": 20}]))
    assert found(docs, {f"{M}.DBH_cm": {"$gt": 1, "$lt": 14}}) == [0]
    assert found(docs, {M: {"$elemMatch": {"DBH_cm": {"$gt": 1, "$lt": 14}}}}) == []


def test_null_missing_and_other_types(collection):
    docs = collection(
        tree(0, measurements=[{"height_m": None}]),
        tree(1, measurements=[{}]),
        tree(2, measurements=[{"height_m": "12"}]),
        tree(3, measurements=[{"height_m": 12}]),
    )
    path = f"{M}.height_m"
    assert found(docs, {path: {"$exists": True}}) == [0, 2, 3]
    assert found(docs, {path: {"$exists": False}}) == [1]
    assert found(docs, {path: {"$lt": 30}}) == [3]
    assert found(docs, {path: {"$lt": "30"}}) == [2]
    assert found(docs, {path: "12"}) == [2]
    assert found(docs, {path: 12}) == [3]
    assert found(docs, {path: {"$ne": 12}}) == [0, 1, 2]
    assert found(docs, {path: {"$nin": [12, "12"]}}) == [0, 1]
    assert found(docs, {"$nor": [{path: {"$gt": 0}}]}) == [0, 1, 2]
    assert found(docs, {path: {"$not": {"$gt": 0}}}) == [0, 1, 2]
    assert found(docs, {path: None}) == [0, 1]
    assert found(docs, {path: {"$in": [None, 12]}}) == [0, 1, 3]
    assert found(docs, {M: {"$elemMatch": {"height_m": "12"}}}) == [2]
    assert found(docs, {M: {"$elemMatch": {"height_m": {"$exists": True}, "source": "FI"}}}) == [0, 2, 3]
    assert found(docs, {M: {"$elemMatch": {"height_m": None}}}) == [0, 1]


def test_null_in_some_element(collection):
    docs = collection(
        tree(0, measurements=[{"height_m": 3}, {}], extra=[{"a": 1}, {"b": 2}]),
        tree(1, measurements=[{"height_m": 3}], extra=[{"a": 1}, 5]),
        tree(2, measurements=[{"height_m": 3}, {"height_m": None}], extra=[{"a": None}]),
    )
    path = f"{M}.height_m"
    assert found(docs, {path: None}) == [0, 2]
    assert found(docs, {path: {"$ne": None}}) == [1]
    assert found(docs, {path: {"$in": [None]}}) == [0, 2]
    assert found(docs, {"properties.extra.a": None}) == [0, 2]


def test_operators_on_bare_members(collection):
    docs = collection(tree(0, tags=[1, 7, "x"]), tree(1, tags=[3, 9]), tree(2, tags=[]), tree(3, lon=50.0))
    tags = "properties.tags"
    assert found(docs, {tags: {"$elemMatch": {"$gt": 3, "$lt": 8}}}) == [0]
    assert found(docs, {tags: {"$gt": 3, "$lt": 8}}) == [0, 1]
    assert found(docs, {"geometry.coordinates": {"$elemMatch": {"$gt": 49.5}}}) == [3]
    assert found(docs, {M: {"$elemMatch": {"$gt": 0}}}) == []
    assert found(docs, {tags: {"$all": [1, "x"]}}) == [0]
    assert found(docs, {tags: {"$all": []}}) == []
    assert found(docs, {tags: {"$size": 2}}) == [1]
    assert found(docs, {tags: {"$size": 0}}) == [2]
    assert found(docs, {D: {"$size": 1}}) == [0, 1, 2, 3]
    assert found(docs, {tags: {"$mod": [3, 0]}}) == [1]


def test_paths_outside_the_typed_columns(collection):
    docs = collection(
        tree(0, extra={"owner": {"name": "A"}, "tags": ["x", "y"]}, measurements=[{"position_xyz": [1, 2, 3]}]),
        tree(1, extra={"owner": [{"name": "A"}, {"name": "B"}]}, flag=True),
        without(tree(2), "properties", "data"),
    )
    assert found(docs, {"properties.extra.owner.name": "A"}) == [0, 1]
    assert found(docs, {"properties.extra.tags": "y"}) == [0]
    assert found(docs, {f"{M}.position_xyz": {"$gt": 2}}) == [0]
    assert found(docs, {"properties.extra.owner.1.name": "B"}) == [1]
    assert found(docs, {"properties.flag": True}) == [1]
    assert found(docs, {"properties.extra": {"$exists": True}}) == [0, 1]
    assert found(docs, {D: {"$exists": False}}) == [2]
    assert found(docs, {f"{D}.mode": {"$ne": "ALS"}}) == [2]
    assert found(docs, {"properties.extra.owner": {"$elemMatch": {"name": "B"}}}) == [1]
    assert found(docs, {"properties.id": {"$in": ["T1", 5]}}) == [1]
    assert found(docs, {"_id_x": {"$gte": 1}, "_file": {"$regex": "1"}}) == [1]


def test_regex_is_unanchored_and_case_sensitive(collection):
    docs = collection(*[tree(i, species=s) for i, s in enumerate(["Quercus robur", "Quercu", "quercus", "Abies alba"])])
    assert ids(filters.by_species(docs, "Quercus*")) == [0, 1]
    assert ids(filters.by_species(docs, "[Aa]bies+")) == [3]
    assert found(docs, {"properties.species": {"$regex": "QUERCUS", "$options": "i"}}) == [0, 2]
    assert ids(filters.by_key_value(docs, "properties.species", "Quercu", regex=False)) == [1]
    assert ids(filters.by_key_exists(docs, f"{M}.nope")) == []


def test_bad_filters_raise(collection):
    docs = collection(tree(0))
    for bad in (
        {"$what": 1},
        {"a": {"$what": 1}},
        {"$and": []},
        {"a": {"b": 1, "$gt": 2}},
        {"a": {"$in": 3}},
        {"a": {"$type": "decimal"}},
        {"a": {"$type": []}},
        {"a": {"b": {1, 2}}},
        {"a": {"$regex": 3}},
        ["a"],
    ):
        with pytest.raises(ValueError):
            match.where(docs, bad)


def test_date_ranges(collection):
    docs = collection(
        tree(0, measurements=[{"date": "2018-01-01"}, {"date": "2023-01-01"}]),
        tree(1, measurements=[{"date": "2019-01-01"}]),
        tree(2, measurements=[{"date": "2019-12-31"}]),
        tree(3, measurements=[{"date": "2019-7-1"}]),
    )
    path = f"{M}.date"
    assert ids(filters.by_date(docs, path, "2019-01-01", "2019-12-31")) == [0, 2]
    assert ids(filters.by_date_same_element(docs, path, "2019-01-01", "2019-12-31")) == [1, 2, 3]
    assert ids(filters.by_date(docs, path, "2020-01-01")) == [0]
    with pytest.raises(ValueError):
        filters.by_date(docs, path, "01.01.2019")


def test_range_or_missing(spark):
    rows = spark.createDataFrame(
        [(0, "A", 5.0), (1, "A", None), (2, "A", 1500.0), (3, "B", 5.0), (4, "A", -1.0)], "_id_x long, source string, h double"
    )
    assert ids(filters.range_or_missing(rows, {"h": (None, None)}, {"source": "A"})) == [0, 1]
    assert ids(filters.range_or_missing(rows, {"h": (5, 5)}, {"source": ["A", "B"]})) == [0, 1, 3]


# ---------------------------------------------------------------- filter rows
def test_composed_filters():
    rows = [filters.form_filter(*r) for r in (("mode", "TLS"), ("source", "FI"), ("Canopy", "Leaf-On"), ("dbh", (None, 14)))]
    mode, source, canopy, dbh = rows
    assert dbh == {f"{M}.DBH_cm": {"$gt": 0.0, "$lt": 14.0}}
    assert canopy == {f"{D}.canopy_condition": "leaf-on"}
    assert filters.form_filter("labels", "Not set") == {f"{D}.has_labels": {"$nin": ["true", "false"]}}
    assert filters.form_filter("quality", [1, 2]) == {"$or": [{f"{D}.quality": 1}, {f"{D}.quality": 2}]}
    compose = filters.compose_filters
    assert compose([], [], []) == {}
    assert compose([mode], [""], [0]) == mode
    assert compose([mode, source, canopy], ["", "OR", "AND"], [0, 0, 0]) == {"$or": [mode, {"$and": [source, canopy]}]}
    assert compose([mode, source, canopy], ["", "OR", "AND"], [1, 1, 0]) == {"$and": [{"$or": [mode, source]}, canopy]}
    same = compose([mode, source, canopy, dbh], ["", "AND", "AND", "AND"], [0] * 4, elem_match=True)
    assert same == {
        "$and": [
            {D: {"$elemMatch": {"$and": [{"mode": "TLS"}, {"canopy_condition": "leaf-on"}]}}},
            {M: {"$elemMatch": {"$and": [{"source": "FI"}, {"DBH_cm": {"$gt": 0.0, "$lt": 14.0}}]}}},
        ]
    }
    deep = compose([mode, source, canopy, dbh], ["", "AND", "OR", "AND"], [0, 1, 2, 2], elem_match=False)
    assert deep == {"$and": [mode, {"$or": [source, {"$and": [canopy, dbh]}]}]}
    with pytest.raises(ValueError):
        filters.form_filter("bark", 1)


# ---------------------------------------------------------------- brute force
def values(doc, path):
    found = [doc]
    for step in path.split("."):
        opened = [e for v in found for e in (v if isinstance(v, list) else [v])]
        found = [e[step] for e in opened if isinstance(e, dict) and step in e]
    return found


def leaves(doc, path):
    return [x for v in values(doc, path) for x in ([v, *v] if isinstance(v, list) else [v])]


def kind(value):
    return bool if isinstance(value, bool) else float if isinstance(value, (int, float)) else type(value)


def test_one(doc, path, name, value):
    if name == "$exists":
        return bool(values(doc, path)) == bool(value)
    if name == "$not":
        return not field(doc, path, value)
    if name == "$ne":
        return not test_one(doc, path, "$eq", value)
    if name == "$nin":
        return not test_one(doc, path, "$in", value)
    if name == "$in":
        return any(test_one(doc, path, "$eq", v) for v in value)
    if name == "$elemMatch":
        return any(brute(e, value) for v in values(doc, path) if isinstance(v, list) for e in v)
    if name == "$regex":
        return any(isinstance(v, str) and re.search(value, v) for v in leaves(doc, path))
    ops = {"$eq": "__eq__", "$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}
    same = [v for v in leaves(doc, path) if kind(v) is kind(value)]
    return any(getattr(float(v) if kind(v) is float else v, ops[name])(float(value) if kind(value) is float else value) for v in same)


test_one.__test__ = False


def field(doc, path, spec):
    spec = spec if isinstance(spec, dict) else {"$eq": spec}
    return all(test_one(doc, path, n, v) for n, v in spec.items())


def brute(doc, query):
    done = []
    for key, spec in query.items():
        if key.startswith("$"):
            parts = [brute(doc, q) for q in spec]
            done.append({"$and": all(parts), "$or": any(parts), "$nor": not any(parts)}[key])
        else:
            done.append(field(doc, key, spec))
    return all(done)


def same_value(a, b):
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same_value, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same_value(a[k], b[k]) for k in a)
    return kind(a) is kind(b) and a == b


def json_value(rng, depth=0):
    pick = rng.randrange(7 if depth < 3 else 5)
    if pick < 5:
        return rng.choice([None, True, False, 0, 1, 1.0, 2.5, "", "a", "1", -3, 3_000_000_000])
    if pick == 5:
        return [json_value(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {k: json_value(rng, depth + 1) for k in rng.sample(["a", "b", "c d"], rng.randrange(3))}


def test_equality_with_arrays_and_objects(collection):
    rng = random.Random(11)
    raw = [{"x": json_value(rng), "deep": [{"y": json_value(rng)} for _ in range(rng.randrange(3))]} for _ in range(250)]
    raw += [{"x": {"a": 1, "b": [1, 2.50]}}, {"x": {"b": [1.0, 2.5], "a": 1}}, {"x": [{"a": 1, "b": [1, 2.5]}]}, {}]
    docs = collection(*raw).cache()
    wanted = [v for d in raw for v in leaves(d, "x") + leaves(d, "deep.y") if isinstance(v, (list, dict))]
    wanted = [v for i, v in enumerate(wanted) if not any(same_value(v, w) for w in wanted[:i])][:45] + [{"a": 1, "b": [1, 2.5]}]
    queries = {f"{path[0]}{i}": (path, v) for i, v in enumerate(wanted) for path in ("x", "deep.y")}
    rows = match.with_conditions(docs, {n: {p: v} if i % 2 else {p: {"$eq": v}} for i, (n, (p, v)) in enumerate(queries.items())}).select("_id_x", *queries).collect()
    for name, (path, value) in queries.items():
        assert [r["_id_x"] for r in rows if r[name]] == [i for i, d in enumerate(raw) if any(same_value(v, value) for v in leaves(d, path))], (path, value)
    some = {"a": 1, "b": [1, 2.5]}
    assert found(docs, {"x": {"$in": [some, "a"]}}) == [i for i, d in enumerate(raw) if any(same_value(v, some) or v == "a" for v in leaves(d, "x"))]
    assert found(docs, {"x": {"$ne": []}}) == [i for i, d in enumerate(raw) if not any(same_value(v, []) for v in leaves(d, "x"))]
    assert found(docs, {"geometry.coordinates": [1.0, 2.0, 0.0]}) == []
    assert found(collection(tree(0, lon=1, lat=2.0), tree(1)), {"geometry.coordinates": [1.0, 2.0, 1.5]}) == [0]
    assert found(collection(tree(0, data=[{"tags": ["u", 1]}]), tree(1)), {D: {"$elemMatch": {"tags": ["u", 1], "mode": "ALS"}}}) == [0]


def test_types(spark, collection):
    raw = [{"x": v} for v in (None, True, 1, 3_000_000_000, 1.5, "1", [], ["a", 2], {}, [[1]])] + [{}]
    docs = collection(*raw)
    expected = {
        "null": [0], "bool": [1], "int": [2, 7], "long": [3], "double": [4], "number": [2, 3, 4, 7], "string": [5, 7], "array": [6, 7, 9], "object": [8],
        10: [0], 16: [2, 7], 4: [6, 7, 9],
    }
    for name, rows in expected.items():
        assert found(docs, {"x": {"$type": name}}) == rows, name
    assert found(docs, {"x": {"$type": ["null", "bool"]}}) == [0, 1]
    assert found(docs, {"x": {"$not": {"$type": "array"}}}) == [0, 1, 2, 3, 4, 5, 8, 10]
    tables = as_relational(spark, [{"properties": {"id": "T", "species": "S", "measurements": [{"source": "FI"}], "data": []}}])
    assert ids(match.where(tables, {f"{M}.source": {"$type": "string"}})) == [0]
    with pytest.raises(ValueError):
        match.where(tables, {M: {"$type": "array"}})


def plain_key(value, empty_first=True):
    if isinstance(value, bool):
        return 6, int(value)
    if value is None:
        return 1, 0
    if isinstance(value, (int, float)):
        return 2, value
    if isinstance(value, str):
        return 3, value
    return (4 if isinstance(value, dict) else 5), json.dumps(value, separators=(",", ":"), sort_keys=True)


def plain_order(raw, path, way):
    def key(doc):
        keys = [k for v in values(doc, path) for k in ([plain_key(m) for m in v] or [(0, 0)] if isinstance(v, list) else [plain_key(v)])]
        for head in [path.rpartition(".")[0]] if "." in path else []:
            keys += [(1, 0) for v in values(doc, head) if isinstance(v, list) for e in v if isinstance(e, dict) and path.rpartition(".")[2] not in e]
        return (min(keys) if way > 0 else max(keys)) if keys else (1, 0)

    return sorted(range(len(raw)), key=lambda i: key(raw[i]), reverse=False) if way > 0 else sorted(range(len(raw)), key=lambda i: key(raw[i]), reverse=True)


def test_sorting_over_all_types(spark, collection):
    from arborframe.operators import access

    rng = random.Random(5)
    flat = [None, True, False, -1, 0, 9, 10, 100, 2, 2.5, "", "10", "9", "a", {"a": 1}, {"b": 1}, {}, [], [5, 1], ["z"], [[1]], [None], [True, "a"]]
    raw = [{"x": v, "deep": [{"y": rng.choice([v for v in flat if not isinstance(v, (list, dict))])} if rng.random() < 0.8 else {} for _ in range(rng.randrange(3))]} for v in flat] + [{}, {"x": 7}]
    docs = collection(*raw)
    for path in ("x", "deep.y"):
        for way in (1, -1):
            got = [r["_id_x"] for r in access.sorted_page(docs, {}, sort=[(path, way)]).select("_id_x").collect()]
            assert got == plain_order(raw, path, way), (path, way)
    ages = collection(*[{"age": a} for a in (10, 9, 100, 2)])
    assert [r["_id_x"] for r in access.sorted_page(ages, {}, sort="age", limit=3).collect()] == [3, 1, 0]
    odd = collection(tree(0, species="b"), tree(1, species="a"), tree(2, species=5), without(tree(3), "properties", "species"))
    assert [r["_id_x"] for r in access.sorted_page(odd, {}, sort="properties.species").collect()] == [3, 2, 1, 0]
    assert [r["_id_x"] for r in access.sorted_page(odd, {}, sort=[("properties.species", -1), ("_id_x", 1)], skip=1).collect()] == [1, 2, 3]
    tables = as_relational(spark, random_documents(rng, 9))
    assert access.sorted_page(tables, {}, sort="properties.species").count() == 9
    with pytest.raises(ValueError):
        access.sorted_page(tables, {}, sort="properties.age")


def random_documents(rng, count):
    def maybe(name, choices):
        return {} if rng.random() < 0.3 else {name: rng.choice(choices)}

    out = []
    for i in range(count):
        measurements = [
            {**maybe("source", ["FI", "TLS", "ALS"]), **maybe("height_m", [None, 1, 2.5, 7]), **maybe("DBH_cm", [1, 5, 9.5])}
            for _ in range(rng.randrange(4))
        ]
        data = [{**maybe("mode", ["TLS", "ULS"]), **maybe("quality", [1, 2, 3])} for _ in range(rng.randrange(3))]
        species = rng.choice(["Abies alba", "Picea abies", "Quercus robur"])
        out.append({"type": "Feature", "properties": {"id": f"T{i}", "species": species, "measurements": measurements, "data": data}})
    return out


def random_filter(rng, depth=0):
    def leaf(path, texts, numbers):
        name = rng.choice(["$eq", "$ne", "$in", "$nin", "$exists", "$not", "range"])
        pool = numbers or texts
        if name == "range":
            return {path: {rng.choice(["$gt", "$gte"]): min(pool), rng.choice(["$lt", "$lte"]): rng.choice(pool)}}
        if name in ("$in", "$nin"):
            return {path: {name: rng.sample(pool, 2)}}
        if name == "$exists":
            return {path: {"$exists": rng.choice([True, False])}}
        if name == "$not":
            return {path: {"$not": {"$regex": texts[0][:1]} if texts else {"$gt": rng.choice(pool)}}}
        return {path: {name: rng.choice(pool)}}

    choice = rng.randrange(8 if depth < 2 else 5)
    if choice == 0:
        return leaf(f"{M}.source", ["FI", "TLS", "ALS"], [])
    if choice == 1:
        return leaf(f"{M}.height_m", [], [1, 2.5, 7])
    if choice == 2:
        return leaf(f"{D}.quality", [], [1, 2, 3])
    if choice == 3:
        return leaf("properties.species", ["Abies alba", "Picea abies"], [])
    if choice == 4:
        inner = {**leaf("source", ["FI", "TLS", "ALS"], []), **leaf("DBH_cm", [], [1, 5, 9.5])}
        return {M: {"$elemMatch": inner}}
    parts = [random_filter(rng, depth + 1) for _ in range(rng.randrange(1, 4))]
    return {["$and", "$or", "$nor"][choice - 5]: parts}


def as_relational(spark, docs):
    """The same documents as header and element tables."""
    header = [(i, d["properties"]["id"], d["properties"]["species"]) for i, d in enumerate(docs)]
    m = [
        (i, e.get("source"), e.get("height_m"), "height_m" in e, e.get("DBH_cm"))
        for i, d in enumerate(docs)
        for e in d["properties"]["measurements"]
    ]
    s = [(i, e.get("mode"), e.get("quality")) for i, d in enumerate(docs) for e in d["properties"]["data"]]
    m = [(i, a, None if h is None else float(h), k, None if d is None else float(d)) for i, a, h, k, d in m]
    return RelationalDocs(
        header=spark.createDataFrame(header, "_id_x long, id string, species string"),
        tables={
            "m": spark.createDataFrame(m, "_id_x long, source string, height_m double, has_height boolean, DBH_cm double"),
            "s": spark.createDataFrame(s, "_id_x long, mode string, quality long"),
        },
        arrays={
            M: (
                "m",
                {
                    "source": ElementField(TEXT, F.col("source")),
                    "height_m": ElementField(NUMBER, F.col("height_m"), F.col("has_height")),
                    "DBH_cm": ElementField(NUMBER, F.col("DBH_cm")),
                },
            ),
            D: ("s", {"mode": ElementField(TEXT, F.col("mode")), "quality": ElementField(NUMBER, F.col("quality"))}),
        },
        scalars={p: v for p, v in model.SCALARS.items() if v[1] in ("_id_x", "id", "species")},
    )


def test_random_filters_agree_with_brute_force(spark, collection):
    rng = random.Random(7)
    raw = random_documents(rng, 120)
    docs, tables = collection(*raw), as_relational(spark, raw)
    queries = {f"q{i}": random_filter(rng) for i in range(40)}
    expected = {name: {i for i, d in enumerate(raw) if brute(d, q)} for name, q in queries.items()}
    variant = docs.withColumns(
        {
            f"v_{name}": F.coalesce(match.compile_filter(q, match.VariantScope(F.col("doc"))), F.lit(False))
            for name, q in queries.items()
        }
    )
    layouts = {
        "columnar": (match.with_conditions(docs, queries), ""),
        "variant": (variant, "v_"),
        "relational": (match.with_conditions(tables, queries), ""),
    }
    for layout, (frame, prefix) in layouts.items():
        rows = frame.select("_id_x", *[prefix + name for name in queries]).collect()
        for name, query in queries.items():
            got = {r["_id_x"] for r in rows if r[prefix + name]}
            assert got == expected[name], (layout, query, got ^ expected[name])


def test_equivalent_formulations(spark):
    rng = random.Random(3)
    tables = as_relational(spark, random_documents(rng, 60))
    from arborframe.operators import joins

    a, b = {f"{M}.source": "FI"}, {f"{D}.quality": {"$lte": 2}}
    fa, fb = match.where(tables, a), match.where(tables, b)
    assert ids(match.where(tables, {"$and": [a, b]})) == ids(joins.intersect_results(fa, fb))
    assert ids(match.where(tables, {"$or": [a, b]})) == ids(joins.union_results(fa, fb))
    nor = {"$nor": [{f"{M}.source": "FI"}, {f"{M}.source": "TLS"}]}
    assert ids(match.where(tables, nor)) == ids(joins.anti_join_missing_source(tables, ["FI", "TLS"]))


def test_filters_work_on_streams(spark, collection, tmp_path):
    docs = collection(tree(0, data=[{"mode": "TLS"}]), tree(1))
    path = str(tmp_path / "docs")
    docs.select("_id_x", "data").write.parquet(path)
    stream = match.where(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path), {f"{D}.mode": "TLS"})
    query = stream.select("_id_x").writeStream.format("memory").queryName("hits").trigger(availableNow=True).start()
    query.awaitTermination()
    assert ids(spark.table("hits")) == [0]
