"""The quick typed parse must agree with reading every value from the VARIANT."""

from __future__ import annotations

import json
import random

from conftest import tree
from pyspark.sql import functions as F

from arborframe import model

ODD = [
    '{"properties":{"id":1,"data":[1,{"mode":"A"},null,[2],{"mode":5,"quality":"x"}],"measurements":{"source":"FI"}}}',
    '{"properties":{"data":"str","id":"ok"},"type":"Feature"}',
    '{"properties":5,"type":"F","geometry":{"coordinates":[1,"2",null]}}',
    '{"properties":{"data":[{"mode":"a","mode":"dup"}]},"type":"x"}',
    '{"type":"a"} trailing',
    "{bad",
    '[{"type":"F"}]',
    "null",
    '"text"',
    '{"type":NaN}',
    "{'type':'a'}",
    '{"properties":{"measurements":[{"source":"FI"}],"data":[{"mode":"A"}, 3]},"geometry":"g"}',
    '{"properties":{"measurements":[{"height_m":"NaN","DBH_cm":"Infinity"},{"height_m":"-INF","DBH_cm":true}]}}',
    '{"properties":{"measurements":[{"source" : 5},{"source"\n\t:\t[1]},{"source"                    : 7}]}}',
    '{"properties":{"measurements":[{"s\\u006furce": 5, "state": {"a": 1}}, {"state": null, "crs": true}]}}',
    '{"properties":{"measurements":[{"Source":"FI","dbh_cm":1,"height_m":"12"}]}}',
    '{"properties":{"species":7,"source":null},"geometry":{"type":3,"coordinates":[8.5,49]}}',
    '{"properties":{"data":[{"quality":1.5,"point_count":12345678901234567890,"file":"\\"type\\": 5 \\u00fc"}]}}',
    '{"properties":{"data":[],"measurements":null},"geometry":{"coordinates":{"a":1}}}',
    '{"properties":{"data":[[{"mode":"x"}]],"measurements":[null]},"geometry":{"coordinates":[]}}',
    '{"properties":{"data":[{"quality":1e400}]}}',
]


def damaged(rng, value):
    """Copy of a JSON value with some members replaced by values of another type."""
    if rng.random() < 0.08:
        return rng.choice([None, 1, 2.5, "7", "NaN", True, [], {}, [1], {"a": 1}])
    if isinstance(value, dict):
        return {k: damaged(rng, v) for k, v in value.items() if rng.random() > 0.05}
    if isinstance(value, list):
        return [damaged(rng, v) for v in value]
    return value


def shown(docs):
    def members(struct):
        return {k: [sorted(x) if x else x for x in v] if k == "_keys" and v else v for k, v in struct.asDict().items()}

    rows = docs.withColumn("doc", F.to_json("doc")).orderBy("_id_x").collect()
    return [
        {k: members(v) if k in ("measurements", "data") else v for k, v in r.asDict().items() if k not in ("raw",)} for r in rows
    ]


def test_quick_and_careful_reading_agree(collection, monkeypatch):
    rng = random.Random(11)
    full = tree(
        0,
        data=[{"sensor": "s", "has_labels": "true"}, {}],
        measurements=[{"height_m": None, "DBH_cm": 2, "state": "alive"}, {"crs": "x", "position_xyz": [1, 2, 3]}],
    )
    texts = ODD + [json.dumps(damaged(rng, full), indent=rng.choice([None, 2])) for _ in range(150)]
    quick = shown(collection(*texts))
    monkeypatch.setattr(model, "_needs_care", lambda raw: F.lit(True))
    careful = shown(collection(*texts))
    for text, a, b in zip(texts, quick, careful):
        assert a == b, text
    assert sum(r["data"]["mode"] is not None for r in quick) > 50


def test_regular_documents_take_the_quick_path(spark):
    texts = spark.createDataFrame([(json.dumps(tree(0, note="ü")),), (json.dumps(tree(1, data=[{"mode": 3}])),)], "raw string")
    assert [r[0] for r in texts.select(model._needs_care(F.col("raw"))).collect()] == [False, True]


def test_elements_keep_order_and_keys(collection):
    docs = collection(tree(0, data=[{"mode": "A"}, {"mode": "B", "odd": 1}]), tree(1, data=[]))
    rows = model.elements(docs, "properties.data", "_id_x").collect()
    assert [(r["pos"], r["mode"], "odd" in r["_keys"]) for r in rows] == [(0, "A", False), (1, "B", True)]
    assert model.variant_elements(docs, "properties.data", "_id_x").count() == 2
