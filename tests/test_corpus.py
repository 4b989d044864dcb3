"""Counts on a folder of real tree documents, named by ``TREE_CORPUS_DIR``.

The expected numbers come from an independent plain scan of the 308 documents
of that public corpus; without the folder the module is skipped.
"""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from arborframe.operators import access, filters, match, nodes, stats, validate, views
from arborframe.store import TreeStore

CORPUS = os.environ.get("TREE_CORPUS_DIR")
pytestmark = pytest.mark.skipif(not CORPUS, reason="TREE_CORPUS_DIR is not set")
M, D = "properties.measurements", "properties.data"


@pytest.fixture(scope="module")
def store(spark):
    trees = TreeStore(spark)
    assert trees.import_data(CORPUS) == 308
    trees.materialise()
    return trees


@pytest.mark.parametrize(
    "query, expected",
    [
        ({f"{D}.mode": "TLS"}, 27),
        ({f"{D}.mode": "ULS"}, 107),
        ({f"{M}.source": "FI"}, 238),
        ({"properties.species": "Abies alba"}, 18),
        ({"properties.species": {"$regex": "Quercus*"}}, 99),
        ({"properties.species": {"$regex": "[Aa]bies+"}}, 24),
        ({f"{M}.DBH_cm": {"$gt": 25}}, 217),
        ({f"{M}.height_m": {"$lt": 30}}, 244),
        ({f"{D}.quality": {"$lte": 2}}, 33),
        ({f"{D}.quality": {"$lte": 2}, f"{D}.mode": "TLS"}, 25),
        ({D: {"$elemMatch": {"quality": {"$lte": 2}, "mode": "TLS"}}}, 24),
        ({f"{M}.crown_base_height_green_m": {"$exists": 1}}, 238),
        ({"$nor": [{f"{M}.source": "FI"}, {f"{M}.source": "TLS"}], f"{M}.height_m": {"$gt": 20}}, 35),
        ({f"{D}.mode": "ULS", f"{D}.canopy_condition": {"$not": {"$regex": "leaf-off"}}}, 96),
        ({f"{D}.has_labels": {"$nin": ["true", "false"]}}, 307),
        ({f"{M}.DBH_cm": {"$lt": 14, "$gt": 1}, f"{M}.source": "FI", f"{D}.mode": "ALS"}, 7),
        ({"properties.id": {"$regex": "SP02+"}}, 6),
    ],
)
def test_counts(store, query, expected):
    assert store.query(query).count() == expected


def test_dates(store):
    docs = store.docs
    assert filters.by_date(docs, f"{D}.date", "2019-07-05", "2019-07-24").count() == 97
    assert filters.by_date_same_element(docs, f"{D}.date", "2019-07-05", "2019-07-24").count() == 297
    assert filters.by_date(docs, f"{M}.date", "2019-07-06", "2019-08-01").count() == 196
    assert filters.by_date_same_element(docs, f"{M}.date", "2019-07-06", "2019-08-01").count() == 7


def test_places(store):
    def near(lon, lat, metres):
        return store.query_by_geometry({"type": "Point", "coordinates": [lon, lat]}, metres).count()

    # Points and a plot of the public corpus.
    assert near(8.6995085, 49.0131634, 150.0) == 4
    assert near(8.682112, 49.014387, 2000.0) == 92
    ring = [
        [8.657777973760469, 49.019526417240272],
        [8.6564204259407, 49.018633562408255],
        [8.655062878168346, 49.019526417240272],
        [8.656420425940698, 49.020419287904346],
        [8.657777973760469, 49.019526417240272],
    ]
    assert store.query_by_geometry({"type": "Polygon", "coordinates": [ring]}).count() == 6


def test_totals(store):
    assert store.get_stats().first().asDict() == {"n_trees": 308, "n_species": 16}
    assert validate.validate_docs(store.docs).where("valid").count() == 308
    assert views.tree_metrics(store.docs).count() == 674
    assert len(views.tree_general(store.docs).columns) == 9
    assert access.pointcloud_urls(match.where(store.docs, {f"{D}.mode": "TLS"})).count() == 66
    assert nodes.flatten_docs(store.docs).count() == 13873
    assert stats.measurement_keys(store.docs).count() == 13
    names = [r["_file"] for r in store.docs.orderBy("_id_x").select("_file").collect()]
    assert names == sorted(names) and store.docs.agg(F.max("_id_x")).first()[0] == 307
