from __future__ import annotations

import copy
import json
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from arborframe import model  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SCAN = {
    "type": "pointcloud",
    "mode": "ALS",
    "file": "https://example.org/t/x.laz",
    "date": "2019-07-05",
    "canopy_condition": "leaf-on",
    "point_count": 10,
    "metadata-url": "https://example.org/m",
    "crs": "epsg:25832",
    "quality": 3,
}
MEASUREMENT = {"source": "FI", "date": "2019-06-04"}


def tree(number=0, species="Abies alba", measurements=None, data=None, lon=8.7, lat=49.0, **extra):
    """A complete document; given elements are completed with constants."""
    return {
        "type": "Feature",
        "properties": {
            "id": f"T{number}",
            "species": species,
            "source": "test",
            "measurements": [{**MEASUREMENT, **m} for m in ([{}] if measurements is None else measurements)],
            "data": [{**SCAN, **d} for d in ([{}] if data is None else data)],
            **extra,
        },
        "geometry": {"type": "Point", "coordinates": [lon, lat, 1.5]},
    }


def without(document, *path):
    """Copy of a document lacking one nested key."""
    changed = copy.deepcopy(document)
    inner = changed
    for step in path[:-1]:
        inner = inner[step]
    del inner[path[-1]]
    return changed


@pytest.fixture
def collection(spark):
    def build(*trees, names=None):
        rows = [
            (i, (names or {}).get(i, f"f{i}.geojson"), "2024-01-01T00:00:00", t if isinstance(t, str) else json.dumps(t))
            for i, t in enumerate(trees)
        ]
        return model.documents(spark.createDataFrame(rows, "_id_x long, _file string, _date string, raw string"))

    return build


def ids(frame):
    return sorted(row["_id_x"] for row in frame.select("_id_x").collect())
