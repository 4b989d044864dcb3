"""Headline queries, one JSON line on stdout.

``ingest`` derives, parses and writes the document table; the ``doc_*`` queries
read that Parquet table, the others the flat benchmark tables.  Each query runs
once to warm up and is then timed as the best of two, writing to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from arborframe.operators import access, filters, match, nodes, stats, views  # noqa: E402
from arborframe.plans.catalog import CATALOG, DATA, MEASURED  # noqa: E402
from arborframe.plans.views import order_text  # noqa: E402
from arborframe.session import scratch_path  # noqa: E402
from arborframe.sources import stamp, writers  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
FLAT = ("stats", "species_regex", "logical_and", "elem_match", "date_range", "near_point", "within_polygon", "spatial_join", "spatial_join_polygons", "map_clusters")
POINT = {"type": "Point", "coordinates": [8.7, 49.0]}


def seconds(frame: DataFrame) -> float:
    started = time.perf_counter()
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def document_queries(docs: DataFrame) -> dict[str, DataFrame]:
    same = {DATA: {"$elemMatch": {"quality": {"$lte": 2}, "mode": "ULS"}}}
    both = {"$and": [{"properties.species": "5-LOW"}, {f"{DATA}.mode": "ULS"}]}
    return {
        "doc_stats": stats.stats(docs),
        "doc_species_regex": filters.by_species(docs, "[0-9]-[HL]").select("_id_x"),
        "doc_and": match.where(docs, both).select("_id_x"),
        "doc_elem_match": match.where(docs, same).select("_id_x"),
        "doc_elem_match_x10": match.where(stamp.replicate_docs(docs, 10), same).select("_id_x"),
        "doc_key_exists": filters.by_key_exists(docs, f"{MEASURED}.DBH_cm").select("_id_x"),
        "doc_near_point": filters.near_point(docs, POINT, 900_000.0).select("_id_x", "dist_m"),
        "doc_csv_general": views.tree_general(docs),
        "doc_csv_metrics": views.tree_metrics(docs),
        "doc_flatten": nodes.flatten_docs(docs),
    }


def eager_queries(docs: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    """Queries that count id ranges before they return a frame; the counts are timed as well."""
    return {
        "doc_get_item": lambda: access.get_item(docs, -1000).select("_id_x"),
        "doc_page": lambda: access.limit_skip(docs, 100_000, 50).select("_id_x"),
        "doc_slice": lambda: access.slice_items(docs, 10, -10, 1000).select("_id_x"),
        "doc_shared_properties": lambda: stats.shared_properties(docs),
    }


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}
    for name in FLAT:
        run = CATALOG[name][0]
        seconds(run(spark, SF_DIR))
        timings[name] = min(seconds(run(spark, SF_DIR)) for _ in range(2))
    path = scratch_path(spark, "trees")
    started = time.perf_counter()
    writers.save_table(order_text(spark, SF_DIR), path)
    timings["ingest"] = time.perf_counter() - started
    docs = spark.read.parquet(path)
    for name, frame in document_queries(docs).items():
        seconds(frame)
        timings[name] = min(seconds(frame) for _ in range(2))
    for name, run in eager_queries(docs).items():
        run().collect()
        started = time.perf_counter()
        run().collect()
        timings[name] = time.perf_counter() - started
    timings = {name: round(value, 3) for name, value in timings.items()}
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf") or 0),
                "cores": int(CPUS),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
