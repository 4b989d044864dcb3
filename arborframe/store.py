"""``TreeStore``: a collection of tree documents with the familiar calls.

Every method returns a DataFrame (nothing is computed until it is used) except
where a plain number is asked for.  The collection is a columnar document
DataFrame; ``save`` and ``load`` keep it as Parquet, its native form.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from .operators import access, filters, match, stats, validate
from .operators import views as tables
from .session import scratch_path
from .sources import readers, stamp, writers

RAW = "_id_x long, _file string, _date string, raw string"
TEXT = ("_id_x", "_file", "_date", "raw")


class TreeStore:
    def __init__(self, spark: SparkSession, docs: DataFrame | None = None):
        self.spark = spark
        if docs is None:
            self._set_docs(model.documents(spark.createDataFrame([], RAW)))
        else:
            self._set_docs(docs)
        self._empty = docs is None

    def _set_docs(self, docs: DataFrame) -> None:
        self.docs, self.text, self._empty = docs, docs.select(*TEXT), False

    # ---- import
    def _start(self, overwrite: bool) -> int:
        return 0 if overwrite else stamp.next_id(self.docs)

    def _add(self, fresh: DataFrame, overwrite: bool) -> int:
        """Keep freshly stamped texts as a table of their own, so that no later query reads the imported files."""
        path = scratch_path(self.spark, "trees")
        writers.save_table(fresh.select(*TEXT), path)
        added = self.spark.read.parquet(path)
        self._set_docs(added if overwrite or self._empty else self.docs.unionByName(added))
        return added.count()

    def import_data(self, path: str, overwrite: bool = False) -> int:
        """Valid documents of a directory, or of a ZIP archive; returns how many were added."""
        rows = readers.import_zip(self.spark, path) if path.endswith(".zip") else readers.import_docs(self.spark, path)
        valid = validate.accepted(model.parsed(rows))
        return self._add(stamp.stamp_files(rows, valid, self._start(overwrite)), overwrite)

    def import_db(self, path: str, overwrite: bool = False) -> int:
        """All documents of a dump, with new ids and dates; returns how many were added."""
        rows = readers.read_dump(self.spark, path).where("rejected IS NULL")
        return self._add(stamp.stamp_members(rows.select("path", "place", "_file", "raw"), self._start(overwrite)), overwrite)

    def load(self, path: str) -> None:
        """Replace the collection by a dump, ids and dates as stored."""
        self._add(readers.read_dump(self.spark, path).where("rejected IS NULL"), True)

    def save(self, path: str) -> None:
        """Write the collection as a Parquet table."""
        writers.save_table(self.text, path)

    def open(self, path: str) -> None:
        """Use a collection written by ``save``."""
        self._set_docs(self.spark.read.parquet(path))

    def materialise(self) -> None:
        """Write the collection to the shared scratch folder and read it from there."""
        path = scratch_path(self.spark, "trees")
        self.save(path)
        self.open(path)

    # ---- access
    def __len__(self) -> int:
        return access.count_docs(self.docs).first()["n"]

    def __getitem__(self, item: int | slice | Sequence[int]) -> DataFrame:
        if isinstance(item, int):
            return access.get_item(self.docs, item)
        if isinstance(item, slice):
            return access.slice_items(self.docs, item.start, item.stop, item.step)
        return access.get_items(self.docs, item)

    def get_ids(self, trees: DataFrame) -> DataFrame:
        return access.get_ids(trees)

    def get_pointcloud_urls(self, trees: DataFrame) -> DataFrame:
        return access.pointcloud_urls(trees)

    def get_tree_as_json(self, trees: DataFrame, indent: int | None = 4, metadata: bool = False) -> DataFrame:
        return writers.doc_json(trees, metadata=metadata, indent=indent)

    # ---- statistics
    def get_stats(self) -> DataFrame:
        return stats.stats(self.docs)

    def get_list_species(self) -> DataFrame:
        return stats.list_species(self.docs)

    def get_shared_properties(self) -> DataFrame:
        return stats.shared_properties(self.docs)

    # ---- queries
    def query(
        self,
        condition: Mapping[str, Any],
        projection: Mapping[str, Any] | None = None,
        limit: int | None = None,
        skip: int = 0,
        sort: str | Sequence[tuple[str, int]] | None = None,
    ) -> DataFrame:
        """Documents matching a filter; optional order, projection, ``skip`` and ``limit``.

        ``sort`` is a path or a list of (path, 1 or -1).  Without it, a top-level
        ``$nearSphere`` puts the nearest document first.  A projection keeps the paths set to a true value or, if there are none,
        drops those set to a false one.
        """
        found = access.sorted_page(match.where(self.docs, condition), condition, skip, limit, sort)
        paths = {path: keep for path, keep in (projection or {}).items() if path != "_id"}
        kept = [path for path, keep in paths.items() if keep]
        if kept:
            return access.project_include(found, kept)
        return access.project_exclude(found, list(paths)) if paths else found

    def query_by_key_value(self, key: str, value: Any, regex: bool = True) -> DataFrame:
        return filters.by_key_value(self.docs, key, value, regex)

    def query_by_key_exists(self, key: str) -> DataFrame:
        return filters.by_key_exists(self.docs, key)

    def query_by_species(self, regex: str) -> DataFrame:
        return filters.by_species(self.docs, regex)

    def query_by_date(self, key: str, start: str, end: str | None = None) -> DataFrame:
        return filters.by_date(self.docs, key, start, end)

    def query_by_geometry(self, geom: Mapping[str, Any] | str, distance: float = 0.0) -> DataFrame:
        return filters.by_geometry(self.docs, geom, distance)

    # ---- export
    def export_data(self, outdir: str, trees: DataFrame | None = None) -> DataFrame:
        """One file per document below a shared folder; ``trees`` restricts by id."""
        return writers.export_docs(self.docs, outdir, trees)

    def convert_to_csv(self, outdir: str, trees: DataFrame | None = None) -> list[str]:
        """The two relational views as CSV folders; returns their paths."""
        docs = writers.restrict(self.docs, trees)
        paths = [f"{outdir}/result_general.csv", f"{outdir}/result_metrics.csv"]
        for table, path in zip((tables.tree_general(docs), tables.tree_metrics(docs)), paths):
            writers.write_csv(table, path)
        return paths

    def export_collection(self, condition: Mapping[str, Any], path: str, metadata: bool = True) -> None:
        """A query result as one GeoJSON FeatureCollection, with the ids, dates and file names unless told otherwise."""
        writers.write_feature_collection(self.query(condition), path, metadata)
