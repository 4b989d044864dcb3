"""Access by position, projection and paging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import geo
from . import positions, values
from .match import where


def header(docs) -> DataFrame:
    return docs if isinstance(docs, DataFrame) else docs.header


def count_docs(docs) -> DataFrame:
    return header(docs).agg(F.count(F.lit(1)).alias("n"))


def get_item(docs, index: int) -> DataFrame:
    """The document at a position in id order; negative positions count from the end."""
    return positions.at(header(docs), [index]).drop("pos")


def get_items(docs, indices: Sequence[int]) -> DataFrame:
    """Documents at the given positions, order and repeats kept (column ``pos``)."""
    return positions.at(header(docs), list(indices))


def slice_items(docs, start: int | None = None, stop: int | None = None, step: int | None = None) -> DataFrame:
    """Documents of a Python slice, in slice order."""
    return positions.sliced(header(docs), start, stop, step)


def get_ids(docs) -> DataFrame:
    return header(docs).select("_id_x")


def pointcloud_urls(docs, matching: DataFrame | None = None) -> DataFrame:
    """``_id_x, file`` of every scan; elements without a file are skipped.

    ``matching`` restricts the links to the documents of a query result.
    """
    if isinstance(docs, DataFrame):
        rows = model.elements(docs, "properties.data", "_id_x").select("_id_x", "pos", "file")
    else:
        rows = docs.rows("properties.data").select("_id_x", "file")
    if matching is not None:
        rows = rows.join(matching.select("_id_x"), "_id_x", "left_semi")
    return rows.where(F.col("file").isNotNull())


# ---------------------------------------------------------------- projections
def _pick(value: Column, tree: Mapping[str, Any]) -> Column:
    """Members of a VARIANT object named by ``tree``, as an object again; the values themselves stay as stored."""

    def member(name: str, below: Mapping[str, Any]) -> Column:
        inner = model.child(value, name)
        if not below:
            return inner
        many = F.transform(model.as_array(inner), lambda e: _pick(e, below))
        return F.coalesce(F.to_variant_object(many), _pick(inner, below))

    members = F.array(*[F.struct(F.lit(name).alias("key"), member(name, below).alias("value")) for name, below in tree.items()])
    picked = F.map_from_entries(F.filter(members, lambda m: m["value"].isNotNull()))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), F.to_variant_object(picked))


def _tree(paths: Sequence[str]) -> dict[str, Any]:
    tree: dict[str, Any] = {}
    for path in paths:
        node = tree
        for step in path.split("."):
            node = node.setdefault(step, {})
    return tree


def project_include(docs: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Only the named paths: metadata as columns, the rest as a VARIANT ``doc``."""
    metadata = [p for p in paths if p in model.METADATA]
    inner = [p for p in paths if p not in model.METADATA]
    return docs.select(*metadata, _pick(F.col("doc"), _tree(inner)).alias("doc"))


def _without(value: Column, tree: Mapping[str, Any]) -> Column:
    """A VARIANT object without the leaves named by ``tree``; other values stay as stored."""

    def reduced(inner: Column, below: Mapping[str, Any]) -> Column:
        many = F.transform(model.as_array(inner), lambda e: _without(e, below))
        return F.coalesce(F.to_variant_object(many), _without(inner, below))

    def member(key: Column, inner: Column) -> Column:
        changed = [(key == name, reduced(inner, below)) for name, below in tree.items() if below]
        return reduce(lambda rest, case: F.when(*case).otherwise(rest), changed, inner)

    gone = [name for name, below in tree.items() if not below]
    kept = F.map_filter(model.as_map(value), lambda key, _: ~key.isin(gone))
    return F.coalesce(F.to_variant_object(F.transform_values(kept, member)), value)


def project_exclude(docs: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Everything but the named paths: metadata columns and a VARIANT ``doc``."""
    metadata = [c for c in model.METADATA if c not in paths]
    inner = [p for p in paths if p not in model.METADATA]
    doc = _without(F.col("doc"), _tree(inner)) if inner else F.col("doc")
    return docs.select(*metadata, doc.alias("doc"))


def field_projection(docs) -> DataFrame:
    """Place, id and species of every document, for lists and map markers."""
    return header(docs).select("_id_x", "id", "species", "lon", "lat", "elev")


# ---------------------------------------------------------------- paging
def limit_skip(docs, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Documents in id order from ``skip``, at most ``limit`` of them.

    The page is found from counts of id ranges, whatever its depth; rows that
    repeat an id are ordered by their plain columns.
    """
    table = header(docs)
    if limit is not None and limit <= 0:
        return table.limit(0)
    return positions.span(table, skip, None if limit is None else skip + limit - 1).orderBy(*positions.order(table))


def _nearness(condition: Mapping[str, Any]) -> Column | None:
    """Distance to the point of a top-level ``$nearSphere``."""
    for spec in condition.values():
        if isinstance(spec, Mapping) and isinstance(spec.get("$nearSphere"), Mapping):
            lon, lat = spec["$nearSphere"]["$geometry"]["coordinates"][:2]
            return geo.distance_m(F.col("lon"), F.col("lat"), F.lit(float(lon)), F.lit(float(lat)))
    return None


def sorted_page(
    docs, condition: Mapping[str, Any], skip: int = 0, limit: int | None = None, sort: str | Sequence[tuple[str, int]] | None = None
) -> DataFrame:
    """A page in the order asked for: ``sort``, else nearest first, else by id.

    ``sort`` orders values of all types, see ``values.sort_key``.
    """
    if sort is not None:
        keys = [values.sort_key(header(docs), path, way) for path, way in ([(sort, 1)] if isinstance(sort, str) else sort)]
    elif (near := _nearness(condition)) is not None:
        keys = [near]
    elif skip or limit is not None:
        return limit_skip(docs, skip, limit)
    else:
        return header(docs)
    page = header(docs).orderBy(*keys, "_id_x")
    page = page.offset(skip) if skip else page
    return page if limit is None else page.limit(limit)


def page_results(docs, query: Mapping[str, Any], limit: int, page: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A preview page, the total count, and the marker projection of all hits."""
    hits = where(docs, query)
    return sorted_page(hits, query, limit * page, limit), count_docs(hits), field_projection(hits)
