"""Named filters on top of ``match``: species, keys, dates, places, filter rows."""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, scalars
from ..model import TEXT
from .match import compile_filter, where, where_scope

SPECIES = "properties.species"


def by_species(docs, regex: str) -> DataFrame:
    """Species matches an unanchored, case-sensitive regular expression."""
    return where(docs, {SPECIES: {"$regex": regex}})


def by_key_value(docs, key: str, value: Any, regex: bool = True) -> DataFrame:
    """A (nested) key matches a regular expression, or equals a value."""
    return where(docs, {key: {"$regex": value} if regex else value})


def by_key_exists(docs, key: str) -> DataFrame:
    """A (nested) key is present, whatever its value."""
    return where(docs, {key: {"$exists": True}})


def _iso_midnight(day: str) -> str:
    try:
        return datetime.datetime.strptime(day, "%Y-%m-%d").isoformat()
    except (TypeError, ValueError) as err:
        raise ValueError(f"{day!r} is no calendar day written as year-month-day") from err


def _midnight(day: datetime.date) -> Column:
    """A text literal: it takes the type of the column it is compared with, so that no column is cast."""
    return F.lit(f"{day.isoformat()} 00:00:00")


def _next(day: datetime.date) -> datetime.date:
    return day + datetime.timedelta(days=1)


def by_date(docs, key: str, start: str, end: str | None = None) -> DataFrame:
    """Some value at ``key`` is >= start and some value is <= end, compared as text.

    The bounds are midnight timestamps, so a date-only value equal to ``start``
    is left out and one equal to ``end`` is kept.  Stored dates are compared as
    such, from the day after ``start`` to the end of ``end``.
    """
    first = _iso_midnight(start)
    last = datetime.datetime.now().isoformat() if end is None else _iso_midnight(end)

    def build(scope) -> Column:
        stored = scope.moment(key) if hasattr(scope, "moment") else None
        if stored is None:
            return compile_filter({key: {"$gte": first, "$lte": last}}, scope)
        low, high = (datetime.date.fromisoformat(bound[:10]) for bound in (first, last))
        return stored(lambda at: at >= _midnight(_next(low))) & stored(lambda at: at < _midnight(_next(high)))

    return where_scope(docs, build)


def by_date_same_element(docs, key: str, start: str, end: str | None = None) -> DataFrame:
    """One value at ``key`` is a day of the closed interval [start, end]."""
    low = datetime.date.fromisoformat(_iso_midnight(start)[:10])
    high = datetime.date.today() if end is None else datetime.date.fromisoformat(_iso_midnight(end)[:10])

    def build(scope) -> Column:
        stored = scope.moment(key) if hasattr(scope, "moment") else None
        if stored is not None:
            return stored(lambda at: (at >= _midnight(low)) & (at < _midnight(_next(high))))
        return scope.any(key, TEXT, lambda text: scalars.lenient_date(text).between(F.lit(low), F.lit(high)))

    return where_scope(docs, build)


# ---------------------------------------------------------------- places
def near_point(docs, geom: Mapping[str, Any] | str, distance: float = 0.0, limit: int | None = None) -> DataFrame:
    """Documents within ``distance`` metres of a Point, nearest first, with ``dist_m``.

    With ``limit`` only the nearest ones are kept by a per-task top-k.
    """
    geom = geo.search_geometry(geom)
    lon0, lat0 = map(float, geom["coordinates"][:2])
    hits = where(docs, {"geometry": {"$nearSphere": {"$geometry": geom, "$maxDistance": distance}}})
    ranked = hits.withColumn("dist_m", geo.distance_m(F.col("lon"), F.col("lat"), lon0, lat0)).orderBy("dist_m", "_id_x")
    return ranked if limit is None else ranked.limit(limit)


def nearest_k(docs, geom: Mapping[str, Any] | str, k: int) -> DataFrame:
    """The ``k`` documents nearest to a Point, however far away."""
    return near_point(docs, geom, distance=geo.EARTH_RADIUS_M * 4, limit=k)


def within_polygon(docs, geom: Mapping[str, Any] | str) -> DataFrame:
    return where(docs, {"geometry": {"$geoWithin": {"$geometry": geo.search_geometry(geom)}}})


def by_geometry(docs, geom: Mapping[str, Any] | str, distance: float = 0.0) -> DataFrame:
    """Point: within ``distance`` metres, nearest first.  Polygon: inside it."""
    geom = geo.search_geometry(geom)
    return near_point(docs, geom, distance) if geom["type"] == "Point" else within_polygon(docs, geom)


def within_viewport(docs, bounds: tuple[float, float, float, float], query: Mapping[str, Any] | None = None) -> DataFrame:
    """Documents matching ``query`` inside a map view ``(west, south, east, north)``."""
    return where(docs, query or {}).where(geo.within_viewport(*bounds, F.col("lon"), F.col("lat")))


# ---------------------------------------------------------------- filter rows
# Labels of the search form and the paths they stand for.
FORM_PATHS = {
    "species": "properties.species",
    "mode": "properties.data.mode",
    "canopy_condition": "properties.data.canopy_condition",
    "quality": "properties.data.quality",
    "source": "properties.measurements.source",
    "dbh": "properties.measurements.DBH_cm",
    "height": "properties.measurements.height_m",
    "crowndia.": "properties.measurements.mean_crown_diameter_m",
    "labels": "properties.data.has_labels",
}
RANGED = ("dbh", "height", "crowndia.")
RANGE_DEFAULT = (0.0, 10000.0)  # fixed value: open ends of a range in the form


def form_filter(label: str, value: Any) -> dict[str, Any]:
    """Filter document of one form row."""
    label = label.lower()
    if label.startswith("canopy"):
        return {FORM_PATHS["canopy_condition"]: value.lower()}
    if label not in FORM_PATHS:
        raise ValueError(f"unknown filter label {label!r}")
    path = FORM_PATHS[label]
    if label == "labels":
        return {path: {"$nin": ["true", "false"]} if value == "Not set" else value.lower()}
    if label == "quality":
        return {"$or": [{path: int(q)} for q in value]}
    if label in RANGED:
        low, high = (d if bound is None else float(bound) for bound, d in zip(value, RANGE_DEFAULT))
        return {path: {"$gt": low, "$lt": high}}
    return {path: value}


def _same_element(parts: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """ANDed conditions on members of one array become a single $elemMatch."""
    kept, grouped = [], {}
    for part in parts:
        (path,) = part
        prefix, _, member = path.rpartition(".")
        if prefix in ("properties.data", "properties.measurements"):
            grouped.setdefault(prefix, []).append((member, part))
        else:
            kept.append(part)
    for prefix, members in grouped.items():
        if len(members) == 1:
            kept.append(members[0][1])
        else:
            kept.append({prefix: {"$elemMatch": {"$and": [{m: part[f"{prefix}.{m}"]} for m, part in members]}}})
    return kept


def compose_filters(
    rows: Sequence[dict[str, Any]], operands: Sequence[str], brackets: Sequence[int], elem_match: bool = False
) -> dict[str, Any]:
    """One filter document from form rows; AND binds tighter than OR.

    ``operands[i]`` links row ``i`` to the one before it (the first is unused);
    ``brackets[i]`` is the nesting depth 0-3 of row ``i``, a bracket being a run
    of rows deeper than their surroundings.
    """
    if not rows:
        return {}
    if not len(rows) == len(operands) == len(brackets):
        raise ValueError("rows, operands and brackets must have equal lengths")
    terms: list[tuple[str, dict[str, Any]]] = []
    at = 0
    while at < len(rows):
        end = at + 1
        if brackets[at] > 0:
            while end < len(rows) and brackets[end] > 0:
                end += 1
            depths = [depth - 1 for depth in brackets[at:end]]
            terms.append((operands[at], compose_filters(rows[at:end], operands[at:end], depths, elem_match)))
        else:
            terms.append((operands[at], dict(rows[at])))
        at = end
    alternatives: list[list[dict[str, Any]]] = [[terms[0][1]]]
    for operand, term in terms[1:]:
        if operand.upper() == "AND":
            alternatives[-1].append(term)
        else:
            alternatives.append([term])
    joined = []
    for parts in alternatives:
        parts = _same_element(parts) if elem_match and len(parts) > 1 else parts
        joined.append(parts[0] if len(parts) == 1 else {"$and": parts})
    return joined[0] if len(joined) == 1 else {"$or": joined}


def range_or_missing(
    rows: DataFrame, ranges: Mapping[str, tuple[float | None, float | None]], equal: Mapping[str, Any] | None = None
) -> DataFrame:
    """Element rows whose numbers lie in closed ranges or are not given.

    Open ends default to 0 and 999.  ``equal`` holds plain conditions; a list
    there means any of its values.
    """
    condition = F.lit(True)
    for name, (low, high) in ranges.items():
        column = F.col(name)
        inside = column.between(0 if low is None else low, 999 if high is None else high)
        condition = condition & (inside | column.isNull())
    for name, value in (equal or {}).items():
        column = F.col(name)
        condition = condition & (column.isin(list(value)) if isinstance(value, (list, tuple)) else column == value)
    return rows.where(condition)
