"""Small column expressions shared by importers and exporters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INTEGER = r"^\s*[+-]?\d+\s*$"


def number(text: Column) -> Column:
    """Text to DOUBLE; NULL if it is not a plain decimal number."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def leading_integer(text: Column, unit: str) -> Column:
    """``"62 cm"`` to 62; NULL if the part before the unit is not an integer."""
    head = F.get(F.split(text, unit, -1), 0)
    return F.when(head.rlike(_INTEGER), F.trim(head).try_cast("int"))


def range_midpoint(text: Column) -> Column:
    """``"11-15m"`` to 13.0: mean of the two bounds before a one-letter unit."""
    bounds = F.split(F.left(text, F.length(text) - 1), "-")
    return (number(F.get(bounds, 0)) + number(F.get(bounds, 1))) / 2.0


def wkt_point(text: Column) -> tuple[Column, Column]:
    """``"POINT (16.37 48.21)"`` to lon and lat; NULLs if it does not parse."""
    pattern = r"\(\s*([^\s()]+)\s+([^\s()]+)"
    found = text.rlike(pattern)
    return tuple(F.when(found, number(F.regexp_extract(text, pattern, i))) for i in (1, 2))


def url_filename(url: Column) -> Column:
    """Last segment of the URL path (query and fragment are not part of it)."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), url)
    return F.element_at(F.split(path, "/"), -1)


def lenient_date(text: Column) -> Column:
    """``Y-M-D`` with any digit counts to DATE; anything else, or no such day, to NULL."""
    pattern = r"^\s*(\d{1,4})\s*-\s*(\d{1,9})\s*-\s*(\d{1,9})\s*(-.*)?$"
    year, month, day = (F.regexp_extract(text, pattern, i).try_cast("int") for i in (1, 2, 3))
    iso = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.when(text.rlike(pattern) & (year > 0), iso.try_cast("date"))
