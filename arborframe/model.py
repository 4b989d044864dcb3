"""Data model: tree documents as Spark columns.

A *document* is one GeoJSON Feature.  Two layouts are supported, both lazily
evaluated DataFrames:

``columnar documents``
    one row per document.  Scalars are plain columns; every nested array is a
    *struct of arrays* (``data.mode ARRAY<STRING>``, ``data.quality
    ARRAY<DOUBLE>`` ...) so a predicate on one nested key makes Parquet read
    that leaf only, which an array of structs would not allow.  ``doc`` is the
    lossless VARIANT used for keys outside the typed set, ``raw`` the original
    text.  Filters on this layout are narrow: no shuffle at all.

``relational documents`` (:class:`RelationalDocs`)
    a header table plus one element table per array, the shape in which the
    data arrives from relational systems.  It is never nested: a document may
    own any share of the rows, and predicates are pre-aggregated to flags.
"""

from __future__ import annotations

import operator
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT, NUMBER, FLAG = "text", "number", "flag"

# The keys of a document that get a typed column, and their types.
MEASUREMENT_FIELDS = {
    "source": TEXT,
    "date": TEXT,
    "canopy_condition": TEXT,
    "DBH_cm": NUMBER,
    "height_m": NUMBER,
    "crown_base_height_m": NUMBER,
    "crown_base_height_green_m": NUMBER,
    "mean_crown_diameter_m": NUMBER,
    "crown_projection_area_convex_hull_m2": NUMBER,
    "crown_projection_area_concave_hull_m2": NUMBER,
    "state": TEXT,
    "crs": TEXT,
}
DATA_FIELDS = {
    "type": TEXT,
    "mode": TEXT,
    "date": TEXT,
    "canopy_condition": TEXT,
    "sensor": TEXT,
    "point_count": NUMBER,
    "crs": TEXT,
    "file": TEXT,
    "metadata-url": TEXT,
    "quality": NUMBER,
    "has_labels": TEXT,
}
ARRAYS = {
    "properties.measurements": ("measurements", MEASUREMENT_FIELDS),
    "properties.data": ("data", DATA_FIELDS),
}
SCALARS = {
    "_id_x": (NUMBER, "_id_x"),
    "_file": (TEXT, "_file"),
    "_date": (TEXT, "_date"),
    "type": (TEXT, "type"),
    "properties.id": (TEXT, "id"),
    "properties.species": (TEXT, "species"),
    "properties.source": (TEXT, "source"),
    "geometry.type": (TEXT, "geom_type"),
}
METADATA = ("_id_x", "_date", "_file")

# Leaf paths every importable document must have.
REQUIRED_LEAVES = (
    "type",
    "properties_id",
    "properties_source",
    "properties_species",
    "properties_measurements_0_source",
    "properties_measurements_0_date",
    "properties_data_0_type",
    "properties_data_0_mode",
    "properties_data_0_file",
    "properties_data_0_date",
    "properties_data_0_canopy_condition",
    "properties_data_0_point_count",
    "properties_data_0_metadata-url",
    "properties_data_0_crs",
    "properties_data_0_quality",
    "geometry_type",
    "geometry_coordinates_0",
    "geometry_coordinates_1",
    "geometry_coordinates_2",
)

_NUMERIC_TYPES = "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"


# ---------------------------------------------------------------- VARIANT helpers
def child(value: Column, key: str) -> Column:
    """Value under ``key`` of a VARIANT object; SQL NULL when the key is absent."""
    if '"' in key:
        raise ValueError(f"unsupported character in key: {key!r}")
    return F.try_variant_get(value, f'$["{key}"]', "variant")


def descend(value: Column, path: str) -> Column:
    """Value under a dotted path of objects (no array fan-out)."""
    steps = path.split(".")
    if any('"' in step for step in steps):
        raise ValueError(f"unsupported character in path: {path!r}")
    return F.try_variant_get(value, "$" + "".join(f'["{step}"]' for step in steps), "variant")


def as_array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def as_map(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def typed(value: Column, kind: str) -> Column:
    """VARIANT to a typed value; NULL unless the stored JSON type is ``kind``."""
    stored = F.schema_of_variant(value)
    if kind == TEXT:
        return F.when(stored == "STRING", F.try_variant_get(value, "$", "string"))
    if kind == NUMBER:
        return F.when(stored.rlike(_NUMERIC_TYPES), F.try_variant_get(value, "$", "double"))
    return F.when(stored == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))


# ---------------------------------------------------------------- columnar documents
def computed_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters and projections refer to but never repeat.

    Catalyst copies the definition of a projected column into every filter it
    pushes down, so an expensive one would be evaluated many times per row; it
    does not look inside a generator.  The one-element explode keeps each row.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))


_SPARK_TYPES = {TEXT: "string", NUMBER: "double"}


def _members(fields: Mapping[str, str]) -> str:
    return ", ".join(f"`{name}`: {_SPARK_TYPES[kind]}" for name, kind in fields.items())


_TYPED_PARSE = (
    "type string, properties struct<id: string, species: string, source: string, "
    + ", ".join(f"{column}: array<struct<{_members(fields)}>>" for column, fields in ARRAYS.values())
    + ">, geometry struct<type: string, coordinates: array<double>>"
)
_KEYS_PARSE = "properties struct<" + ", ".join(f"{c}: array<map<string, string>>" for c, _ in ARRAYS.values()) + ">"
_TEXT_KEYS = sorted({"type", "id", "species"} | {n for _, f in ARRAYS.values() for n, k in f.items() if k == TEXT})
# A colon that follows a text key (or much white space) and precedes something other than text or null.
_MISTYPED_TEXT = rf':(?:(?<=\s{{9}}:)|(?=\s*+[^"n\s])(?<="(?:{"|".join(_TEXT_KEYS)})"\s{{0,9}}:))'
_ASCII_ESCAPE = r"\\u00[2-7]"  # could spell a key differently
_NUMBER_WORDS = ("NaN", "INF", "Infinity")


def _needs_care(raw: Column) -> Column:
    """Text that a typed JSON parse may read differently from the document's own types."""
    words = [raw.contains(f'{word}"') for word in _NUMBER_WORDS]
    escaped = raw.contains("\\u00") & raw.rlike(_ASCII_ESCAPE)
    return reduce(operator.or_, [*words, escaped, raw.rlike(_MISTYPED_TEXT)])


def _variant_array(path: str) -> Column:
    return F.try_variant_get(F.col("doc"), f"$.{path}", "array<variant>")


def parsed(raw: DataFrame) -> DataFrame:
    """Add only the VARIANT ``doc``; unparseable text yields NULL."""
    return computed_once(raw, "doc", F.try_parse_json("raw"))


def documents(raw: DataFrame) -> DataFrame:
    """Columnar documents from a DataFrame with a ``raw`` JSON text column.

    Other columns (``_id_x``, ``_file``, ``_date`` ...) are carried along.
    Meant to be stored: the derivation costs far more than any later query.

    A typed column only holds values of its own JSON type.  Where one typed
    parse of the text provably respects that, its result is used; documents
    with unusual types or shapes are read value by value from the VARIANT.
    """
    doc, plain_places = F.col("doc"), F.col("_typed.geometry.coordinates")
    regular = doc.isNotNull() & ~_needs_care(F.col("raw"))
    for path in ("geometry.coordinates", *ARRAYS):  # an array with odd members comes back as NULL
        regular = regular & (F.col(f"_typed.{path}").isNotNull() | descend(doc, path).isNull())
    rows = computed_once(parsed(raw), "_typed", F.from_json("raw", _TYPED_PARSE))
    rows = computed_once(rows, "_regular", regular)
    maps = [
        F.when(~F.col("_regular"), F.transform(_variant_array(path), as_map)).alias(column)
        for path, (column, _) in ARRAYS.items()
    ]
    rows = computed_once(rows, "_maps", F.struct(*maps))
    rows = computed_once(rows, "_named", F.when(F.col("_regular"), F.from_json("raw", _KEYS_PARSE)))

    def either(plain: Column, careful: Column) -> Column:
        return F.when(F.col("_regular"), plain).otherwise(careful)

    def member(path: str, name: str, kind: str) -> Column:
        careful = F.transform(
            F.col(f"_maps.{ARRAYS[path][0]}"), lambda m: typed(F.try_element_at(m, F.lit(name)), kind)
        )
        return either(F.col(f"_typed.{path}.`{name}`"), careful).alias(name)

    def keys(path: str) -> Column:
        plain, careful = F.col(f"_named.{path}"), F.col(f"_maps.{ARRAYS[path][0]}")
        return either(F.transform(plain, lambda m: F.map_keys(m)), F.transform(careful, lambda m: F.map_keys(m))).alias("_keys")

    columns = {
        column: either(F.col(f"_typed.{path}"), typed(descend(F.col("doc"), path), kind))
        for path, (kind, column) in SCALARS.items()
        if path not in METADATA
    }
    for i, name in enumerate(("lon", "lat", "elev")):
        careful = typed(F.get(_variant_array("geometry.coordinates"), i), NUMBER)
        columns[name] = either(F.get(plain_places, i), careful)
    for path, (column, fields) in ARRAYS.items():
        columns[column] = F.struct(keys(path), *[member(path, n, k) for n, k in fields.items()])
    columns[SHAPE], columns[POSITION] = _shape(child(doc, "properties")), _last_position(doc)
    return rows.withColumns(columns).drop("_typed", "_regular", "_maps", "_named")


# The keys of ``properties`` and the last measured position, which questions about
# keys and the relational view read in place of the VARIANT.
SHAPE, POSITION = "_shape", "_position"


def _shape(properties: Column) -> Column:
    """Sorted keys as one JSON text; after a star those of an array's members.

    There are few different ones, so that Parquet stores each once per row group
    and a short number per document.
    """

    def text(keys: Column) -> Column:
        return F.to_json(F.array_sort(F.array_distinct(keys)))

    none = F.array().cast("array<string>")
    members = F.flatten(F.transform(as_array(properties), lambda v: F.coalesce(F.map_keys(as_map(v)), none)))
    return F.coalesce(text(F.map_keys(as_map(properties))), F.concat(F.lit("*"), text(members)))


def shape_holds(name: str) -> Column | None:
    """Whether ``properties`` has this key, from its shape; ``None`` for names that it may spell in another way."""
    if name.isdigit() or not name or any(c in '"\\/' or ord(c) < 32 or ord(c) == 127 for c in name):
        return None
    return F.coalesce(F.col(SHAPE).contains(f'"{name}"'), F.lit(False))


def _last_position(doc: Column) -> Column:
    """``x, y, z, crs`` of the last measurement with a position."""
    last = F.try_element_at(F.filter(_variant_array("properties.measurements"), lambda e: child(e, "position_xyz").isNotNull()), F.lit(-1))
    place = [F.try_variant_get(last, f"$.position_xyz[{i}]", "double").alias(n) for i, n in enumerate("xyz")]
    found = F.struct(*place, F.try_variant_get(last, "$.crs", "string").alias("crs"))
    mentioned = F.col("raw").contains("position_xyz") | F.col("raw").contains("\\u")
    return F.when(mentioned & last.isNotNull(), found)


def elements(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """One row per array element of columnar documents: ``pos`` plus typed fields.

    Row-local (no shuffle); ``keep`` are document columns carried along.
    """
    column, fields = ARRAYS[path]
    zipped = F.arrays_zip(*[F.col(f"{column}.`{name}`") for name in ("_keys", *fields)])
    exploded = docs.select(*keep, F.posexplode(zipped).alias("pos", "e"))
    return exploded.select(*keep, "pos", *[F.col(f"e.`{name}`").alias(name) for name in ("_keys", *fields)])


def variant_elements(docs: DataFrame, path: str, *keep: str | Column) -> DataFrame:
    """One row per array element as ``pos, element VARIANT`` (all keys kept)."""
    values = F.try_variant_get(F.col("doc"), f"$.{path}", "array<variant>")
    return docs.select(*keep, F.posexplode(values).alias("pos", "element"))


# ---------------------------------------------------------------- relational documents
@dataclass(frozen=True)
class ElementField:
    """Typed column of an element table; ``present`` says whether the key exists.

    ``moment`` is the DATE or TIMESTAMP column behind a ``Y-M-D`` text, if there is
    one: date ranges compare it as it is stored, so that they reach the scan.
    """

    kind: str
    value: Column
    present: Column | None = None
    moment: Column | None = None

    def has(self) -> Column:
        return self.value.isNotNull() if self.present is None else self.present


@dataclass(frozen=True)
class RelationalDocs:
    """Header rows plus element rows sharing the document key.

    ``arrays`` maps an array path to ``(table name, fields)``; two arrays may be
    served by the same physical table, which is then scanned once per filter.
    """

    header: DataFrame
    tables: Mapping[str, DataFrame]
    arrays: Mapping[str, tuple[str, Mapping[str, ElementField]]]
    scalars: Mapping[str, tuple[str, str]] = field(default_factory=lambda: SCALARS)
    key: str = "_id_x"
    element_key: str = "_id_x"

    def rows(self, path: str) -> DataFrame:
        """Element rows of one array, ``_id_x`` plus the typed fields by name."""
        table, fields = self.arrays[path]
        return self.tables[table].select(
            F.col(self.element_key).alias(self.key), *[f.value.alias(name) for name, f in fields.items()]
        )
