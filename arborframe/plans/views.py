"""Tree collections derived from the benchmark tables.

``relational(spark, dir)``: one tree per order; its scans and measurements are
the order's line items.  The line items are never nested, because one order may
own any share of them.

``order_documents(spark, dir)``: one JSON document per order with up to three
measurements and two scans computed from the order row alone.  The arrays are
bounded by construction and the whole derivation is row-local.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..model import NUMBER, TEXT, ElementField, RelationalDocs
from ..session import scratch_path
from ..sources import writers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(key: Column) -> dict[str, Column]:
    return {
        "lon": (key % 3600 - 1800) / F.lit(10.0),
        "lat": ((key * 7) % 1700 - 850) / F.lit(10.0),
        "elev": F.lit(0.0),
    }


def _tree_id(key: Column) -> Column:
    return F.concat(F.lit("T"), F.lpad(key.cast("string"), 8, "0"))


def relational(spark: SparkSession, sf_dir: str) -> RelationalDocs:
    key = F.col("o_orderkey")
    header = table(spark, sf_dir, "orders").select(
        key.alias("_id_x"),
        F.concat(_tree_id(key), F.lit(".geojson")).alias("_file"),
        _tree_id(key).alias("id"),
        F.col("o_orderpriority").alias("species"),
        F.lit("synthetic").alias("source"),
        *[c.alias(n) for n, c in _place(key).items()],
    )
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    link = F.concat(
        F.lit("https://example.org/t/"),
        F.col("l_orderkey").cast("string"),
        F.lit("_"),
        F.col("l_linenumber").cast("string"),
        F.lit("_"),
        F.col("l_returnflag"),
        F.lit(".laz"),
    )
    data = {
        "type": ElementField(TEXT, F.lit("pointcloud")),
        "mode": ElementField(TEXT, F.col("l_returnflag")),
        "canopy_condition": ElementField(TEXT, F.col("l_linestatus")),
        "quality": ElementField(NUMBER, F.col("l_linenumber")),
        "point_count": ElementField(NUMBER, F.col("l_quantity").cast("bigint")),
        "date": ElementField(TEXT, day, moment=F.col("l_shipdate")),
        "file": ElementField(TEXT, link),
    }
    tall = F.col("l_discount") >= 0.02
    in_a = F.col("l_returnflag") == "A"
    later = F.col("l_linenumber") != 1
    measurements = {
        "source": ElementField(TEXT, F.col("l_returnflag")),
        "date": ElementField(TEXT, day, moment=F.col("l_shipdate")),
        "canopy_condition": ElementField(TEXT, F.when(later, F.col("l_linestatus")), later),
        "DBH_cm": ElementField(NUMBER, F.when(in_a, F.col("l_quantity")), in_a),
        "height_m": ElementField(NUMBER, F.when(tall, F.col("l_extendedprice")), F.lit(True)),
        "mean_crown_diameter_m": ElementField(NUMBER, F.col("l_tax")),
    }
    return RelationalDocs(
        header=header,
        tables={"lines": table(spark, sf_dir, "lineitem")},
        arrays={"properties.data": ("lines", data), "properties.measurements": ("lines", measurements)},
        scalars={path: v for path, v in model.SCALARS.items() if v[1] in header.columns},
        element_key="l_orderkey",
    )


def order_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``_id_x, _file, raw`` plus the order columns used to derive the text."""
    key, cust, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    day = F.col("o_orderdate").cast("date")
    final = F.col("o_orderstatus") == "F"
    kind = F.element_at(F.array(*map(F.lit, ("TLS", "ULS", "ALS"))), (cust % 3 + 1).cast("int"))
    canopy = F.when(key % 2 == 0, "leaf-on").otherwise("leaf-off")
    null_json = F.parse_json(F.lit("null"))

    def iso(date: Column) -> Column:
        return F.date_format(date, "yyyy-MM-dd")

    names = {
        "source": "string",
        "date": "string",
        "canopy_condition": "string",
        "DBH_cm": "double",
        "height_m": "variant",
        "mean_crown_diameter_m": "double",
        "state": "string",
        "crs": "string",
        "position_xyz": "array<double>",
    }

    def measurement(**given: Column) -> Column:
        return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()])

    inventory = measurement(
        source=F.when(cust % 10 != 9, "FI"),
        date=iso(day),
        DBH_cm=F.when(final, price),
        height_m=F.when(cust % 5 == 0, null_json).otherwise(price.cast("variant")),
        state=F.lit("alive"),
    )
    scanned = measurement(
        source=kind,
        date=iso(F.date_add(day, (cust % 300).cast("int"))),
        canopy_condition=canopy,
        height_m=price.cast("variant"),
        mean_crown_diameter_m=F.when(cust % 15 != 0, (cust % 15).cast("double")),
    )
    position = measurement(
        crs=F.lit("epsg:25832"),
        position_xyz=F.array(cust.cast("double"), key.cast("double"), F.lit(0.5)),
    )

    def scan(number: int, mode: Column, date: Column, canopy: Column, points: Column, quality: Column, labels) -> Column:
        return F.struct(
            F.lit("pointcloud").alias("type"),
            mode.alias("mode"),
            iso(date).alias("date"),
            canopy.alias("canopy_condition"),
            F.lit("S1").alias("sensor"),
            points.alias("point_count"),
            F.lit("epsg:25832").alias("crs"),
            F.concat(F.lit("https://example.org/t/"), key.cast("string"), F.lit(f"_{number}.laz")).alias("file"),
            F.lit("https://example.org/m").alias("metadata-url"),
            quality.alias("quality"),
            labels.cast("string").alias("has_labels"),
        )

    first = scan(0, kind, day, canopy, key * 10, cust % 5 + 1, F.lit(None))
    second = scan(
        1, F.lit("ULS"), F.date_add(day, 30), F.lit("leaf-off"), cust, key % 5 + 1, F.when(key % 3 == 0, "true")
    )
    text = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(
                _tree_id(key).alias("id"),
                F.col("o_orderpriority").alias("species"),
                F.lit("synthetic").alias("source"),
                F.array_compact(F.array(inventory, scanned, F.when(key % 4 != 3, position))).alias("measurements"),
                F.array(F.struct(F.lit("https://example.org/ref").alias("reference-url"))).alias("measurements_metadata"),
                F.array_compact(F.array(F.when(cust % 7 != 6, first), F.when(~final, second))).alias("data"),
            ).alias("properties"),
            F.struct(
                F.lit("Point").alias("type"), F.array(*_place(key).values()).alias("coordinates")
            ).alias("geometry"),
        )
    )
    return table(spark, sf_dir, "orders").select(
        key.alias("_id_x"),
        F.concat(_tree_id(key), F.lit(".geojson")).alias("_file"),
        F.lit("2024-01-01T00:00:00").alias("_date"),
        text.alias("raw"),
        "o_orderstatus",
    )


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.documents(order_text(spark, sf_dir).drop("o_orderstatus"))


_STORED: dict[tuple[str, str], str] = {}  # (application, folder of the tables) to the stored table


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a table, written once per application, for queries that read them more than once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = scratch_path(spark, "trees")
        writers.save_table(order_text(spark, sf_dir), path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])
