"""Writers and export views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import model
from ..functions import archives, scalars, workers
from ..session import saved


def doc_json(docs: DataFrame, metadata: bool = False, indent: int | None = None) -> DataFrame:
    """``_id_x, json``: the original text, optionally with metadata and indentation."""
    text = F.col("raw")
    if metadata:
        extra = F.expr("substring(to_json(struct(_file, _id_x, _date)), 2)")
        body = F.regexp_replace("raw", r"\s*\}\s*$", "")
        text = F.concat(body, F.when(F.trim(body) == "{", "").otherwise(","), extra)
    if indent is not None:
        text = F.pandas_udf(workers.indented(indent), "string")(text)
    return docs.select("_id_x", text.alias("json"))


def save_dump(docs: DataFrame, path: str) -> None:
    """Whole collection as gzip JSON lines, metadata included.

    Line breaks of pretty-printed documents become blanks; JSON has them between
    tokens only.
    """
    one_line = F.regexp_replace("json", r"[\r\n]+", " ").alias("json")
    doc_json(docs, metadata=True).select(one_line).write.mode("overwrite").option("compression", "gzip").text(path)


def save_arrays(docs: DataFrame, path: str, files: int | None = None) -> DataFrame:
    """Whole collection as compressed JSON arrays, metadata included, in id order over the part files.

    Returns the files written; as each is written whole, a part is best kept to some 100 MB.
    """
    order = ["_id_x", "raw"]
    archives.clear_parts(path, ".db")
    placed = docs.repartitionByRange(files, *order) if files else docs.repartitionByRange(*order)
    texts = doc_json(placed.sortWithinPartitions(*order), metadata=True).select(F.lit("").alias("name"), F.col("json").alias("text"))
    return saved(texts.mapInArrow(archives.write_arrays(path), archives.WRITTEN), "written")


def save_archives(docs: DataFrame, path: str, files: int | None = None) -> DataFrame:
    """Document texts as ZIP archives, one per partition; returns the files written."""
    order = ["_id_x", "raw"]
    archives.clear_parts(path, ".zip")
    placed = docs.repartitionByRange(files, *order) if files else docs.repartitionByRange(*order)
    texts = placed.select(F.concat(F.lit("trees/"), "_file").alias("name"), F.col("raw").alias("text")).where("_file IS NOT NULL AND raw IS NOT NULL")
    return saved(texts.mapInArrow(archives.write_zips(path), archives.WRITTEN), "written")


def save_table(docs: DataFrame, path: str) -> None:
    """Whole collection (columnar, or just its text) as Parquet, sorted so that species and place skip row groups.

    Only the text is shuffled, next to a light parse of its sort keys; the
    typed columns are derived afterwards, when the rows are where they belong.
    The id ends the sort key, so a place with very many trees is split too.
    """
    keys = F.from_json("raw", "properties struct<species: string>, geometry struct<coordinates: array<double>>")
    text = model.computed_once(docs.select("_id_x", "_file", "_date", "raw"), "_keys", keys)
    layout = [
        F.col("_keys.properties.species"),
        *[F.get("_keys.geometry.coordinates", i) for i in (0, 1)],
        F.col("_id_x"),
    ]
    placed = text.repartitionByRange(*layout).sortWithinPartitions(*layout).drop("_keys")
    model.documents(placed).write.mode("overwrite").parquet(path)


def restrict(docs: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Documents whose ``_id_x`` is in ``ids``; ``None`` means all, an empty list none."""
    return docs if ids is None else docs.join(ids.select("_id_x"), "_id_x", "left_semi")


def export_docs(docs: DataFrame, outdir: str, ids: DataFrame | None = None) -> DataFrame:
    """One GeoJSON file per document below a shared folder; rows are the files written.

    Of documents sharing a file name the one with the highest id is written,
    which is what writing them in id order would leave behind. A text that is
    not JSON is written as it is.
    """
    last = F.max_by(F.struct("_id_x", "raw"), "_id_x").alias("d")
    unique = restrict(docs, ids).where(F.col("_file").isNotNull()).groupBy("_file").agg(last)
    rows = unique.select("d._id_x", "_file", "d.raw")
    return rows.mapInArrow(workers.write_files(outdir), "_id_x long, _file string, path string")


def feature_collection(docs: DataFrame, metadata: bool = False) -> DataFrame:
    """Lines ``(kind, _id_x, line)`` of one FeatureCollection text, to be written in order of kind and id.

    The envelope is a first and a last line of its own, so an empty result is an
    empty collection and repeated ids are ordinary features.  Every feature but
    the first brings the comma before it. With ``metadata`` a feature carries
    ``_id_x``, ``_date`` and ``_file`` as well.
    """
    if metadata:
        docs = doc_json(docs, metadata=True).withColumnRenamed("json", "raw")
    low = docs.agg(F.min("_id_x")).scalar()
    rows = docs.select("_id_x", "raw")
    least = rows.where(F.col("_id_x") == low)
    copy = F.row_number().over(Window.partitionBy("_id_x").orderBy("raw"))
    first = least.select("_id_x", F.concat(F.when(copy == 1, "").otherwise(","), "raw").alias("line"))
    rest = rows.where(F.col("_id_x") > low).select("_id_x", F.concat(F.lit(","), "raw").alias("line"))
    body = first.unionByName(rest).select(F.lit(1).alias("kind"), "_id_x", "line")
    envelope = docs.sparkSession.createDataFrame(
        [(0, None, '{"type":"FeatureCollection","features":['), (2, None, "]}")], "kind int, _id_x long, line string"
    )
    return body.unionByName(envelope)


def write_feature_collection(docs: DataFrame, path: str, metadata: bool = False) -> None:
    """Part files which, concatenated in name order, are one FeatureCollection."""
    lines = feature_collection(docs, metadata).orderBy("kind", "_id_x", F.desc("line"))  # of one id, the line without comma first
    lines.select("line").write.mode("overwrite").text(path)


def link_manifest(links: DataFrame, url: str = "file") -> DataFrame:
    """Links with the name each download is stored under."""
    return links.withColumn("filename", scalars.url_filename(F.col(url)))


def write_link_list(links: DataFrame, path: str, url: str = "file") -> DataFrame:
    """Comma-joined URLs in document order, as the bulk download script splits them.

    The part files concatenate, in name order, to one list without a comma at
    either end. Links are ordered by their document, their place in it if there
    is a ``pos``, and the URL; null ones are left out. Returns the files.
    """
    archives.clear_parts(path, ".txt")
    order = [c for c in ("_id_x", "pos") if c in links.columns] + [url]
    # The first range of a range partitioning always holds the least row.
    texts = links.where(F.col(url).isNotNull()).orderBy(*order).select(F.lit("").alias("name"), F.col(url).alias("text"))
    return saved(texts.mapInArrow(archives.write_joined(path, ".txt", ","), archives.WRITTEN), "written")


def write_csv(table: DataFrame, path: str, none_str: str = "") -> None:
    """CSV with a header; values holding a comma or quote are quoted."""
    table.write.mode("overwrite").option("header", True).option("nullValue", none_str).option(
        "emptyValue", ""
    ).option("escape", '"').csv(path)


def fingerprint(text: Column) -> Column:
    """SHA-1 of a document text, for change detection."""
    return F.sha1(text.cast("binary"))
