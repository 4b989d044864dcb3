"""Small helpers shared by the operators."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that tasks can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_arborframe_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="run-")) / "arborframe.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._arborframe_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str | Column) -> Column:
    """The text as UTF-8 bytes, empty for null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column, F.lit("")).cast("binary")


def in_fold(doc_id: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def keep_ids(docs: DataFrame, kept: DataFrame, how: str = "left_semi", id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is (``left_semi``) or is not (``left_anti``) in ``kept``; null ids compare equal."""
    marked = kept.select(F.col(id_col).alias("__kept_id"))
    return docs.join(marked, docs[id_col].eqNullSafe(marked["__kept_id"]), how)


def open_store(uri: str):
    """File system and path of a shared folder, for tasks."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)
