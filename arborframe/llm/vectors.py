"""Vector tables: which rows take part, and block joins of a query set with all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A block of vectors takes about this many bytes in a task.
BLOCK_BYTES = 8 << 20


def finite(vector: str) -> Column:
    """True for a vector without a null, an infinite component or a NaN."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, width: int, dtype=np.float64) -> np.ndarray:
    """The vectors of a list column as rows; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), dtype=dtype)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def block_rows(width: int) -> int:
    """Rows to a block: 64 at least and 8,192 at most."""
    return max(64, min(8192, BLOCK_BYTES // (8 * max(1, width))))


def block_count(rows: int, size: int, least: int = 1) -> int:
    """Blocks of at most ``size`` rows on average; ``least`` of them if there are rows for that."""
    return max(1, -(-rows // size), min(least, rows // 64))


def in_cells(table: DataFrame, own: Column, columns: int, queries: DataFrame, number: Column, lines: int):
    """Both sides of a block join, grouped by cell.

    Block ``own`` of the table meets block ``number`` of the queries in one
    cell. The table is sent once per block of queries and the queries once
    per block of the table, so that a task never holds more than one block of
    either, whatever their keys are.
    """
    left = table.withColumn("__line", F.explode(F.sequence(F.lit(0), F.lit(lines - 1)))).withColumn("__cell", own * lines + F.col("__line"))
    right = queries.withColumn("__column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))).withColumn("__cell", F.col("__column") * lines + number)
    return left.drop("__line").groupBy("__cell").cogroup(right.drop("__column").groupBy("__cell"))
