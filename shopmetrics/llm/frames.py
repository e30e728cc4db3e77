"""Helpers shared by the operators: row keys, written intermediates, Arrow text views."""

from __future__ import annotations

import os
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmetrics.session import discard, materialize, scratch_path, shared_dir

__all__ = [
    "ASCII_UPPER", "ASCII_LOWER", "ascii_lower", "row_key", "discard", "materialize", "scratch_path", "shared_dir",
    "free_name", "shuffle_width", "utf8_view", "python_ready", "read_table",
]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def row_key(id_col: Column, text_digest: Column) -> Column:
    """A non-null key of one row: its id (null included) and a digest of its text.

    Rows that repeat an id with another text keep apart; rows that repeat both
    are the same row several times.
    """
    return F.concat(F.when(id_col.isNull(), F.lit("n")).otherwise(F.lit("v")), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), text_digest)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with a number if ``df`` has a column of that name already (in any case)."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"{name}{k or ''}" for k in range(len(taken) + 1)) if n.lower() not in taken)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions to deal packed rows to; follows the session's setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application, so that their Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="shopmetrics-code-"), f"{os.path.basename(top)}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def python_ready(spark: SparkSession, rows: int = 1000) -> None:
    """For operators with Python code: send it along, and keep Arrow batches small, since a row holds a whole text."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch as one byte array, and where each begins (one more entry than rows).

    A null is an empty text. No Python object is made for any text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]
