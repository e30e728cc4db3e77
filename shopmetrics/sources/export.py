"""Report export.

The reference produced one spreadsheet per report in memory for a
download button. Here a report is written as a table: CSV with a header
(the spreadsheet replacement) or Parquet, by the executors in parallel,
never gathered on the driver.
"""

from __future__ import annotations

import os
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _numeric_text(df: DataFrame, places: dict[str, int]) -> DataFrame:
    """The named fractional columns as fixed-decimal text."""
    cols = []
    for f in df.schema.fields:
        decimals = places.get(f.name)
        if decimals is None:
            cols.append(F.col(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.format_string(f"%.{decimals}f", F.col(f.name)).alias(f.name))
        elif isinstance(f.dataType, T.DecimalType):
            # exact: round the decimal itself (format_string takes no DECIMAL)
            cols.append(F.col(f.name).cast(f"decimal(38,{decimals})").cast("string").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_report(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    index_cols: tuple[str, ...] = (),
    decimals: dict[str, int] | None = None,
    mode: str = "overwrite",
) -> None:
    """Write a report table.

    ``index_cols`` move to the front (the spreadsheet index). Values are
    written in full; with CSV, ``decimals`` names columns to write with a fixed
    number of places, and quotes are doubled inside quoted cells, as ``read_csv_table`` and spreadsheets read them.
    """
    ordered = [*index_cols, *[c for c in df.columns if c not in index_cols]]
    out = df.select(*ordered)
    writer_df = _numeric_text(out, decimals) if (fmt == "csv" and decimals) else out
    w = writer_df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")


NO_FILTER = "all"


def _path_text(value) -> str:
    """A value as a path part that no other value has: percent-encoded, and a
    value that reads like the mark of no filter is encoded too."""
    if value is None:
        return NO_FILTER
    text = quote(str(value), safe="")
    return f"%{ord(text[0]):02X}{text[1:]}" if text in (NO_FILTER, ".", "..") else text


def report_path(base: str, report: str, days=None, **filters) -> str:
    """Output location named after the filter values (S9), e.g.
    ``base/orders/origin=Local/category=all/start=1998-01-01``."""
    parts = [base.rstrip("/"), report]
    for key, value in filters.items():
        parts.append(f"{key}={_path_text(value)}")
    if days is not None:
        parts.append(f"days={_path_text(days)}")
    return os.path.join(*parts)


def write_segments(segments: DataFrame, path: str, segment_col: str = "segment", mode: str = "overwrite") -> None:
    """Write a long ``(segment, …)`` table with one folder per segment (S10),
    so one segment is selected by partition pruning on read."""
    segments.write.mode(mode).partitionBy(segment_col).parquet(path)


def read_segment(spark, path: str, segment: str, segment_col: str = "segment") -> DataFrame:
    """One segment back from ``write_segments`` output (partition pruned)."""
    return spark.read.parquet(path).filter(F.col(segment_col) == segment)
