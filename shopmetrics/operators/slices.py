"""Row slices used by every report.

One general ``slice_rows`` replaces the reference's four copies of the
same filter function; ``None`` means "all" where the reference used the
sentinel labels. Predicates are plain comparisons on input columns, so
Catalyst pushes them to the Parquet scan.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timefn import to_ts_literal


def _bound(df: DataFrame, date_col: str, value):
    """Literal for a bound, typed like the column.

    The reference compares to midnight of the bound day (T6): for a
    timestamp column a row later on the end day is outside the range.
    """
    dtype = df.schema[date_col].dataType
    if isinstance(dtype, T.DateType):
        if isinstance(value, _dt.datetime):
            value = value.date()
        return F.to_date(F.lit(str(value)[:10]))
    return to_ts_literal(value)


def slice_rows(
    df: DataFrame,
    equals: Mapping[str, object] | None = None,
    date_col: str | None = "date",
    start=None,
    end=None,
) -> DataFrame:
    """Equality filters (skipped when the value is ``None``) plus an
    inclusive date range (F8–F11, F13, F18, Z5, Z7). Rows with a NULL date
    fall out of a bounded range, as NaT does in the reference."""
    out = df
    for column, value in (equals or {}).items():
        if value is not None:
            out = out.filter(F.col(column) == F.lit(value))
    if date_col is not None:
        if start is not None:
            out = out.filter(F.col(date_col) >= _bound(df, date_col, start))
        if end is not None:
            out = out.filter(F.col(date_col) <= _bound(df, date_col, end))
    return out


def drop_null_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Drop rows whose key is NULL (F7; the stated intent of the reference, T3)."""
    return df.dropna(subset=list(keys))


def since(df: DataFrame, start, date_col: str = "date") -> DataFrame:
    """Lower date bound only."""
    return slice_rows(df, None, date_col, start, None)


def default_range(df: DataFrame, as_of, date_col: str = "date") -> DataFrame:
    """Default report range (F19, A16): 1 January of the year of
    ``as_of - 365 days`` up to the last date in the data (one row)."""
    as_of_ts = to_ts_literal(as_of)
    start = F.make_date(F.year(F.date_sub(F.to_date(as_of_ts), 365)), F.lit(1), F.lit(1))
    return df.agg(
        F.first(start).alias("start_date"),
        F.to_date(F.max(date_col)).alias("end_date"),
    )


def choices(df: DataFrame, column: str, all_label: str = "all") -> DataFrame:
    """Filter choices for a column: an 'all' entry, then each distinct value,
    NULL included (F20, F21). ``ord`` gives the display order."""
    values = df.select(F.col(column).cast("string").alias("value")).distinct()
    spark = df.sparkSession
    head = spark.createDataFrame([(0, all_label)], "ord int, value string")
    return head.unionByName(values.select(F.lit(1).alias("ord"), "value"))
