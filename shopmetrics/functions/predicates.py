"""Null-aware predicates and id helpers."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..vocab import COMPLETED, NOT_COMPLETED

def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def not_in_null_safe(c, values: Iterable) -> Column:
    """``NOT c IN (values)`` that keeps NULL rows, as pandas ``~isin`` does (T4)."""
    vals = list(values)
    if not vals:
        return F.lit(True)
    return ~F.coalesce(_col(c).isin(vals), F.lit(False))


def in_or_all(c, values) -> Column:
    """Membership with an 'all' sentinel: ``None`` (or empty) disables it (F16)."""
    if values is None:
        return F.lit(True)
    if isinstance(values, str):
        values = [values]
    vals = list(values)
    if not vals:
        return F.lit(True)
    return _col(c).isin(vals)


def id_text(df: DataFrame, column: str) -> Column:
    """An id column as text whatever its stored type.

    Floating ids go through DECIMAL(38,0) first: cast straight to text, a
    large double prints in scientific notation (``1.23456789012E11``).
    Text ids pass through (a ``.0`` suffix is removed by ``strip_float_suffix``).
    """
    dtype = df.schema[column].dataType
    col = F.col(column)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return col.cast("decimal(38,0)").cast("string")
    return col.cast("string")


def require_columns(df: DataFrame, columns: Iterable[str], what: str) -> None:
    """Fail early, naming every missing column of an input table."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks column(s): {', '.join(missing)}")


def strip_float_suffix(c) -> Column:
    """Drop a trailing ``.0`` that float-typed id columns leave in text."""
    return F.regexp_replace(_col(c), r"\.0$", "")


def strip_list_marks(c) -> Column:
    """``['a', "b"]`` → ``a, b``: remove brackets, then quotes."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"\[|\]", ""), "['\"]", "")


def fold_status(c, done: str = COMPLETED, other: str = NOT_COMPLETED) -> Column:
    """Two-value status; NULL falls to ``other``."""
    return F.when(_col(c) == done, F.lit(done)).otherwise(F.lit(other))


INLINE_IDS = 1000


def exclude_ids(df: DataFrame, column: str, ids) -> DataFrame:
    """Drop rows whose ``column`` is in ``ids``; NULL keys are kept.

    ``ids`` is a Python collection or a one-column DataFrame. Up to ``INLINE_IDS`` listed ids are a predicate of the scan's
    stage, without a join. A longer list is a relation of known size, and a DataFrame is one of its own size; rows meet it in
    one left anti join, whose strategy Catalyst picks by that size. A NULL key never matches, so it is kept, like ``~isin``.
    """
    if ids is None:
        return df
    if not isinstance(ids, DataFrame):
        vals = sorted({str(v) for v in ids})
        if len(vals) <= INLINE_IDS:
            return df.filter(not_in_null_safe(column, vals)) if vals else df
        ids = df.sparkSession.createDataFrame(pa.table({"id": pa.array(vals, pa.string())}))
    other = ids.select(F.col(ids.columns[0]).alias(column)).where(F.col(column).isNotNull())
    return df.join(other, on=column, how="left_anti")
