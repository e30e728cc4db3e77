"""Keep-first / keep-last per key.

"First" in the reference is file row order, which a distributed table
does not have; every call therefore names an explicit, total ``order_by``.

Implemented as an aggregate (``min_by`` / ``max_by`` over a struct of the
row), not as ``row_number()`` over a window: the aggregate combines
map-side, so a key that holds a third of all rows is reduced to one row
per input partition before the shuffle, while a window would sort the
whole key in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], last: bool) -> DataFrame:
    if not order_by:
        raise ValueError("order_by is required: 'first' must be defined by columns")
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest]) if rest else F.lit(None)
    order = F.struct(*[F.col(c) for c in order_by])
    agg = F.max_by(row, order) if last else F.min_by(row, order)
    out = df.groupBy(*keys).agg(agg.alias("_row"))
    return out.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def keep_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the smallest by ``order_by``."""
    return _pick(df, keys, order_by, last=False)


def keep_last(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the largest by ``order_by`` (D3)."""
    return _pick(df, keys, order_by, last=True)


def distinct_ids(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of one column."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct()
