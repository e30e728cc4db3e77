"""Display order of report tables (O1–O3).

The reports themselves are unordered (a global sort is a range shuffle
that only presentation needs); these helpers add the order the reference
showed, as the last step before a table is written or displayed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize


def by_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Ascending by group keys: cohort, period, commune, category (O1)."""
    return df.orderBy(*keys)


def by_count_desc(df: DataFrame, count_col: str, *tie: str) -> DataFrame:
    """Most frequent first, ties by key, as ``value_counts`` shows (O2)."""
    return df.orderBy(F.col(count_col).desc(), *tie)


def by_total_asc(df: DataFrame, total_col: str, *tie: str) -> DataFrame:
    """Bars by ascending total (O3)."""
    return df.orderBy(F.col(total_col).asc(), *tie)


def with_position(df: DataFrame, *order, name: str = "position") -> DataFrame:
    """``df`` with each row's place (from 1) in the order shown, as a column that a written table keeps (O1–O3).

    ``order`` names columns, or gives ``F.desc(...)`` and the like; ties go by all columns from the left. Rows are dealt in ranges of the order and
    counted per range; a row's place is the rows of the ranges before plus its place in its own, so no task sorts the
    whole table. The ranges are written to the shared folder first, so that counts and rows are of one and the same dealing.
    """
    spark = df.sparkSession
    place = next(n for n in (f"place{k or ''}" for k in range(len(df.columns) + 1)) if n not in df.columns)
    keys = [F.col(c) if isinstance(c, str) else c for c in order] + [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn(place, F.monotonically_increasing_id())
    dealt = materialize(dealt, "ranked-rows")
    # The id is the task's number times 2^33 plus the row's place in the task.
    dealt = dealt.select("*", F.shiftright(place, 33).alias(f"{place}_range"), F.col(place).bitwiseAND(F.lit((1 << 33) - 1)).alias(f"{place}_row"))
    sizes = dealt.groupBy(f"{place}_range").agg(F.count(F.lit(1)).alias(f"{place}_rows"))
    before = F.sum(f"{place}_rows").over(Window.orderBy(f"{place}_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    sizes = sizes.select(f"{place}_range", F.coalesce(before, F.lit(0)).alias(f"{place}_before"))
    out = dealt.join(sizes, f"{place}_range")
    return out.select(*[f"`{c}`" for c in df.columns], (F.col(f"{place}_before") + F.col(f"{place}_row") + 1).alias(name))


def decimals_as_double(df: DataFrame) -> DataFrame:
    """Money columns as DOUBLE for a report table (exact DECIMAL sums are
    done upstream; a consumer reading through pandas gets floats either way)."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )
