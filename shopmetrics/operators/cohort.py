"""Monthly cohort retention.

Plan shape: slice → one plain hash aggregate per customer that keeps the active months as bits of a BIGINT
(``bit_or``, combined map-side) → cohort = lowest bit → per cohort one sum for each month bit (a few rows per
task leave the map side) → the sums unpivoted to long form. A range of over 63 months adds the number of the 63-month
word to the group, and the cohort is the smallest over a customer's words.

``month_sketches`` is the approximate form: one mergeable distinct-count sketch per month, origin and category, stored
once; ``cohort_counts_estimate`` answers any slice from them without reading orders.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.textfmt import half_even_ratio, fixed2_text
from ..functions.timefn import month_diff, month_label, month_start
from ..vocab import COMPLETED
from .slices import drop_null_keys, slice_rows

WORD = 63  # months of one BIGINT; the sign bit stays free
EPOCH = dt.date(1970, 1, 1)
SKETCH_LG = 12


def cohort_counts(
    orders: DataFrame,
    origin: str | None = None,
    category: str | None = None,
    start=None,
    end=None,
    status: str = COMPLETED,
) -> DataFrame:
    """``cohort date, period_number int, n_customers bigint``.

    The cohort is the first month *inside the slice* (T10): filter first,
    then take the minimum.
    """
    sl = slice_rows(orders, {"origin": origin, "business_cat": category}, "date", start, end)
    sl = drop_null_keys(sl.filter(F.col("status") == status), "customer_id", "date")
    base, one_word = EPOCH, False
    if start is not None and end is not None:
        base = dt.date(start.year, start.month, 1)
        one_word = len(period_range(start, end)) <= WORD
    return _counts_from_words(_month_words(sl, base, one_word), base, len(period_range(start, end)) if one_word else WORD)


def _month_words(rows: DataFrame, base: dt.date, one_word: bool) -> DataFrame:
    """customer_id, ``word``, ``bits`` (bit k: active in month ``63 * word + k`` since ``base``), ``cohort`` (first month)."""
    index = (F.year("date") - base.year) * 12 + F.month("date") - base.month
    rows = rows.select("customer_id", index.alias("month"))
    if one_word:
        words = rows.groupBy("customer_id").agg(F.expr("bit_or(shiftleft(1L, month))").alias("bits"))
        return words.select("customer_id", F.lit(0).alias("word"), "bits", _lowest_bit("bits").alias("cohort"))
    rows = rows.select("customer_id", F.floor(F.col("month") / WORD).cast("int").alias("word"), F.pmod("month", F.lit(WORD)).alias("bit"))
    words = rows.groupBy("customer_id", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    first = F.min(F.col("word") * WORD + _lowest_bit("bits")).over(Window.partitionBy("customer_id"))  # a row for each word
    return words.select("customer_id", "word", "bits", first.alias("cohort"))


def _lowest_bit(bits: str):
    return F.bit_count((F.col(bits).bitwiseAND(-F.col(bits))) - F.lit(1).cast("long")).cast("int")


def _counts_from_words(words: DataFrame, base: dt.date, months: int) -> DataFrame:
    """cohort, period_number, n_customers: a sum per month bit, then long form."""
    sums = [F.sum(F.shiftright("bits", k).bitwiseAND(F.lit(1).cast("long"))).alias(str(k)) for k in range(months)]
    wide = words.groupBy("cohort", "word").agg(*sums)
    long = wide.unpivot(["cohort", "word"], [str(k) for k in range(months)], "bit", "n_customers").where("n_customers > 0")
    month = F.col("word") * WORD + F.col("bit").cast("int")
    return long.select(
        F.add_months(F.lit(base), F.col("cohort")).alias("cohort"), (month - F.col("cohort")).cast("int").alias("period_number"), "n_customers"
    )


def month_sketches(orders: DataFrame, status: str = COMPLETED, lg_entries: int = SKETCH_LG) -> DataFrame:
    """``month, origin, category, customers``: a theta sketch of the distinct customers of each (A1, approximate).

    A sketch holds about ``2^lg_entries`` hashes at most, whatever the customers' number, and is exact below. Sketches
    unite, intersect and subtract, so one stored table answers every slice by month, origin and category.
    """
    rows = drop_null_keys(orders.filter(F.col("status") == status), "customer_id", "date")
    groups = rows.groupBy(month_start("date").alias("month"), "origin", F.col("business_cat").alias("category"))
    return groups.agg(F.theta_sketch_agg("customer_id", lg_entries).alias("customers"))


def cohort_counts_estimate(sketches: DataFrame, origin: str | None = None, category: str | None = None, start=None, end=None, lg_entries: int = SKETCH_LG) -> DataFrame:
    """``cohort, period_number, estimate, error_bound`` from ``month_sketches``, for whole months (A1, R1 approximate).

    A month's cohort is its customers less those of all months before it in the slice. ``error_bound`` is three standard errors,
    ``3 / sqrt(2^lg_entries)`` of the largest set that an estimate draws on (all customers up to the later month);
    it is 0 while that set fits the sketch, where the estimate is exact.
    """
    months = slice_rows(sketches, {"origin": origin, "category": category}, None)
    if start is not None:
        months = months.where(F.col("month") >= F.lit(dt.date(start.year, start.month, 1)))
    if end is not None:
        months = months.where(F.col("month") <= F.lit(dt.date(end.year, end.month, 1)))
    active = months.groupBy("month").agg(F.theta_union_agg("customers", lg_entries).alias("active"))
    # The rest works on one row a month. Each month meets the months up to it, by equal keys (every month names those it needs).
    so_far = active.select("month", "active").join(_months_up_to(active), "month")
    upto = so_far.groupBy("later").agg(F.theta_union_agg("active", lg_entries).alias("upto"))
    before = so_far.where("month < later").groupBy("later").agg(F.theta_union_agg("active", lg_entries).alias("before"))
    new = active.join(before, active.month == before.later, "left")
    new = new.select(F.col("month").alias("cohort"), F.when(F.col("before").isNull(), F.col("active")).otherwise(F.theta_difference("active", "before")).alias("new"))
    later = active.select(F.col("month").alias("later"), "active").join(upto, "later")
    pairs = new.join(_months_up_to(active).withColumnRenamed("month", "cohort"), "cohort").join(later, "later")
    stay = F.theta_sketch_estimate(F.theta_intersection("new", "active"))
    drawn = F.theta_sketch_estimate("upto")
    bound = F.when(drawn < 2**lg_entries, 0.0).otherwise(drawn * (3.0 / 2 ** (lg_entries / 2)))
    return pairs.select("cohort", month_diff("later", "cohort").alias("period_number"), stay.alias("estimate"), bound.alias("error_bound")).where("estimate > 0")


def _months_up_to(active: DataFrame) -> DataFrame:
    """(month, later) for all pairs of present months with month <= later, by equal keys on a gathered list (a row a month)."""
    listed = active.groupBy(F.lit(0).alias("all")).agg(F.sort_array(F.collect_set("month")).alias("months"))
    pairs = listed.select(F.explode("months").alias("later"), "months")
    return pairs.select(F.explode(F.filter("months", lambda m: m <= F.col("later"))).alias("month"), "later")


def period_range(start, end) -> list[int]:
    """Every period number that a slice from ``start`` to ``end`` can hold."""
    return list(range((end.year - start.year) * 12 + end.month - start.month + 1))


def _periods(long_df: DataFrame, periods: Sequence[int] | None) -> tuple[DataFrame, list[int]]:
    """The periods to show; a present period that is not listed stops the report instead of being left out.

    Without a list, all periods up to the largest present one (a job over the small counts table)."""
    if periods is None:
        return long_df, list(range((long_df.agg(F.max("period_number")).first()[0] or 0) + 1))
    listed = list(periods)
    unlisted = F.raise_error(F.concat(F.lit("period not listed: "), F.col("period_number").cast("string"))).cast("int")
    return long_df.withColumn("period_number", F.when(F.col("period_number").isin(listed), F.col("period_number")).otherwise(unlisted)), listed


def _wide(long_df: DataFrame, value: str, periods: Sequence[int] | None, prefix: str) -> DataFrame:
    """Pivot to one column per period."""
    long_df, periods = _periods(long_df, periods)
    wide = long_df.groupBy("cohort").pivot("period_number", list(periods)).agg(F.max(value))
    return wide.select(
        "cohort", *[F.col(str(p)).alias(f"{prefix}{p}") for p in periods]
    )


def cohort_matrix(counts: DataFrame, periods: Sequence[int] | None = None) -> DataFrame:
    """Cohort × period matrix of customer counts, columns ``period_<k>`` (R2)."""
    return _wide(counts, "n_customers", periods, "period_")


def retention(counts: DataFrame) -> DataFrame:
    """Long retention table (R3, A3, W3): each cell divided by the first
    cell (period 0) of its cohort row."""
    w = Window.partitionBy("cohort").orderBy("period_number")
    size = F.first("n_customers").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return counts.withColumn("cohort_size", size).select(
        "cohort",
        "period_number",
        "n_customers",
        "cohort_size",
        (F.col("n_customers") / F.col("cohort_size")).alias("retention_rate"),
    )


def retention_matrix(counts: DataFrame, periods: Sequence[int] | None = None) -> DataFrame:
    """Cohort × period matrix of retention rates, columns ``rate_<k>``."""
    return _wide(retention(counts), "retention_rate", periods, "rate_")


def retention_text(counts: DataFrame) -> DataFrame:
    """Heat-map text of the retention table (X10–X12): cohort as ``yyyy-MM``,
    percentage with two decimals and its ``x.xx%`` hover form."""
    r = retention(counts)
    hundredths = half_even_ratio("n_customers", "cohort_size", 4)
    return r.select(
        month_label("cohort").alias("cohort_label"),
        F.col("period_number").cast("string").alias("period_label"),
        F.coalesce(fixed2_text(hundredths), F.lit("")).alias("pct_text"),
        F.concat(fixed2_text(hundredths), F.lit("%")).alias("hover_text"),
        F.col("n_customers").cast("string").alias("count_text"),
    )


def retention_text_matrix(counts: DataFrame, periods: Sequence[int] | None = None) -> DataFrame:
    """The heat map's text grid: ``yyyy-MM`` cohort rows, ``pct_<k>`` columns
    with two-decimal percentages and '' where a cell is empty (X10, X20)."""
    text = retention_text(counts).select(
        "cohort_label", F.col("period_label").cast("int").alias("period_number"), "pct_text"
    )
    text, periods = _periods(text, periods)
    wide = text.groupBy("cohort_label").pivot("period_number", list(periods)).agg(F.max("pct_text"))
    return wide.select(
        "cohort_label", *[F.coalesce(F.col(str(p)), F.lit("")).alias(f"pct_{p}") for p in periods]
    )


def churn_deltas(counts: DataFrame) -> DataFrame:
    """Change in customers against the previous *present* period column.

    The reference subtracts adjacent columns of the cohort pivot, whose
    columns are the period numbers seen in any cohort. Column 0 keeps the
    cohort size; a cell is missing when either of its two cells is.
    Output is long: one row per present cell, ``churn`` NULL when the
    previous column is empty for that cohort; ``churn_label`` names the
    matrix column (``Churn_<k>``).
    """
    # One pass over the counts, two windows. The previous pivot column is the
    # largest period number below k seen in any cohort: a range frame over
    # all cells (the counts table has at most #months^2 rows, so a window
    # without partition key is bounded). The previous cell of the same
    # cohort comes from lag; it is the wanted cell only when its period is
    # that previous column, otherwise the column is empty for the cohort.
    all_before = Window.orderBy("period_number").rangeBetween(Window.unboundedPreceding, -1)
    by_cohort = Window.partitionBy("cohort").orderBy("period_number")
    prev_col = F.max("period_number").over(all_before)
    cells = counts.select(
        "cohort",
        "period_number",
        "n_customers",
        prev_col.alias("_prev_col"),
        F.lag("period_number").over(by_cohort).alias("_lag_p"),
        F.lag("n_customers").over(by_cohort).alias("_lag_n"),
    )
    churn = (
        F.when(F.col("_prev_col").isNull(), F.col("n_customers"))
        .when(F.col("_lag_p") == F.col("_prev_col"), F.col("n_customers") - F.col("_lag_n"))
    )
    return cells.select(
        "cohort",
        "period_number",
        F.concat(F.lit("Churn_"), F.col("period_number").cast("string")).alias("churn_label"),
        churn.cast("long").alias("churn"),
    )
