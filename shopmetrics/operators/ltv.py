"""Customer lifetime value.

One aggregation per customer (or per category and customer) with
map-side partial aggregation; money is summed as exact DECIMAL and
converted to DOUBLE once, so results do not depend on the order in
which partitions are combined. The reference's loop over categories and
its second copy of the same arithmetic become one ``groupBy``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.textfmt import half_even_ratio, label_with_percent, thousands
from ..functions.timefn import days_to_months, whole_days
from .slices import drop_null_keys, slice_rows

MONEY = ("gmv_dzd", "gmv_eur", "margin_dzd", "margin_eur")
_SOURCE = {
    "gmv_dzd": "total_amount_dzd",
    "gmv_eur": "total_amount_eur",
    "margin_dzd": "margin_dzd",
    "margin_eur": "margin_eur",
}
LTV_MEASURES = ("ltv_gmv_eur", "ltv_margin_eur", "ltv_gmv_dzd", "ltv_margin_dzd")


def _per_customer(rows: DataFrame, keys: list[str]) -> DataFrame:
    # An empty sum is 0, as a pandas sum of missing values is (not NULL).
    sums = [
        F.coalesce(F.sum(_SOURCE[m]), F.lit(0)).cast("double").alias(m) for m in MONEY
    ]
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_orders"),  # an order without an id counts too
        *sums,
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
    )
    life = days_to_months(whole_days("max_date", "min_date"))
    base = base.withColumn("lifetime_months", life).filter(F.col("lifetime_months") > 0)
    basket = {f"basket_{m}": F.col(m) / F.col("n_orders") for m in MONEY}
    base = base.withColumns(basket).withColumn(
        "purchase_frequency", F.col("n_orders") / F.col("lifetime_months")
    )
    ltv = {
        f"ltv_{m}": F.col("purchase_frequency") * F.col(f"basket_{m}") * F.col("lifetime_months")
        for m in MONEY
    }
    return base.withColumns(ltv)


def customer_ltv(ltv_rows: DataFrame, origin=None, category=None, start=None, end=None) -> DataFrame:
    """Per-customer LTV table of the sliced rows (R5: A4, A5, F17).

    Customers whose first and last order are less than one day apart
    (lifetime 0) are dropped, which also rules out division by zero. Rows
    without a customer id belong to no customer and are dropped (T3).
    """
    sl = slice_rows(ltv_rows, {"origin": origin, "business_cat": category}, "date", start, end)
    return _per_customer(drop_null_keys(sl, "customer_id"), ["customer_id"])


def category_ltv(ltv_rows: DataFrame, origin=None, start=None, end=None) -> DataFrame:
    """The same per category and customer (R6: A6, U2)."""
    sl = slice_rows(ltv_rows, {"origin": origin}, "date", start, end)
    return _per_customer(drop_null_keys(sl, "customer_id"), ["business_cat", "customer_id"])


def _exact_mean(c: str):
    """Mean that does not depend on summation order: values are summed as
    DECIMAL (to 1e-6) and divided once in DOUBLE."""
    return F.try_divide(F.sum(F.col(c).cast("decimal(38,6)")).cast("double"), F.count(c))


def category_ltv_summary(cat_ltv: DataFrame, formatted: bool = False) -> DataFrame:
    """Mean LTV per category (R7: A7, A8, X8, X9, X13, X14).

    Means are rounded half-even to whole units and cast to integers; the
    margin share is margin LTV / GMV LTV × 100 on those integers (NULL when
    GMV is 0, T9), and the category label carries it rounded to 2 places.
    With ``formatted`` the DZD columns become text with '.' thousands.
    """
    means = cat_ltv.groupBy("business_cat").agg(*[_exact_mean(m).alias(m) for m in LTV_MEASURES])
    ints = means.select(
        "business_cat", *[F.bround(m, 0).cast("long").alias(m) for m in LTV_MEASURES]
    )
    share = F.try_divide(F.col("ltv_margin_dzd").cast("double"), F.col("ltv_gmv_dzd")) * F.lit(100.0)
    hundredths = half_even_ratio("ltv_margin_dzd", "ltv_gmv_dzd", 4)
    out = ints.select(
        "business_cat",
        label_with_percent("business_cat", hundredths).alias("category_label"),
        *LTV_MEASURES,
        share.alias("margin_share_pct"),
    )
    if formatted:
        out = out.select(
            "business_cat",
            "category_label",
            "ltv_gmv_eur",
            "ltv_margin_eur",
            thousands("ltv_gmv_dzd", ".").alias("ltv_gmv_dzd"),
            thousands("ltv_margin_dzd", ".").alias("ltv_margin_dzd"),
        )
    return out


def ltv_series(summary: DataFrame, currency: str = "EUR") -> DataFrame:
    """Long bar-chart series ``(category_label, measure, value)`` for one
    currency (R8: P15, P16)."""
    cur = currency.upper()
    if cur in ("EUR", "€"):
        cols = ["ltv_gmv_eur", "ltv_margin_eur"]
    elif cur == "DZD":
        cols = ["ltv_gmv_dzd", "ltv_margin_dzd"]
    else:
        raise ValueError(f"currency must be EUR or DZD, not {currency!r}")
    return summary.select("category_label", *[F.col(c).cast("long") for c in cols]).unpivot(
        ["category_label"], cols, "measure", "value"
    )
