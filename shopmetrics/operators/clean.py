"""Cleaning of the three raw exports (R20: P1–P12, F1–F6).

Exclusion lists and value maps are parameters; the reference's literal
lists are business data and are not reproduced.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import (
    exclude_ids,
    id_text,
    not_in_null_safe,
    require_columns,
    strip_float_suffix,
    strip_list_marks,
)
from ..vocab import ABANDONED, CATEGORY_MAP, COMPLETED, EXTERNAL_ORDER_TYPE, LTV_CATEGORIES

DEFAULT_CATEGORY_MAP = CATEGORY_MAP
DEFAULT_LTV_CATEGORIES = LTV_CATEGORIES
DROPPED_STATUSES = (ABANDONED,)

ORDER_EXPORT_COLUMNS = (
    "order_id", "customer_id", "date", "job_status", "customer_origine", "paymentType", "Order Type",
    "businessCat", "Occurence", "previous_order_date", "returning_customer", "customer_username",
    "customer_phone", "customer_email", "total_amount_dzd",
)
LTV_EXPORT_COLUMNS = (
    "order_id", "customer_id", "job_status", "businessCat", "customer_origine", "date",
    "total_amount_dzd", "EUR", "marge_dzd", "marge_eur",
)
USER_EXPORT_COLUMNS = (
    "customer_id", "date", "email", "phone", "firstName", "lastName", "customer_country", "Origine", "tags",
)


def remap_values(c: str, mapping: Mapping[str, str]):
    """Exact value replacement; other values (and NULL) pass through."""
    col = F.col(c)
    if not mapping:
        return col
    expr = None
    for old, new in mapping.items():
        expr = (F.when(col == old, F.lit(new)) if expr is None else expr.when(col == old, F.lit(new)))
    return expr.otherwise(col)


def set_where_key(df: DataFrame, key: str, keys: Iterable[str], column: str, value: str) -> DataFrame:
    """``loc[key in keys, column] = value``."""
    keys = list(keys)
    if not keys:
        return df
    return df.withColumn(
        column, F.when(F.col(key).isin(keys), F.lit(value)).otherwise(F.col(column))
    )


def clean_orders(
    raw: DataFrame,
    excluded_orders=(),
    excluded_customers=(),
    category_map: Mapping[str, str] | None = None,
    drop_status: Iterable[str] = DROPPED_STATUSES,
    order_type_overrides: Iterable[str] = (),
    null_id_text: str | None = None,
) -> DataFrame:
    """Order export → cleaned orders.

    Steps in reference order: ids as text, status filter keeping NULL
    (T4), ``.0`` stripped from customer ids, category labels folded,
    excluded orders and customers removed (NULL ids kept, T4), order type
    overridden for listed customers (T18), projection, NULL category
    dropped.

    A missing customer id stays NULL, and customer-level reports drop it
    (T3). ``null_id_text="nan"`` reproduces the reference instead, where
    every missing id became the same text and so one customer.
    """
    require_columns(raw, ORDER_EXPORT_COLUMNS, "order export")
    cmap = DEFAULT_CATEGORY_MAP if category_map is None else category_map
    cid = strip_float_suffix(id_text(raw, "customer_id"))
    if null_id_text is not None:
        cid = F.coalesce(cid, F.lit(null_id_text))
    df = (
        raw.withColumn("order_id", id_text(raw, "order_id"))
        .withColumn("customer_id", cid)
        .withColumnRenamed("job_status", "status")
        .filter(not_in_null_safe("status", drop_status))
        .withColumn("businessCat", remap_values("businessCat", cmap))
    )
    df = exclude_ids(df, "order_id", excluded_orders)
    df = exclude_ids(df, "customer_id", excluded_customers)
    df = df.withColumnRenamed("Order Type", "order_type")
    df = set_where_key(df, "customer_id", order_type_overrides, "order_type", EXTERNAL_ORDER_TYPE)
    return df.select(
        F.col("date").cast("timestamp_ntz").alias("date"),
        "status",
        F.col("customer_origine").alias("origin"),
        F.col("paymentType").alias("payment_type"),
        "order_id",
        "order_type",
        F.col("businessCat").alias("business_cat"),
        "customer_id",
        F.col("Occurence").cast("long").alias("occurrence"),
        F.col("previous_order_date").cast("timestamp_ntz").alias("previous_order_date"),
        "returning_customer",
        "customer_username",
        "customer_phone",
        "customer_email",
        F.col("total_amount_dzd").cast("double").alias("total_amount_dzd"),
    ).filter(F.col("business_cat").isNotNull())


def clean_ltv(
    raw: DataFrame,
    excluded_orders=(),
    excluded_customers=(),
    categories: Iterable[str] = DEFAULT_LTV_CATEGORIES,
    drop_status: Iterable[str] = DROPPED_STATUSES,
    status: str = COMPLETED,
) -> DataFrame:
    """LTV export → cleaned LTV rows (R20: P11, F1–F5).

    Money stays exact DECIMAL here; reports sum it exactly and convert to
    DOUBLE once, so totals do not depend on summation order.
    """
    require_columns(raw, LTV_EXPORT_COLUMNS, "LTV export")
    df = (
        raw.withColumn("total_amount_eur", F.col("total_amount_dzd") * F.col("EUR"))
        .filter(F.col("businessCat").isin(list(categories)))
        .withColumn("order_id", id_text(raw, "order_id"))
        .withColumn("customer_id", strip_float_suffix(id_text(raw, "customer_id")))
        .filter(not_in_null_safe("job_status", drop_status))
    )
    df = exclude_ids(df, "order_id", excluded_orders)
    df = exclude_ids(df, "customer_id", excluded_customers)
    return df.filter(F.col("job_status") == status).select(
        "order_id",
        "customer_id",
        F.col("job_status").alias("status"),
        F.col("businessCat").alias("business_cat"),
        F.col("customer_origine").alias("origin"),
        "date",
        "total_amount_dzd",
        F.col("EUR").alias("eur_rate"),
        "total_amount_eur",
        F.col("marge_dzd").alias("margin_dzd"),
        F.col("marge_eur").alias("margin_eur"),
    )


def clean_users(raw: DataFrame, excluded_customers=()) -> DataFrame:
    """User table → cleaned users (R20: P3–P6, F3)."""
    require_columns(raw, USER_EXPORT_COLUMNS, "user table")
    df = (
        raw.withColumn("customer_id", strip_float_suffix(id_text(raw, "customer_id")))
        .withColumn("tags", strip_list_marks("tags"))
    )
    df = exclude_ids(df, "customer_id", excluded_customers)
    return df.select(
        "customer_id",
        F.to_date("date").alias("date"),
        "email",
        "phone",
        F.col("firstName").alias("first_name"),
        F.col("lastName").alias("last_name"),
        "customer_country",
        F.col("Origine").alias("origin"),
        "tags",
    )


def external_orders(orders: DataFrame) -> DataFrame:
    """Orders placed through the external channel."""
    return orders.filter(F.col("order_type") == EXTERNAL_ORDER_TYPE)


def payment_screen_view(orders: DataFrame) -> DataFrame:
    """Order columns matched against the payment-screen sheet."""
    return orders.select(
        "date", "business_cat", "order_id", "status", F.col("customer_email").alias("email")
    )
