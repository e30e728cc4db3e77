"""Logical input tables derived from the driver's parquet (FIXTURES.md).

The reports expect an order export, an LTV export, a user table, a
customer-location table, a downloads sheet, first-open sheets and a
payment-screen sheet. The driver ships TPC-H-like tables instead, so each
logical table is derived here by fixed expressions that DuckDB repeats
verbatim in ``plans.oracle``.

Scale notes: every derivation reads only the columns it needs (the
parquet scan prunes the rest), joins the big tables on their keys with
Catalyst choosing the strategy from measured sizes, and the per-customer
order sequence is computed without sending one customer's whole history
to a single task (see ``_sequence_per_customer``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .readers import read_table

Tables = Callable[[str], DataFrame]


def table_source(spark: SparkSession, sf_dir: str) -> Tables:
    """``name -> DataFrame`` over ``<sf_dir>/<name>.parquet``, each table
    opened once (file listing and footer read happen once per source)."""
    opened: dict[str, DataFrame] = {}

    def get(name: str) -> DataFrame:
        if name not in opened:
            opened[name] = read_table(spark, sf_dir, name)
        return opened[name]

    return get


def _origin(regionkey: str = "n_regionkey"):
    return F.expr(f"CASE WHEN {regionkey} IN (0, 1) THEN 'Local' ELSE 'Diaspora' END")


def _text_id(key: str):
    return F.concat(F.col(key).cast("string"), F.lit(".0"))


def _email():
    return F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com"))


def _phone():
    return F.concat(F.lit("+213"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))


def _customers(t: Tables) -> DataFrame:
    customer = t("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey, "inner")


def _with_customer(facts: DataFrame, key: str, t: Tables, cust_cols: tuple[str, ...], nation_cols: tuple[str, ...]) -> DataFrame:
    """Fact rows joined to their customer, then the customer's nation.

    Joining the customer table on its own first keeps its size estimate the
    size of its scan (a join below it would multiply estimates), so the
    planner can broadcast it while it is small and sort-merge it when it is
    not; the nation table (25 rows) joins last.
    """
    customer = t("customer").select("c_custkey", "c_nationkey", *cust_cols)
    nation = t("nation").select("n_nationkey", *nation_cols)
    j = facts.join(customer, facts[key] == customer.c_custkey, "inner")
    return j.join(nation, j.c_nationkey == nation.n_nationkey, "inner")


def _sequence_per_customer(orders: DataFrame) -> DataFrame:
    """Add ``occurrence`` (1-based order number of the customer, by
    (o_orderdate, o_orderkey)) and ``previous_order_date``.

    A plain window partitioned by customer would put a heavy customer's
    whole history in one task. Instead the orders are first counted per
    (customer, day) with map-side partial aggregation; the running count
    and the last timestamp of the previous active day are computed on
    that day-level table, whose rows per customer are bounded by the
    number of calendar days; the order rows then join back on
    (customer, day), so a heavy customer is spread over its days, and
    only the orders of one customer on one day share a window partition.
    """
    o = orders.withColumn("_day", F.to_date("o_orderdate"))
    per_day = o.groupBy("o_custkey", "_day").agg(
        F.count(F.lit(1)).alias("_n"), F.max("o_orderdate").alias("_last_ts")
    )
    w_days = Window.partitionBy("o_custkey").orderBy("_day")
    per_day = per_day.select(
        "o_custkey",
        "_day",
        F.coalesce(
            F.sum("_n").over(w_days.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
        F.lag("_last_ts").over(w_days).alias("_prev_day_last"),
    )
    w_rows = Window.partitionBy("o_custkey", "_day").orderBy("o_orderdate", "o_orderkey")
    # Every order finds its own day row, so left and inner give the same
    # rows; the left form lets the optimizer drop this whole branch when a
    # report does not use the two sequence columns.
    return (
        o.join(per_day, ["o_custkey", "_day"], "left")
        .withColumn("occurrence", (F.col("_before") + F.row_number().over(w_rows)).cast("long"))
        .withColumn(
            "previous_order_date",
            F.coalesce(F.lag("o_orderdate").over(w_rows), F.col("_prev_day_last")),
        )
        .drop("_day", "_before", "_prev_day_last")
    )


def raw_orders(t: Tables) -> DataFrame:
    """Order export (FIXTURES.md ``raw_orders``)."""
    orders = t("orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    seq = _sequence_per_customer(orders)
    j = _with_customer(seq, "o_custkey", t, ("c_name",), ("n_regionkey",))
    return j.select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.when(F.col("o_orderkey") % 97 == 0, F.lit(None).cast("string"))
        .otherwise(_text_id("o_custkey"))
        .alias("customer_id"),
        F.col("o_orderdate").alias("date"),
        F.expr(
            "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'In_Progress' "
            "WHEN 'P' THEN CASE o_orderkey % 3 WHEN 0 THEN 'ABANDONED' WHEN 1 THEN 'CANCELED' END END"
        ).alias("job_status"),
        _origin().alias("customer_origine"),
        F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'CARD' ELSE 'CASH' END").alias("paymentType"),
        F.expr("CASE WHEN o_orderkey % 10 = 0 THEN 'EXTERNE' ELSE 'INTERNE' END").alias("Order Type"),
        F.expr(
            "CASE o_orderpriority WHEN '1-URGENT' THEN 'Recharge mobile' "
            "WHEN '2-HIGH' THEN 'Recharge mobile / ADSL' WHEN '3-MEDIUM' THEN 'Alimentation' "
            "WHEN '4-NOT SPECIFIED' THEN 'Shopping' "
            "WHEN '5-LOW' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Services' END END"
        ).alias("businessCat"),
        F.col("occurrence").alias("Occurence"),
        F.col("previous_order_date"),
        (F.col("occurrence") > 1).alias("returning_customer"),
        F.col("c_name").alias("customer_username"),
        _phone().alias("customer_phone"),
        _email().alias("customer_email"),
        F.col("o_totalprice").alias("total_amount_dzd"),
    )


def raw_ltv(t: Tables) -> DataFrame:
    """LTV export (FIXTURES.md ``raw_ltv``): exact decimals for money."""
    orders = t("orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    # Line margins are summed per order before the join (partial
    # aggregation map-side; lineitem is the largest table). The driver's
    # prices and discounts are whole hundredths, so price-cents ×
    # discount-hundredths is the exact DECIMAL(18,2) × DECIMAL(4,2) product
    # in units of 1e-4; summing it as BIGINT keeps the aggregation buffer
    # fixed-width (a wide DECIMAL buffer is ~2× slower) and the result is
    # converted to DECIMAL(18,4) once per order.
    units = F.round(F.col("l_extendedprice") * 100).cast("long") * F.round(F.col("l_discount") * 100).cast("long")
    margin = (
        t("lineitem")
        .select("l_orderkey", "l_extendedprice", "l_discount")
        .groupBy("l_orderkey")
        .agg(F.sum(units).alias("_units"))
        .select(
            "l_orderkey",
            (F.col("_units").cast("decimal(18,0)") / F.lit(10000)).cast("decimal(18,4)").alias("marge_dzd"),
        )
    )
    j = _with_customer(orders, "o_custkey", t, (), ("n_regionkey",))
    j = j.join(margin, j.o_orderkey == margin.l_orderkey, "left")
    eur = F.expr(
        "CAST(CAST(70 + year(o_orderdate) - 1995 AS DECIMAL(5,0)) * CAST(0.0001 AS DECIMAL(4,4)) AS DECIMAL(9,4))"
    )
    return j.select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        _text_id("o_custkey").alias("customer_id"),
        F.expr(
            "CASE WHEN o_orderstatus IN ('F', 'O') THEN 'COMPLETED' "
            "WHEN o_orderkey % 2 = 0 THEN 'ABANDONED' ELSE 'CANCELED' END"
        ).alias("job_status"),
        F.expr(
            "CASE o_orderpriority WHEN '1-URGENT' THEN 'Airtime' WHEN '2-HIGH' THEN 'Airtime' "
            "WHEN '3-MEDIUM' THEN 'Alimentation' WHEN '4-NOT SPECIFIED' THEN 'Shopping' "
            "WHEN '5-LOW' THEN 'Services' END"
        ).alias("businessCat"),
        _origin().alias("customer_origine"),
        F.col("o_orderdate").alias("date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("total_amount_dzd"),
        eur.alias("EUR"),
        F.col("marge_dzd"),
        (F.col("marge_dzd") * eur).alias("marge_eur"),
    )


def raw_users(t: Tables) -> DataFrame:
    """User table (FIXTURES.md ``raw_users``)."""
    c = _customers(t)
    return c.select(
        _text_id("c_custkey").alias("customer_id"),
        F.expr("date_add(DATE'1995-01-01', CAST((c_custkey * 37) % 2400 AS INT))").alias("date"),
        _email().alias("email"),
        _phone().alias("phone"),
        F.concat(F.lit("First"), F.col("c_custkey").cast("string")).alias("firstName"),
        F.col("c_name").alias("lastName"),
        F.col("n_name").alias("customer_country"),
        _origin().alias("Origine"),
        F.concat(
            F.lit("['"), F.col("c_mktsegment"), F.lit("', \"NATION_"),
            F.col("c_nationkey").cast("string"), F.lit("\"]"),
        ).alias("tags"),
    )


def raw_geo(t: Tables) -> DataFrame:
    """Customer location table (FIXTURES.md ``raw_geo``).

    Coordinates are built in exact decimal arithmetic and cast once, so the
    double is the correctly rounded value in any engine.
    """
    c = _customers(t)
    offset = "(n_nationkey % 10) * 0.25 + (c_custkey % 8) * 0.01 + (c_custkey % 5) * 0.001"
    return c.select(
        F.col("c_custkey").cast("long").alias("row_key"),
        F.expr(
            "CASE WHEN c_custkey % 53 = 0 THEN NULL "
            "ELSE concat('C', CAST(n_nationkey % 10 AS STRING), '_', CAST(c_custkey % 8 AS STRING)) END"
        ).alias("commune"),
        F.col("n_name").alias("wilaya"),
        F.expr(f"CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(28 + {offset} AS DOUBLE) END").alias(
            "Latitude"
        ),
        F.expr(f"CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST({offset} AS DOUBLE) END").alias(
            "Longitude"
        ),
    )


def raw_downloads(t: Tables) -> DataFrame:
    """Downloads sheet (FIXTURES.md ``raw_downloads``): one row per day and origin."""
    ev = t("events").select("ts", "user_id", "event_type")
    return (
        ev.filter(F.col("event_type") == "view")
        .select(
            F.expr("date_add(DATE'1998-01-01', day(ts) - 1)").alias("date"),
            F.expr("CASE WHEN user_id % 2 = 0 THEN 'Local' ELSE 'Diaspora' END").alias(
                "customer_origine"
            ),
        )
        .groupBy("date", "customer_origine")
        .agg(F.count(F.lit(1)).alias("downloads"))
    )


def raw_first_open(t: Tables) -> DataFrame:
    """First-open sheets (FIXTURES.md ``raw_first_open``), ``sheet_no`` 0–2."""
    ev = t("events").select("event_id", "ts", "user_id", "event_type")
    users = t("customer").select("c_custkey", "c_name")
    sign = ev.filter(F.col("event_type") == "signup")
    return sign.join(users, sign.user_id == users.c_custkey, "inner").select(
        F.col("event_id").cast("long").alias("row_key"),
        (F.col("event_id") % 3).cast("long").alias("sheet_no"),
        _email().alias("email"),
        F.to_date("ts").alias("first_open_date"),
    )


def raw_payment_screen(t: Tables) -> DataFrame:
    """Payment-screen sheet, all text (after FIXTURES.md ``raw_payment_screen``):
    the e-mail and day of every order, i.e. every order passed the payment
    screen. (FIXTURES.md kept every seventh order; the whole table is used
    so the report's work grows with the data.)"""
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return _with_customer(orders, "o_custkey", t, ("c_name",), ()).select(
        _email().alias("email"),
        F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("Date de Payment method screen"),
    )


RAW_TABLES = {
    "raw_orders": raw_orders,
    "raw_ltv": raw_ltv,
    "raw_users": raw_users,
    "raw_geo": raw_geo,
    "raw_downloads": raw_downloads,
    "raw_first_open": raw_first_open,
    "raw_payment_screen": raw_payment_screen,
}
