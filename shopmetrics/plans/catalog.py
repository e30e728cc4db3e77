"""The registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key.

Every query reads the driver tables at ``sf_dir`` in full and applies the
standard parameters of ``plans.params``; ``plans.oracle`` holds the DuckDB
twin of each key.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as op
from ..schemas import DOWNLOADS_COLUMNS, RAW_GEO_EXPORT, RAW_ORDERS
from ..session import materialize, scratch_path
from ..sources import fixtures as fx
from ..sources.export import write_report, write_segments
from ..sources.order_store import default_range_of_store, write_order_store
from ..sources.readers import load_tables, read_csv_table, read_csv_with_misfits, read_sheets, read_text_sheet, typed_by_value
from . import params as P

Query = Callable[[SparkSession, str], DataFrame]


# --- shared inputs of one query ---------------------------------------------

class Inputs:
    """The logical tables of one query, each built once.

    A query that needs the sign-ups in three places (funnel) builds and
    analyses them once, and every driver table is opened once.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.t = fx.table_source(spark, sf_dir)
        self._memo: dict = {}

    def _get(self, key, build):
        if key not in self._memo:
            self._memo[key] = build()
        return self._memo[key]

    def raw(self, name: str) -> DataFrame:
        return self._get(("raw", name), lambda: fx.RAW_TABLES[name](self.t))

    @property
    def orders(self) -> DataFrame:
        return self._get("orders", lambda: op.clean_orders(
            self.raw("raw_orders"), P.EXCLUDED_ORDERS, P.EXCLUDED_CUSTOMERS))

    @property
    def orders_nan_ids(self) -> DataFrame:
        return self._get("orders_nan", lambda: op.clean_orders(
            self.raw("raw_orders"), P.EXCLUDED_ORDERS, P.EXCLUDED_CUSTOMERS, null_id_text="nan"))

    @property
    def ltv(self) -> DataFrame:
        return self._get("ltv", lambda: op.clean_ltv(
            self.raw("raw_ltv"), P.EXCLUDED_ORDERS, P.EXCLUDED_CUSTOMERS, P.LTV_CATEGORIES))

    @property
    def users(self) -> DataFrame:
        return self._get("users", lambda: op.clean_users(self.raw("raw_users"), P.EXCLUDED_CUSTOMERS))

    def counts(self, origin=None, category=None) -> DataFrame:
        return self._get(("counts", origin, category), lambda: op.cohort_counts(
            self.orders, origin, category, P.SLICE_START, P.SLICE_END))

    @property
    def category_ltv(self) -> DataFrame:
        return self._get("category_ltv", lambda: op.category_ltv(self.ltv, None, P.SLICE_START, P.SLICE_END))

    def summary(self, formatted=False) -> DataFrame:
        return self._get(("summary", formatted), lambda: op.category_ltv_summary(self.category_ltv, formatted))

    @property
    def communes(self) -> DataFrame:
        return self._get("communes", lambda: op.customers_by_commune(self.raw("raw_geo")))

    @property
    def signups(self) -> DataFrame:
        return self._get("signups", lambda: op.new_signups(self.users, None, None, P.USERS_START, P.USERS_END))

    @property
    def signup_orders(self) -> DataFrame:
        return self._get("signup_orders", lambda: op.signup_orders(self.orders, self.signups, P.FUNNEL_SINCE))

    def order_flags(self, category=None) -> DataFrame:
        return self._get(("order_flags", category), lambda: op.order_flags(self.orders, P.FUNNEL_SINCE, category))

    def segments(self) -> dict[str, DataFrame]:
        return self._get("segments", lambda: op.funnel_segments(
            self.signups, op.signup_flags(self.orders, self.signups, P.FUNNEL_SINCE), self.order_flags()))

    @property
    def first_open(self) -> DataFrame:
        return self._get("first_open", lambda: op.first_open_signups(
            self.users, self.raw("raw_first_open"), None, P.USERS_START, P.USERS_END))

    def funnel(self, category=None, formatted=False) -> DataFrame:
        dl = op.downloads_slice(self.raw("raw_downloads"), None, P.USERS_START, P.USERS_END)
        return op.funnel_metrics(dl, self.signups, self.first_open, self.order_flags(category), formatted)

    def funnel_for_origin(self, origin: str) -> DataFrame:
        """The funnel of one origin: sign-ups, downloads and first-open rows
        are all sliced by it, as the acquisition page's filter does."""
        signups = op.new_signups(self.users, origin, None, P.USERS_START, P.USERS_END)
        flags = self.order_flags()
        dl = op.downloads_slice(self.raw("raw_downloads"), origin, P.USERS_START, P.USERS_END)
        fo = op.first_open_signups(self.users, self.raw("raw_first_open"), origin, P.USERS_START, P.USERS_END)
        return op.funnel_metrics(dl, signups, fo, flags)


def _q(build: Callable[[Inputs], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Inputs(spark, sf_dir))

    run.__doc__ = build.__doc__
    return run


# --- queries with side effects (files round trip) -------------------------

def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order export written as CSV files of two layouts to the shared folder and read back through
    the manifest loader by explicit schema (S1–S3)."""
    path = os.path.join(scratch_path(spark, "csv_roundtrip"), "orders_export.csv")
    # Columns in reverse with one that no report uses, doubled quotes; and as they are, with line breaks in cells.
    raw = Inputs(spark, sf_dir).raw("raw_orders")
    foreign = raw.select(*reversed(raw.columns), F.lit('a "quoted", remark').alias("remark"))
    _as_csv(foreign.where("paymentType = 'CARD'"), path)
    _as_csv(raw.withColumn("note", F.lit('two\n"lines"')).where("paymentType <> 'CARD'"), path, "append")
    return load_tables(spark, {path: RAW_ORDERS}, register_views=False)["orders_export"]


def _as_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def report_export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user report with quotes, commas and line breaks in names, exported as CSV and read back."""
    users = Inputs(spark, sf_dir).users.withColumn("first_name", F.concat(F.lit('Say "'), "first_name", F.lit('",\nplease')))
    path = scratch_path(spark, "user-report")
    write_report(users, path, "csv", index_cols=("customer_id",))
    return read_csv_table(spark, path, users.schema).select(*users.columns)


def _faulty_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The order export with cells that do not fit their types, read in two outputs."""
    raw = Inputs(spark, sf_dir).raw("raw_orders")
    text = raw.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in raw.columns])
    amount = F.when(F.col("paymentType") == "CARD", F.col("total_amount_dzd")).otherwise(F.replace("total_amount_dzd", F.lit("1."), F.lit("1,")))
    text = text.withColumn("total_amount_dzd", amount).withColumn("Occurence", F.when(F.col("Occurence") == "3", "3.5").otherwise(F.col("Occurence")))
    path = os.path.join(scratch_path(spark, "faulty"), "orders.csv")
    _as_csv(text, path)
    return read_csv_with_misfits(spark, path, RAW_ORDERS, keys=("order_id",))


def csv_misfits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the order export that do not fit their columns, with column and reason."""
    return _faulty_orders(spark, sf_dir)[1].drop("row")


def cohort_counts_of_good_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort counts over the rows of a faulty order export that fit."""
    orders = op.clean_orders(_faulty_orders(spark, sf_dir)[0], P.EXCLUDED_ORDERS, P.EXCLUDED_CUSTOMERS)
    return op.cohort_counts(orders, None, None, P.SLICE_START, P.SLICE_END)


def _first_open_sheets(spark: SparkSession, i: Inputs) -> DataFrame:
    """Three worksheets written as files, rows in sheet order and without a key, and read by path list."""
    folder = scratch_path(spark, "first-open")
    paths = [os.path.join(folder, f"sheet{n}.csv") for n in range(3)]
    for n, path in enumerate(paths):
        _as_csv(i.raw("raw_first_open").where(F.col("sheet_no") == n).orderBy("row_key").select("email", "first_open_date"), path)
    sheets = read_sheets(spark, paths)
    return sheets.withColumn("first_open_date", F.col("first_open_date").cast("date"))


def first_open_from_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-open sign-ups from worksheet files: keep-first goes by a row's place in its file."""
    i = Inputs(spark, sf_dir)
    return op.first_open_signups(i.users, _first_open_sheets(spark, i), None, P.USERS_START, P.USERS_END)


def communes_from_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per commune from the location export as it is, without a row key."""
    path = os.path.join(scratch_path(spark, "geo"), "customer_geolocalisation.csv")
    _as_csv(Inputs(spark, sf_dir).raw("raw_geo").orderBy("row_key").drop("row_key"), path)
    return op.customers_by_commune(read_csv_table(spark, path, RAW_GEO_EXPORT, position="row_key"))


def funnel_metrics_from_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funnel over worksheet files: downloads under the sheet's own column name, cells typed by value."""
    i = Inputs(spark, sf_dir)
    path = os.path.join(scratch_path(spark, "downloads"), "downloads.csv")
    own = {new: old for old, new in DOWNLOADS_COLUMNS.items()}
    _as_csv(i.raw("raw_downloads").withColumnsRenamed(own), path)
    downloads = typed_by_value(read_text_sheet(spark, path), rename=DOWNLOADS_COLUMNS)
    first_open = op.first_open_signups(i.users, _first_open_sheets(spark, i), None, P.USERS_START, P.USERS_END)
    return op.funnel_metrics(op.downloads_slice(downloads, None, P.USERS_START, P.USERS_END), i.signups, first_open, i.order_flags())


def segment_export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sets of the acquisition page written partitioned by segment and read back, every column."""
    path, i = scratch_path(spark, "segments"), Inputs(spark, sf_dir)
    written = op.segments_long(i.signups, i.order_flags(), i.first_open)
    write_segments(written, path)
    return spark.read.parquet(path).select(written.columns)


def cohort_counts_estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort counts of one origin from stored month sketches, beside the exact ones (A1): whether each estimate is within its bound."""
    i = Inputs(spark, sf_dir)
    sketches = materialize(op.month_sketches(i.orders), "month_sketches")
    estimate = op.cohort_counts_estimate(sketches, "Local", None, P.SLICE_START, P.SLICE_END)
    exact = i.counts("Local")
    both = exact.join(estimate, ["cohort", "period_number"], "full")
    off = F.abs(F.coalesce("estimate", F.lit(0.0)) - F.coalesce("n_customers", F.lit(0)))
    # Half a customer for the doubles of an exact sketch; a cell without an estimate is within the bound of its month's.
    return both.select("cohort", "period_number", F.coalesce("n_customers", F.lit(0)).alias("n_customers"), (off <= F.coalesce("error_bound", F.lit(0.0)) + 0.5).alias("within_bound"))


def cohort_counts_all_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort counts without a date range: months in words of 63."""
    return op.cohort_counts(Inputs(spark, sf_dir).orders)


def _order_store(spark: SparkSession, i: Inputs) -> tuple[DataFrame, str]:
    path = scratch_path(spark, "order-store")
    return write_order_store(i.orders, f"order_store_{uuid.uuid4().hex}", path, buckets=16), path


def default_date_range_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default range from the statistics of a stored order table's files."""
    return default_range_of_store(spark, _order_store(spark, Inputs(spark, sf_dir))[1], P.DEFAULT_RANGE_AS_OF)


def non_buyers_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-buyers from the order store bucketed by customer: no shuffle."""
    return op.non_buyers(_order_store(spark, Inputs(spark, sf_dir))[0])


def customer_flags_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sign-ups who ordered, from the order store: only the sign-ups are shuffled."""
    i = Inputs(spark, sf_dir)
    store = _order_store(spark, i)[0]
    return op.signup_flags(store, i.signups, P.FUNNEL_SINCE).drop("any_completed")


def _segment(name: str) -> Query:
    return _q(lambda i: i.segments()[name])


def queries() -> dict[str, Query]:
    return {
        # sources and cleaning
        "csv_roundtrip": csv_roundtrip,
        "csv_misfits": csv_misfits,
        "cohort_counts_of_good_rows": cohort_counts_of_good_rows,
        "report_export_roundtrip": report_export_roundtrip,
        "first_open_from_sheets": first_open_from_sheets,
        "communes_from_export": communes_from_export,
        "funnel_metrics_from_sheets": funnel_metrics_from_sheets,
        "clean_orders": _q(lambda i: i.orders),
        "clean_ltv": _q(lambda i: op.decimals_as_double(i.ltv)),
        "clean_users": _q(lambda i: i.users),
        "clean_orders_overridden": _q(lambda i: op.clean_orders(
            i.raw("raw_orders"), P.EXCLUDED_ORDERS, P.EXCLUDED_CUSTOMERS, order_type_overrides=P.EXTERNAL_CUSTOMERS)),
        "ordering_customers": _q(lambda i: op.distinct_ids(i.orders, "customer_id")),
        "external_orders": _q(lambda i: op.external_orders(i.orders)),
        "payment_screen_view": _q(lambda i: op.payment_screen_view(i.orders)),
        # slices
        "slice_orders": _q(lambda i: op.slice_rows(
            i.orders, {"origin": "Local", "business_cat": "Alimentation"}, "date", P.SLICE_START, P.SLICE_END)),
        "slice_ltv": _q(lambda i: op.decimals_as_double(op.slice_rows(
            i.ltv, {"origin": "Diaspora", "business_cat": "Shopping"}, "date", P.SLICE_START, P.SLICE_END))),
        "slice_summary": _q(lambda i: op.decimals_as_double(op.slice_rows(
            i.ltv, {"origin": "Local"}, "date", P.SLICE_START, P.SLICE_END))),
        "slice_users": _q(lambda i: op.slice_rows(
            i.users, {"origin": "Local", "customer_country": P.USERS_COUNTRY}, "date", P.USERS_START, P.USERS_END)),
        "slice_by_status": _q(lambda i: op.slice_rows(
            i.orders, {"status": "In_Progress"}, "date", P.SLICE_START, P.SLICE_END)),
        "default_date_range_from_store": default_date_range_from_store,
        "non_buyers_from_store": non_buyers_from_store,
        "customer_flags_from_store": customer_flags_from_store,
        "default_date_range": _q(lambda i: op.default_range(i.orders, P.DEFAULT_RANGE_AS_OF)),
        "choices_origin": _q(lambda i: op.choices(i.orders, "origin")),
        # retention
        "cohort_counts": _q(lambda i: i.counts()),
        "cohort_counts_local_airtime": _q(lambda i: i.counts("Local", "Airtime")),
        "cohort_counts_all_time": cohort_counts_all_time,
        "cohort_counts_estimated": cohort_counts_estimated,
        "cohort_counts_nan_ids": _q(lambda i: op.cohort_counts(
            i.orders_nan_ids, None, None, P.SLICE_START, P.SLICE_END)),
        "cohort_matrix": _q(lambda i: op.cohort_matrix(i.counts(), P.COHORT_PERIODS)),
        "cohort_matrix_24m": _q(lambda i: op.cohort_matrix(op.cohort_counts(i.orders, None, None, P.LONG_START, P.SLICE_END), P.LONG_PERIODS)),
        "retention": _q(lambda i: op.retention(i.counts())),
        "retention_matrix_24m": _q(lambda i: op.retention_matrix(op.cohort_counts(i.orders, None, None, P.LONG_START, P.SLICE_END), P.LONG_PERIODS)),
        "retention_matrix": _q(lambda i: op.retention_matrix(i.counts(), P.COHORT_PERIODS)),
        "retention_text": _q(lambda i: op.retention_text(i.counts())),
        "retention_text_matrix": _q(lambda i: op.retention_text_matrix(i.counts(), P.COHORT_PERIODS)),
        "churn_deltas": _q(lambda i: op.churn_deltas(i.counts())),
        # lifetime value
        "customer_ltv": _q(lambda i: op.customer_ltv(i.ltv, None, None, P.SLICE_START, P.SLICE_END)),
        "customer_ltv_local_shopping": _q(lambda i: op.customer_ltv(
            i.ltv, "Local", "Shopping", P.SLICE_START, P.SLICE_END)),
        "category_ltv": _q(lambda i: i.category_ltv),
        "category_ltv_summary": _q(lambda i: i.summary()),
        "category_ltv_summary_text": _q(lambda i: i.summary(True)),
        "ltv_series_eur": _q(lambda i: op.ltv_series(i.summary(), "EUR")),
        "ltv_series_dzd": _q(lambda i: op.ltv_series(i.summary(), "DZD")),
        # geography
        "customers_by_commune": _q(lambda i: i.communes),
        "communes_ranked": _q(lambda i: op.with_position(i.communes, F.desc("n_customers"), "commune")),
        "commune_map_points": _q(lambda i: op.commune_map_points(i.communes, P.MAP_WILAYA)),
        "commune_map_points_all": _q(lambda i: op.commune_map_points(i.communes)),
        "wilaya_centres": _q(lambda i: op.wilaya_centres(i.communes)),
        # acquisition
        "new_signups": _q(lambda i: i.signups),
        "new_signups_local_country": _q(lambda i: op.new_signups(
            i.users, "Local", P.USERS_COUNTRY, P.USERS_START, P.USERS_END)),
        "downloads_local": _q(lambda i: op.downloads_slice(
            i.raw("raw_downloads"), "Local", P.USERS_START, P.USERS_END)),
        "first_open_signups_diaspora": _q(lambda i: op.first_open_signups(
            i.users, i.raw("raw_first_open"), "Diaspora", P.USERS_START, P.USERS_END)),
        "signups_by_month": _q(lambda i: op.signups_by_period(i.signups, "month")),
        "signups_by_week": _q(lambda i: op.signups_by_period(i.signups, "week")),
        "signups_by_day": _q(lambda i: op.signups_by_period(i.signups, "day")),
        "signups_by_month_ranked": _q(lambda i: op.with_position(
            op.signups_by_period(i.signups, "month"), "n_signups", "period")),
        "cohort_counts_in_order": _q(lambda i: op.with_position(i.counts(), "cohort", "period_number")),
        "first_open_signups": _q(lambda i: i.first_open),
        "signup_orders": _q(lambda i: i.signup_orders),
        "signup_orders_spread": _q(lambda i: op.signup_orders(i.orders, i.signups, P.FUNNEL_SINCE, spread=True)),
        "segment_ordered": _segment("ordered"),
        "segment_not_ordered": _segment("not_ordered"),
        "segment_completed": _segment("completed"),
        "segment_in_progress": _segment("in_progress"),
        "segment_checkout_abandoned": _segment("checkout_abandoned"),
        "segment_not_completed": _segment("not_completed"),
        "funnel_metrics": _q(lambda i: i.funnel()),
        "funnel_metrics_text": _q(lambda i: i.funnel(formatted=True)),
        "funnel_metrics_alimentation": _q(lambda i: i.funnel("Alimentation")),
        "funnel_metrics_local": _q(lambda i: i.funnel_for_origin("Local")),
        "segment_export_roundtrip": segment_export_roundtrip,
        # retargeting
        "retarget_buyers_rows": _q(lambda i: op.retarget_buyers(i.orders, P.BUYER_DAYS, P.AS_OF, latest_only=False)),
        "retarget_buyers": _q(lambda i: op.retarget_buyers(
            i.orders, P.BUYER_DAYS, P.AS_OF, ["Local"], ["Airtime", "Alimentation"])),
        "retarget_buyers_over_120": _q(lambda i: op.retarget_buyers(i.orders, "over_120", P.AS_OF)),
        "retarget_non_buyer_buckets": _q(lambda i: op.non_buyer_buckets(i.orders, P.AS_OF)),
        "non_buyers_latest": _q(lambda i: op.non_buyers(i.orders)),
        "retarget_non_buyers_60": _q(lambda i: op.retarget_non_buyers(i.orders, P.NON_BUYER_BUCKET, P.AS_OF)),
        # dormant
        "non_buyers_cumulative": _q(lambda i: op.non_buyers_cumulative(
            i.orders, P.NON_BUYER_CUMULATIVE_DAYS, P.AS_OF)),
        "checkout_payment_screen": _q(lambda i: op.checkout_payment_screen(
            i.users, i.raw("raw_payment_screen"), i.orders, P.USERS_START, P.USERS_END)),
    }
