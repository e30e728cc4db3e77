"""Refresh every report from the exports and write them as tables.

The batch counterpart of the reference's pages and download buttons: the
cleaned exports are written once under the shared folder (lineage cut,
reused by every report), then all reports are written into one run's folder under a path named
after the filter values, and published together (S8, S9, ``sources.publish``).

    python -m shopmetrics.plans.refresh --orders orders.csv ... --out s3a://bucket/reports
"""

from __future__ import annotations

import argparse
import datetime as dt
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as op
from ..schemas import DOWNLOADS_COLUMNS, RAW_GEO_EXPORT, RAW_LTV, RAW_ORDERS, RAW_USERS
from ..session import build_session, materialize, remove_scratch
from ..sources.export import report_path, write_report, write_segments
from ..sources.publish import parameters_key, publish
from ..sources.readers import read_csv_table, read_csv_with_misfits, read_sheets, read_text_sheet, typed_by_value


@dataclass
class ReportParams:
    start: dt.date
    end: dt.date
    as_of: dt.datetime
    origin: str | None = None
    category: str | None = None
    country: str | None = None
    since: dt.date | None = None
    excluded_orders: tuple[str, ...] = ()
    excluded_customers: tuple[str, ...] = ()
    buyer_days: int | str = 30
    granularity: str = "month"
    currency: str = "EUR"
    wilaya: str | None = None
    periods: tuple[int, ...] | None = None  # None: all that the range can hold


def reports(tables: dict[str, DataFrame], p: ReportParams, materialize_inputs: bool = True) -> dict[str, DataFrame]:
    """Every report as a lazy DataFrame, keyed by report name.

    ``tables`` holds the raw exports: ``orders``, ``ltv``, ``users``, ``geo``
    and optionally ``downloads`` and ``first_open``.
    """
    orders = op.clean_orders(tables["orders"], p.excluded_orders, p.excluded_customers)
    ltv = op.clean_ltv(tables["ltv"], p.excluded_orders, p.excluded_customers)
    users = op.clean_users(tables["users"], p.excluded_customers)
    if materialize_inputs:
        orders, ltv, users = materialize(orders, "orders_clean"), materialize(ltv, "ltv_clean"), materialize(users, "users_clean")

    counts = op.cohort_counts(orders, p.origin, p.category, p.start, p.end)
    if materialize_inputs:  # six reports start from these few rows
        counts = materialize(counts, "cohort_counts")
    periods = op.period_range(p.start, p.end) if p.periods is None else p.periods
    cat_ltv = op.category_ltv(ltv, p.origin, p.start, p.end)
    summary = op.category_ltv_summary(cat_ltv)
    communes = op.customers_by_commune(tables["geo"])
    signups = op.new_signups(users, p.origin, p.country, p.start, p.end)
    flags = op.order_flags(orders, p.since, p.category)
    out = {
        "orders": op.slice_rows(orders, {"origin": p.origin, "business_cat": p.category}, "date", p.start, p.end),
        "cohort_counts": counts,
        "cohort_matrix": op.cohort_matrix(counts, periods),
        "retention": op.retention(counts),
        "retention_matrix": op.retention_matrix(counts, periods),
        "retention_text": op.retention_text(counts),
        "churn_deltas": op.churn_deltas(counts),
        "customer_ltv": op.customer_ltv(ltv, p.origin, p.category, p.start, p.end),
        "category_ltv_summary": op.category_ltv_summary(cat_ltv, formatted=True),
        "ltv_series": op.ltv_series(summary, p.currency),
        "customers_by_commune": op.with_position(communes, F.desc("n_customers"), "commune"),
        "commune_map_points": op.commune_map_points(communes, p.wilaya),
        "wilaya_centres": op.wilaya_centres(communes),
        "signups_by_period": op.signups_by_period(signups, p.granularity),
        "retarget_buyers": op.retarget_buyers(orders, p.buyer_days, p.as_of, _one(p.origin), _one(p.category)),
        "retarget_buyers_rows": op.retarget_buyers(orders, p.buyer_days, p.as_of, _one(p.origin), _one(p.category), latest_only=False),
        "retarget_non_buyers": op.non_buyer_buckets(orders, p.as_of, _one(p.origin), _one(p.category)),
    }
    if "downloads" in tables and "first_open" in tables:
        dl = op.downloads_slice(tables["downloads"], p.origin, p.start, p.end)
        fo = op.first_open_signups(users, tables["first_open"], p.origin, p.start, p.end)
        out["funnel_metrics"] = op.funnel_metrics(dl, signups, fo, flags, formatted=True)
    else:
        fo = None
    out["funnel_segments"] = op.segments_long(signups, flags, fo)
    return out


def _one(value):
    return None if value is None else [value]


def report_folder(out_base: str, p: ReportParams) -> str:
    """Where the sets of one parameter choice are: the short parameters by name, all of them by a hash."""
    given = {f.name: getattr(p, f.name) for f in fields(p)}
    named = {k: given[k] for k in ("origin", "category", "start", "end")}
    return report_path(out_base, "reports", **named, params=parameters_key(given))


def refresh(tables: dict[str, DataFrame], p: ReportParams, out_base: str, fmt: str = "parquet") -> dict[str, str]:
    """Write every report and publish them as one set; returns ``{report: path}``.

    Runs that differ in any parameter have folders of their own. A run that fails publishes nothing.
    """
    spark = tables["orders"].sparkSession

    def write(folder: str) -> dict[str, str]:
        written = {}
        for name, df in reports(tables, p).items():
            path = f"{folder}/{name}"
            if name == "funnel_segments":
                write_segments(df, path)
            else:
                write_report(df, path, fmt)
            written[name] = path
        return written

    given = {f.name: getattr(p, f.name) for f in fields(p)}
    return publish(spark, report_folder(out_base, p), given, write)["reports"]


def read_exports(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    """The exports as they are: files of any column order, locations without a key, sheets in the order given.

    With ``--misfits``, cells of orders, LTV rows and users that do not fit their columns are written there, and their rows left out.
    """
    def table(path: str, name: str, schema, **options) -> DataFrame:
        if not args.misfits:
            return read_csv_table(spark, path, schema, **options)
        good, bad = read_csv_with_misfits(spark, path, schema, keys=("customer_id",), **options)
        bad.write.mode("overwrite").parquet(f"{args.misfits}/{name}")
        return good

    tables = {
        "orders": table(args.orders, "orders", RAW_ORDERS),
        "ltv": table(args.ltv, "ltv", RAW_LTV, round_decimals=True),  # money is exported as floats
        "users": table(args.users, "users", RAW_USERS),
        "geo": read_csv_table(spark, args.geo, RAW_GEO_EXPORT, position="row_key"),
    }
    if args.downloads and args.first_open:
        tables["downloads"] = typed_by_value(read_text_sheet(spark, args.downloads), rename=DOWNLOADS_COLUMNS)
        tables["first_open"] = read_sheets(spark, args.first_open)
    return tables


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description="Refresh all customer-commerce reports")
    for name in ("orders", "ltv", "users", "geo"):
        ap.add_argument(f"--{name}", required=True)
    ap.add_argument("--downloads")
    ap.add_argument("--first-open", dest="first_open", nargs="+", help="the sheets, in their order")
    ap.add_argument("--misfits", help="folder for rows with cells that do not fit; without it such a cell stops the run")
    ap.add_argument("--out", required=True)
    ap.add_argument("--start", required=True, type=dt.date.fromisoformat)
    ap.add_argument("--end", required=True, type=dt.date.fromisoformat)
    ap.add_argument("--as-of", required=True, type=dt.datetime.fromisoformat)
    ap.add_argument("--origin")
    ap.add_argument("--category")
    ap.add_argument("--country")
    ap.add_argument("--since", type=dt.date.fromisoformat)
    ap.add_argument("--exclude-order", dest="excluded_orders", action="append", default=[])
    ap.add_argument("--exclude-customer", dest="excluded_customers", action="append", default=[])
    ap.add_argument("--buyer-days", dest="buyer_days", default=30, type=lambda v: int(v) if v.isdigit() else v)
    ap.add_argument("--granularity", default="month", choices=("day", "week", "month"))
    ap.add_argument("--currency", default="EUR", choices=("EUR", "DZD"))
    ap.add_argument("--wilaya")
    ap.add_argument("--periods", type=int, nargs="+")
    ap.add_argument("--format", default="parquet", choices=("parquet", "csv"))
    args = ap.parse_args(argv)
    spark = build_session()
    given = {f.name: getattr(args, f.name) for f in fields(ReportParams)}
    params = ReportParams(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
    for name, path in refresh(read_exports(spark, args), params, args.out, args.format).items():
        print(f"{name}\t{path}")
    remove_scratch(spark)


if __name__ == "__main__":
    main()
