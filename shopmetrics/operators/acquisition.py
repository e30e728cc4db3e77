"""Sign-up funnel.

The reference derives seven customer sets with a chain of dedupes and
anti joins over the sign-up orders. Here one aggregation per customer
reduces the orders (first order row, any completed order). The metrics and
the export of all sets come from one left join of the (deduplicated)
sign-ups to that table; a single segment is a filter on the inner join,
and "never ordered" an anti join with the reduced customers alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import fold_status
from ..functions.textfmt import thousands
from ..functions.timefn import month_label, sunday_week_start
from ..vocab import COMPLETED, IN_PROGRESS
from .dedupe import keep_first
from .skew import spread_join
from .slices import since as since_filter
from .slices import slice_rows

SIGNUP_COLUMNS = (
    "date", "customer_id", "last_name", "first_name", "phone", "email", "customer_country", "origin",
)
ORDER_ORDER = ("date", "order_id")
SIGNUP_ORDER = ("date", "email")

# The eight funnel measures in the reference's display order.
FUNNEL_MEASURES = (
    "downloads",
    "new_signups",
    "signups_never_ordered",
    "signups_first_open",
    "signups_ordered",
    "signups_ordered_not_purchased",
    "signups_checkout_abandoned",
    "signups_purchased",
)


def new_signups(users: DataFrame, origin=None, country=None, start=None, end=None) -> DataFrame:
    """Users registered in the range, optionally of one origin / country."""
    sl = slice_rows(users, {"origin": origin, "customer_country": country}, "date", start, end)
    return sl.select(*SIGNUP_COLUMNS)


def signups_by_period(signups: DataFrame, granularity: str = "month") -> DataFrame:
    """Sign-ups per day, Sunday-based week or ``yyyy-MM`` month (R12: A11, X3–X5).

    The reference overwrote the label of its first bar with ``start +
    duration`` (T16); here every period keeps its own label.
    """
    if granularity == "day":
        period = F.to_date("date")
    elif granularity == "week":
        period = sunday_week_start("date")
    elif granularity == "month":
        period = month_label("date")
    else:
        raise ValueError("granularity must be day, week or month")
    return (
        signups.select(period.alias("period"))
        .filter(F.col("period").isNotNull())
        .groupBy("period")
        .agg(F.count(F.lit(1)).alias("n_signups"))
    )


def downloads_slice(downloads: DataFrame, origin=None, start=None, end=None) -> DataFrame:
    """Downloads sheet sliced by origin and date."""
    return slice_rows(downloads, {"customer_origine": origin}, "date", start, end)


def first_open_signups(
    users: DataFrame,
    first_open: DataFrame,
    origin=None,
    start=None,
    end=None,
    sheet_order: Sequence[str] = ("sheet_no", "row_key"),
    user_order: Sequence[str] = ("date", "customer_id"),
) -> DataFrame:
    """Sign-ups that also appear in the first-open sheets (R13: S6, D1, J1).

    Sheets are deduplicated by e-mail keeping the first row (sheet order,
    then row order); users are sliced by origin and registration date and
    deduplicated by e-mail keeping the first; the two join one row to one.
    (The reference joined first and deduplicated after; the slice is on user
    columns and every user row of an e-mail meets the same sheet row, so the
    result is the same, while a shared e-mail can no longer gather its rows
    in one task.)
    """
    carried = [c for c in first_open.columns if c not in ("email", *sheet_order)]
    fo = keep_first(first_open.select("email", *carried, *sheet_order), ["email"], sheet_order)
    info = users.select("date", "email", "phone", "origin", "customer_id")
    info = keep_first(slice_rows(info, {"origin": origin}, "date", start, end), ["email"], user_order)
    return info.join(fo.select("email", *carried), "email", "inner")


def _order_rows(orders: DataFrame, since=None) -> DataFrame:
    o = orders if since is None else since_filter(orders, since)
    return o.select(
        "date", "customer_id", "order_id", "status",
        F.col("origin").alias("orders_origin"), "business_cat", "total_amount_dzd",
    ).withColumn("new_status", fold_status("status"))


def signup_orders(orders: DataFrame, signups: DataFrame, since=None, spread: bool = False) -> DataFrame:
    """Orders of the new sign-ups since a date, with a two-value status (R14: F12, J2, P14).

    With ``spread``, customers with very many orders are found by a frequency sketch first (a pass over the ids)
    and their orders dealt over several tasks (``skew.spread_join``); without, that is left to AQE's skew join.
    """
    s = signups.withColumnRenamed("date", "registration_date")
    rows = _order_rows(orders, since)
    if spread:
        return spread_join(rows, s, "customer_id", "order_id")
    return rows.join(s, "customer_id", "inner")


def order_flags(
    orders: DataFrame,
    since=None,
    category=None,
    order_by: Sequence[str] = ORDER_ORDER,
) -> DataFrame:
    """One row per customer who ordered: their first order row since ``since``
    (by ``order_by``, within the category) and whether any of those orders is
    completed (T17: "purchased" tests the first row, "reached checkout"
    tests all rows).

    The orders are reduced per customer *before* meeting the sign-ups: a
    join on the customer followed by a per-customer aggregate would reuse
    the join's partitioning and send a heavy customer's rows to one task
    with no partial aggregation; reduced first, the join is one row to one.
    """
    rows = _order_rows(orders, since)
    if category is not None:
        rows = rows.filter(F.col("business_cat") == category)
    rows = rows.filter(F.col("customer_id").isNotNull())
    rest = [c for c in rows.columns if c != "customer_id"]
    return (
        rows.groupBy("customer_id")
        .agg(
            F.min_by(F.struct(*rest), F.struct(*order_by)).alias("_first"),
            F.max((F.col("new_status") == COMPLETED).cast("int")).alias("_any_completed"),
        )
        .select("customer_id", *[F.col(f"_first.{c}").alias(c) for c in rest],
                (F.col("_any_completed") == 1).alias("any_completed"))
    )


def signup_flags(
    orders: DataFrame,
    signups: DataFrame,
    since=None,
    category=None,
    order_by: Sequence[str] = ORDER_ORDER,
) -> DataFrame:
    """``order_flags`` of the customers who are sign-ups, with their sign-up columns."""
    flags = order_flags(orders, since, category, order_by)
    return flags.join(distinct_signups(signups).withColumnRenamed("date", "registration_date"), "customer_id")


def distinct_signups(signups: DataFrame, order_by: Sequence[str] = SIGNUP_ORDER) -> DataFrame:
    """One sign-up row per customer id (NULL ids dropped, T3)."""
    return keep_first(signups.filter(F.col("customer_id").isNotNull()), ["customer_id"], order_by)


def funnel_segments(signups: DataFrame, flags: DataFrame, ordered_ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """The six customer sets of the funnel (R15), one row per customer.

    ``flags`` is ``signup_flags``. With ``ordered_ids`` (``order_flags``), "not ordered" meets these
    instead of ``flags``, which has joined the sign-ups already.
    """
    first_ok = F.col("new_status") == COMPLETED
    ordered = flags.drop("any_completed")
    return {
        "ordered": ordered,
        "not_ordered": distinct_signups(signups).join(
            (flags if ordered_ids is None else ordered_ids).select("customer_id"), "customer_id", "left_anti"
        ),
        "completed": flags.filter(first_ok).drop("any_completed"),
        "in_progress": flags.filter(F.col("status") == IN_PROGRESS).drop("any_completed"),
        "checkout_abandoned": flags.filter(
            (F.col("status") == IN_PROGRESS) & ~F.col("any_completed")
        ).drop("any_completed"),
        "not_completed": flags.filter(~first_ok).drop("any_completed"),
    }


SEGMENT_ORDER_COLUMNS = ("order_date", "order_id", "status", "new_status", "orders_origin", "business_cat", "total_amount_dzd", "first_open_date")


def segments_long(signups: DataFrame, flags: DataFrame, first_open: DataFrame | None = None) -> DataFrame:
    """The funnel's sets, the first-open sign-ups and all new sign-ups as one long table for export
    partitioned by ``segment`` (S10), with every column of each set; those a set lacks are NULL. ``new_signups`` is the whole
    sign-up table (an id may repeat or be missing); the funnel's sets hold one row a customer.

    ``flags`` is ``order_flags``: the (deduplicated) sign-ups meet it in one left join, and each row
    is repeated for the sets it is in. ``registration_date`` is the sign-up's date.
    """
    own = distinct_signups(signups).withColumnRenamed("date", "registration_date")
    rows = own.join(flags.withColumnRenamed("date", "order_date"), "customer_id", "left")
    ordered, first_ok = F.col("new_status").isNotNull(), F.col("new_status") == COMPLETED
    in_progress = F.col("status") == IN_PROGRESS
    member = {
        "not_ordered": ~ordered,
        "ordered": ordered,
        "completed": first_ok,
        "in_progress": in_progress,
        "checkout_abandoned": in_progress & ~F.col("any_completed"),
        "not_completed": ordered & ~first_ok,
    }
    sets = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in member.items()]))
    columns = [*own.columns, *(c for c in SEGMENT_ORDER_COLUMNS if c in rows.columns)]
    long = rows.select(F.explode(sets).alias("segment"), *columns)
    every = signups.withColumnRenamed("date", "registration_date").withColumn("segment", F.lit("new_signups"))
    long = long.unionByName(every, allowMissingColumns=True)
    if first_open is None:
        return long
    opened = first_open.withColumnRenamed("date", "registration_date").withColumn("segment", F.lit("first_open"))
    return long.unionByName(opened, allowMissingColumns=True)


def funnel_metrics(
    downloads: DataFrame,
    signups: DataFrame,
    first_open: DataFrame,
    flags: DataFrame,
    formatted: bool = False,
) -> DataFrame:
    """The eight funnel numbers in display order (R16: A12, A13, P17, X15).

    Counts 2, 3 and 5–8 come from a single pass over sign-ups left-joined
    to ``flags`` (``order_flags``); downloads and first-open are one aggregate each.
    """
    s = distinct_signups(signups).select("customer_id")
    f = flags.select(
        "customer_id",
        (F.col("new_status") == COMPLETED).alias("_first_ok"),
        (F.col("status") == IN_PROGRESS).alias("_in_progress"),
        "any_completed",
    )
    sj = s.join(f, "customer_id", "left")
    ordered = F.col("_first_ok").isNotNull()

    def n(cond):
        return F.count(F.when(cond, F.lit(1)))

    counts = sj.agg(
        F.count(F.lit(1)).alias("new_signups"),
        n(~ordered).alias("signups_never_ordered"),
        n(ordered).alias("signups_ordered"),
        n(ordered & ~F.col("_first_ok")).alias("signups_ordered_not_purchased"),
        n(F.col("_in_progress") & ~F.col("any_completed")).alias("signups_checkout_abandoned"),
        n(F.col("_first_ok")).alias("signups_purchased"),
    )
    dl = downloads.agg(F.coalesce(F.sum("downloads"), F.lit(0)).cast("long").alias("downloads"))
    fo = first_open.agg(F.count(F.lit(1)).alias("signups_first_open"))

    def as_rows(one_row: DataFrame) -> DataFrame:
        cols = one_row.columns
        return one_row.select(*[F.col(c).cast("long") for c in cols]).unpivot([], cols, "measure", "value")

    long = as_rows(dl).unionByName(as_rows(counts)).unionByName(as_rows(fo))
    order = F.array_position(F.array(*[F.lit(m) for m in FUNNEL_MEASURES]), F.col("measure"))
    out = long.select(order.cast("int").alias("ord"), "measure", "value")
    if formatted:
        out = out.select("ord", "measure", thousands("value", " ").alias("value"))
    return out
