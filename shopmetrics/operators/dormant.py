"""Operators that exist only as commented-out code in the reference.

Built for completeness of the inventory; Z6 lives in ``retargeting`` and
Z7 is ``slice_rows(equals={"status": ...})``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..vocab import COMPLETED
from .clean import payment_screen_view
from .dedupe import keep_last
from .slices import slice_rows

SCREEN_DATE = "Date de Payment method screen"


def payment_screen_table(sheet: DataFrame, date_col: str = SCREEN_DATE) -> DataFrame:
    """All-text payment-screen sheet → ``(email, date)`` with the date as a
    day (Z1: header promoted by the reader, column renamed, P3)."""
    return sheet.select("email", F.to_date(F.col(date_col)).alias("date"))


def checkout_payment_screen(
    users: DataFrame,
    sheet: DataFrame,
    orders: DataFrame,
    start=None,
    end=None,
    origin=None,
    order_by: Sequence[str] = ("date", "order_id"),
) -> DataFrame:
    """Users who reached the payment screen on a day they placed an order
    that did not complete, one row per e-mail (the latest) (Z1–Z5).

    The order view, without completed orders, meets the screen sheet on the composite key (e-mail, day); the last
    such order per e-mail joins the user of that e-mail (registration date renamed). A
    NULL status counts as not completed (T5). Optional slice on the
    registration date (Z5).
    """
    u = users.select(
        F.col("date").alias("date_registration"), "email", "phone", "origin", "customer_id"
    )
    u = slice_rows(u, {"origin": origin}, "date_registration", start, end)
    # Users sharing an e-mail meet the same screen days and orders, and the
    # last row per e-mail wins; keeping the last user per e-mail first avoids
    # k users × d days pairs for a shared address.
    u = keep_last(u, ["email"], ["date_registration", "customer_id"])
    # The reference matches the order timestamp against the screen day at
    # midnight; orders later in the day therefore do not match.
    ov = payment_screen_view(orders).filter(~F.coalesce(F.col("status") == COMPLETED, F.lit(False)) & (F.col("date") == F.to_timestamp_ntz(F.to_date("date"))))
    ov = ov.withColumn("date", F.to_date("date"))
    # One row per e-mail is kept, so the sheet, which repeats (e-mail, day) for every visit, only has to hold the
    # order's day (a semi join: no pairs), and the orders are reduced per e-mail before they meet the users.
    seen = ov.join(payment_screen_table(sheet), ["email", "date"], "left_semi")
    last = keep_last(seen, ["email"], list(order_by))
    return u.join(last, "email", "inner").select(
        "email", "date", "date_registration", "phone", "origin", "customer_id", *[c for c in last.columns if c not in ("email", "date")]
    )
