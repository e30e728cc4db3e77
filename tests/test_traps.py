"""One small hand-written table per semantic trap."""

import datetime as dt

from pyspark.sql import functions as F

from shopmetrics import operators as op
from shopmetrics.functions import (
    fold_status,
    half_even_ratio,
    not_in_null_safe,
    percent_text,
    short2_text,
    strip_float_suffix,
    strip_list_marks,
    sunday_week_start,
    thousands,
    whole_days,
)
from shopmetrics.schemas import ORDERS

T0 = dt.datetime(1998, 12, 31)


def order_row(order_id, customer_id, date, status="COMPLETED", cat="Airtime", origin="Local", prev=None):
    return (
        date, status, origin, "CARD", order_id, "INTERNE", cat, customer_id, 1, prev, False,
        f"user{customer_id}", "+213", f"{customer_id}@x", 100.0,
    )


def orders_df(spark, rows):
    return spark.createDataFrame(rows, ORDERS)


# T2, T4, T5 ---------------------------------------------------------------

def test_id_suffix_and_list_marks(spark):
    df = spark.createDataFrame([("1234.0",), ("1234.05",), (None,)], "x string")
    got = [r[0] for r in df.select(strip_float_suffix("x")).collect()]
    assert got == ["1234", "1234.05", None]
    tags = spark.createDataFrame([("['A', \"B\"]",)], "t string")
    assert tags.select(strip_list_marks("t")).first()[0] == "A, B"


def test_not_in_keeps_null_and_status_fold(spark):
    df = spark.createDataFrame([("COMPLETED",), ("ABANDONED",), (None,)], "s string")
    kept = [r[0] for r in df.filter(not_in_null_safe("s", ["ABANDONED"])).collect()]
    assert sorted(kept, key=str) == ["COMPLETED", None] or sorted(kept, key=str) == [None, "COMPLETED"]
    folded = [r[0] for r in df.select(fold_status("s")).collect()]
    assert folded == ["COMPLETED", "NOT COMPLETED", "NOT COMPLETED"]


def test_exclude_ids_keeps_null_keys(spark):
    rows = [order_row("1", "5", T0), order_row("2", None, T0), order_row("3", "6", T0)]
    df = orders_df(spark, rows)
    from shopmetrics.functions import exclude_ids

    assert {r.order_id for r in exclude_ids(df, "customer_id", ["5"]).collect()} == {"2", "3"}
    ids = spark.createDataFrame([("5",)], "id string")
    assert {r.order_id for r in exclude_ids(df, "customer_id", ids).collect()} == {"2", "3"}


# T6 -------------------------------------------------------------------------

def test_date_range_ends_at_midnight(spark):
    rows = [
        order_row("1", "1", dt.datetime(1998, 12, 31, 0, 0)),
        order_row("2", "1", dt.datetime(1998, 12, 31, 13, 0)),
        order_row("3", "1", None),
    ]
    out = op.slice_rows(orders_df(spark, rows), {}, "date", dt.date(1998, 1, 1), dt.date(1998, 12, 31))
    assert [r.order_id for r in out.collect()] == ["1"]


# T7 -------------------------------------------------------------------------

def test_whole_days_floor(spark):
    pairs = [
        (dt.datetime(2000, 1, 1, 23), dt.datetime(2000, 1, 2, 1), 0),
        (dt.datetime(2000, 1, 1, 0), dt.datetime(2000, 1, 2, 0), 1),
        (dt.datetime(2000, 1, 2, 0), dt.datetime(2000, 1, 1, 12), -1),
    ]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(whole_days("b", "a")).collect()]
    assert got == [p[2] for p in pairs]


# T8, T9, X10, X13–X15 ------------------------------------------------------

def test_half_even_percent_text(spark):
    df = spark.createDataFrame([(1, 8), (97, 800), (291, 800), (2, 3), (1, 0)], "n long, d long")
    got = [tuple(r) for r in df.select(half_even_ratio("n", "d", 4), percent_text("n", "d")).collect()]
    # 12.125 % → 12.12 (even), 36.375 % → 36.38 (even), 66.666 % → 66.67, 1/0 → missing
    assert got == [(1250, "12.50"), (1212, "12.12"), (3638, "36.38"), (6667, "66.67"), (None, "")]
    short = [r[0] for r in df.select(short2_text(F.lit(1250))).limit(1).collect()]
    assert short == ["12.5"]


def test_thousands_separators(spark):
    df = spark.createDataFrame([(1234567,), (12,)], "v long")
    assert [r[0] for r in df.select(thousands("v", ".")).collect()] == ["1.234.567", "12"]
    assert [r[0] for r in df.select(thousands("v", " ")).collect()] == ["1 234 567", "12"]


def test_summary_rounding_and_zero_gmv(spark):
    # two customers averaging 2.5 → half-even → 2 ; GMV mean 0 → NULL share
    cat = spark.createDataFrame(
        [("A", 2.0, 1.0, 2.0, 1.0), ("A", 3.0, 1.0, 3.0, 1.0), ("B", 0.0, 0.0, 0.0, 0.0)],
        "business_cat string, ltv_gmv_eur double, ltv_margin_eur double, ltv_gmv_dzd double, ltv_margin_dzd double",
    )
    rows = {r.business_cat: r for r in op.category_ltv_summary(cat).collect()}
    assert rows["A"].ltv_gmv_eur == 2 and rows["A"].ltv_gmv_dzd == 2
    assert rows["A"].category_label == "A (50.0%)"
    assert rows["B"].margin_share_pct is None


# T10, T11 -------------------------------------------------------------------

def test_cohort_and_churn_with_gap(spark):
    d = dt.datetime
    rows = [
        # customer a: months 0 and 2 of cohort 1998-01
        order_row("1", "a", d(1998, 1, 5)), order_row("2", "a", d(1998, 3, 5)),
        # customer b: months 0, 1, 2 of cohort 1998-01
        order_row("3", "b", d(1998, 1, 6)), order_row("4", "b", d(1998, 2, 6)), order_row("5", "b", d(1998, 3, 6)),
        # customer c: cohort 1998-02 active in 0 and 1 ... but also ordered in 1997 (outside slice, T10)
        order_row("6", "c", d(1997, 6, 1)), order_row("7", "c", d(1998, 2, 9)), order_row("8", "c", d(1998, 3, 9)),
        # d: not completed → ignored; e: null id → dropped
        order_row("9", "d", d(1998, 1, 9), status="In_Progress"), order_row("10", None, d(1998, 1, 9)),
    ]
    counts = op.cohort_counts(orders_df(spark, rows), start=dt.date(1998, 1, 1), end=dt.date(1998, 12, 31))
    got = {(r.cohort.isoformat(), r.period_number): r.n_customers for r in counts.collect()}
    assert got == {("1998-01-01", 0): 2, ("1998-01-01", 1): 1, ("1998-01-01", 2): 2,
                   ("1998-02-01", 0): 1, ("1998-02-01", 1): 1}
    ret = {(r.cohort.isoformat(), r.period_number): r.retention_rate for r in op.retention(counts).collect()}
    assert ret[("1998-01-01", 0)] == 1.0 and ret[("1998-02-01", 0)] == 1.0
    churn = {(r.cohort.isoformat(), r.period_number): r.churn for r in op.churn_deltas(counts).collect()}
    assert churn == {("1998-01-01", 0): 2, ("1998-01-01", 1): -1, ("1998-01-01", 2): 1,
                     ("1998-02-01", 0): 1, ("1998-02-01", 1): 0}
    # gap: a cohort with cells at 0 and 2 only has a missing churn at 2
    gap = spark.createDataFrame(
        [(dt.date(1998, 1, 1), 0, 5), (dt.date(1998, 1, 1), 2, 3), (dt.date(1998, 2, 1), 0, 4), (dt.date(1998, 2, 1), 1, 2)],
        "cohort date, period_number int, n_customers long",
    )
    churn = {(r.cohort.isoformat(), r.period_number): r.churn for r in op.churn_deltas(gap).collect()}
    assert churn[("1998-01-01", 2)] is None and churn[("1998-02-01", 1)] == -2


# T1 / D1–D3 -----------------------------------------------------------------

def test_keep_first_last_with_equal_dates(spark):
    rows = [order_row("20", "a", T0), order_row("10", "a", T0), order_row("30", "b", T0)]
    df = orders_df(spark, rows)
    first = {r.customer_id: r.order_id for r in op.keep_first(df, ["customer_id"], ["date", "order_id"]).collect()}
    last = {r.customer_id: r.order_id for r in op.keep_last(df, ["customer_id"], ["date", "order_id"]).collect()}
    assert first == {"a": "10", "b": "30"} and last == {"a": "20", "b": "30"}


def test_dedupe_does_not_depend_on_partitioning(spark):
    rows = [order_row(str(i), str(i % 7), T0 - dt.timedelta(days=i % 5)) for i in range(200)]
    df = orders_df(spark, rows)
    a = sorted(map(tuple, op.keep_first(df, ["customer_id"], ["date", "order_id"]).collect()))
    b = sorted(map(tuple, op.keep_first(df.repartition(13).sortWithinPartitions(F.rand(1)), ["customer_id"],
                                        ["date", "order_id"]).collect()))
    assert a == b


# F17, A5 ------------------------------------------------------------------------

def test_ltv_lifetime_filter(spark):
    d = dt.datetime
    rows = [
        ("1", "a", "COMPLETED", "Airtime", "Local", d(2000, 1, 1, 23), 10, 1, 1, 1),
        ("2", "a", "COMPLETED", "Airtime", "Local", d(2000, 1, 2, 1), 10, 1, 1, 1),  # 2 h apart → 0 days
        ("3", "b", "COMPLETED", "Airtime", "Local", d(2000, 1, 1), 10, 1, 1, 1),
        ("4", "b", "COMPLETED", "Airtime", "Local", d(2000, 1, 31), 20, 1, 1, 1),  # 30 days → 1 month
        ("5", "c", "COMPLETED", "Airtime", "Local", d(2000, 1, 1), 10, 1, 1, 1),  # single order
    ]
    df = spark.createDataFrame(
        rows,
        "order_id string, customer_id string, status string, business_cat string, origin string, "
        "date timestamp_ntz, total_amount_dzd int, total_amount_eur int, margin_dzd int, margin_eur int",
    ).withColumns({c: F.col(c).cast("decimal(18,2)") for c in
                   ["total_amount_dzd", "total_amount_eur", "margin_dzd", "margin_eur"]})
    out = op.customer_ltv(df).collect()
    assert [r.customer_id for r in out] == ["b"]
    r = out[0]
    assert r.lifetime_months == 1.0 and r.n_orders == 2 and r.ltv_gmv_dzd == 30.0 and r.gmv_dzd == 30.0


# T12–T14 ------------------------------------------------------------------------

def test_recency_buckets_and_cumulative(spark):
    as_of = dt.datetime(2001, 9, 1, 12, 0)
    days = [6, 7, 13, 14, 20, 21, 29, 30, 59, 60, 89, 90, 119, 120, 121, -1]
    rows = [order_row(str(i), f"c{i}", as_of - dt.timedelta(days=n), status="In_Progress",
                      prev=as_of - dt.timedelta(days=n)) for i, n in enumerate(days)]
    df = orders_df(spark, rows)
    tagged = {r.customer_id: r.bucket for r in op.non_buyer_buckets(df, as_of).collect()}
    expect = {6: "7", 7: "14", 13: "14", 14: "21", 20: "21", 21: "30", 29: "30", 30: "60", 59: "60",
              60: "90", 89: "90", 90: "120", 119: "120", 121: "over_120", -1: "7"}
    assert tagged == {f"c{i}": expect[n] for i, n in enumerate(days) if n in expect}
    # buyers: cumulative window on previous_order_date
    done = orders_df(spark, [(*r[:1], "COMPLETED", *r[2:]) for r in rows])
    within_30 = {r.customer_id for r in op.retarget_buyers(done, 30, as_of).collect()}
    assert within_30 == {f"c{i}" for i, n in enumerate(days) if n <= 30}
    over = {r.customer_id for r in op.retarget_buyers(done, "over_120", as_of).collect()}
    assert over == {f"c{i}" for i, n in enumerate(days) if n > 120}


def test_non_buyers_exclude_any_completed(spark):
    rows = [order_row("1", "a", T0, status="In_Progress"), order_row("2", "a", T0 + dt.timedelta(days=1)),
            order_row("3", "b", T0, status=None), order_row("4", "b", T0 + dt.timedelta(days=2), status="CANCELED")]
    nb = op.non_buyers(orders_df(spark, rows)).collect()
    assert [(r.customer_id, r.order_id) for r in nb] == [("b", "4")]


# A9, A10, J4, X16 ---------------------------------------------------------------

def test_commune_first_values_and_single_commune_size(spark):
    geo = spark.createDataFrame(
        [(1, "X", None, None, 1.0), (2, "X", "W2", 10.0, None), (3, "X", "W3", 11.0, 2.0), (4, None, "W1", 5.0, 5.0)],
        "row_key long, commune string, wilaya string, Latitude double, Longitude double",
    )
    c = op.customers_by_commune(geo).collect()
    assert len(c) == 1
    r = c[0]
    assert (r.commune, r.n_customers, r.latitude, r.longitude, r.wilaya) == ("X", 3, 10.0, 1.0, None)
    pts = op.commune_map_points(op.customers_by_commune(geo)).collect()
    assert pts[0].marker_size == 20.0


def test_marker_size_interpolation(spark):
    communes = spark.createDataFrame(
        [("a", 1, 0.0, 0.0, "W"), ("b", 10, 0.0, 0.0, "W"), ("c", 100, 0.0, 0.0, "W")],
        "commune string, n_customers long, latitude double, longitude double, wilaya string",
    )
    sizes = {r.commune: r.marker_size for r in op.commune_map_points(communes, "W").collect()}
    assert sizes == {"a": 5.0, "b": 12.5, "c": 20.0}


# T16 / X4 --------------------------------------------------------------------------

def test_signup_periods(spark):
    users = spark.createDataFrame(
        [(dt.date(2020, 5, 5),), (dt.date(2020, 5, 3),), (dt.date(2020, 5, 9),), (dt.date(2020, 6, 1),)], "date date"
    )
    wk = {r.period.isoformat(): r.n_signups for r in op.signups_by_period(users, "week").collect()}
    assert wk == {"2020-05-03": 3, "2020-05-31": 1}
    mo = {r.period: r.n_signups for r in op.signups_by_period(users, "month").collect()}
    assert mo == {"2020-05": 3, "2020-06": 1}
    assert users.select(sunday_week_start("date")).count() == 4


# T17 funnel invariants ---------------------------------------------------------------

def test_funnel_segments_and_invariants(spark):
    d = dt.datetime(2001, 2, 1)
    users = spark.createDataFrame(
        [(dt.date(2000, 1, 1), c, "L", "F", "p", f"{c}@x", "N", "Local") for c in "abcde"],
        "date date, customer_id string, last_name string, first_name string, phone string, email string, "
        "customer_country string, origin string",
    )
    rows = [
        order_row("1", "a", d, status="COMPLETED"),                       # purchased
        order_row("2", "b", d, status="In_Progress"),                     # first row in progress ...
        order_row("3", "b", d + dt.timedelta(days=1), status="COMPLETED"),  # ... but completed later
        order_row("4", "c", d, status="In_Progress"),                     # checkout abandoned
        order_row("5", "d", d, status=None),                              # ordered, not purchased
    ]
    flags = op.signup_flags(orders_df(spark, rows), users, dt.date(2001, 1, 1))
    seg = {k: sorted(r.customer_id for r in v.collect()) for k, v in op.funnel_segments(users, flags).items()}
    assert seg == {
        "ordered": ["a", "b", "c", "d"], "not_ordered": ["e"], "completed": ["a"],
        "in_progress": ["b", "c"], "checkout_abandoned": ["c"], "not_completed": ["b", "c", "d"],
    }
    dl = spark.createDataFrame([(dt.date(2001, 1, 1), "Local", 1200)], "date date, customer_origine string, downloads long")
    fo = users.limit(2)
    m = {r.measure: r.value for r in op.funnel_metrics(dl, users, fo, flags).collect()}
    assert m["new_signups"] == m["signups_ordered"] + m["signups_never_ordered"]
    assert m["signups_ordered"] == m["signups_purchased"] + m["signups_ordered_not_purchased"]
    assert m["downloads"] == 1200 and m["signups_first_open"] == 2 and m["signups_checkout_abandoned"] == 1
    txt = {r.measure: r.value for r in op.funnel_metrics(dl, users, fo, flags, formatted=True).collect()}
    assert txt["downloads"] == "1 200"


# T20 --------------------------------------------------------------------------------

def test_empty_slice_keeps_schema(spark):
    df = orders_df(spark, [order_row("1", "a", T0)])
    counts = op.cohort_counts(df, start=dt.date(1990, 1, 1), end=dt.date(1990, 12, 31))
    assert counts.count() == 0 and counts.columns == ["cohort", "period_number", "n_customers"]
    assert op.cohort_matrix(counts).columns[:2] == ["cohort", "period_0"]


# T3, T18 -----------------------------------------------------------------------------

def test_null_ids_dropped_or_kept_as_one_customer(spark):
    from shopmetrics.schemas import RAW_ORDERS

    def raw(order_id, cid, month):
        return (order_id, cid, dt.datetime(1998, month, 3), "COMPLETED", "Local", "CARD", "INTERNE",
                "Recharge mobile", 1, None, False, "u", "p", "e", 10.0)

    rows = [raw("1", None, 1), raw("2", None, 2), raw("3", "7.0", 1), raw("4", "8.0", 1)]
    df = spark.createDataFrame(rows, RAW_ORDERS)
    dropped = op.cohort_counts(op.clean_orders(df))
    assert {(r.period_number, r.n_customers) for r in dropped.collect()} == {(0, 2)}
    as_nan = op.clean_orders(df, null_id_text="nan")
    assert {r.customer_id for r in as_nan.collect()} == {"nan", "7", "8"}
    counts = {(r.period_number, r.n_customers) for r in op.cohort_counts(as_nan).collect()}
    assert counts == {(0, 3), (1, 1)}
    # the order-type override is a parameter (the reference's never matched)
    over = op.clean_orders(df, order_type_overrides=["7"])
    assert {r.customer_id: r.order_type for r in over.collect()}["7"] == "EXTERNE"


def test_churn_telescopes_on_gap_free_rows(spark):
    d = dt.date
    counts = spark.createDataFrame(
        [(d(1998, 1, 1), p, n) for p, n in enumerate([9, 6, 6, 4, 5])],
        "cohort date, period_number int, n_customers long",
    )
    churn = [r.churn for r in op.churn_deltas(counts).orderBy("period_number").collect()]
    assert churn == [9, -3, 0, -2, 1] and sum(churn) == 5


def test_ltv_equals_gmv_on_fixture_data(spark, small_dir):
    from shopmetrics.plans.catalog import Inputs

    rows = op.customer_ltv(Inputs(spark, small_dir).ltv).select("gmv_dzd", "ltv_gmv_dzd", "lifetime_months").collect()
    assert rows and all(r.lifetime_months > 0 for r in rows)
    assert all(abs(r.ltv_gmv_dzd - r.gmv_dzd) <= 1e-9 * max(1.0, abs(r.gmv_dzd)) for r in rows)


def test_float_ids_keep_all_digits_and_missing_columns_fail(spark):
    import pytest

    from shopmetrics.schemas import RAW_USERS

    rows = [("x", dt.date(2000, 1, 1), "e", "p", "f", "l", "N", "Local", "['A']")]
    users = spark.createDataFrame(rows, RAW_USERS).withColumn("customer_id", F.lit(123456789012.0))
    assert [r.customer_id for r in op.clean_users(users).collect()] == ["123456789012"]
    with pytest.raises(ValueError, match="lacks column"):
        op.clean_users(users.drop("tags"))


def test_default_range_and_choices(spark):
    rows = [order_row("1", "a", dt.datetime(2023, 5, 6, 13)), order_row("2", None, dt.datetime(2023, 7, 1), origin=None)]
    df = orders_df(spark, rows)
    # 365 days before 2024-03-01 is 2023-03-02 (leap year) -> 1 January 2023
    r = op.default_range(df, dt.datetime(2024, 3, 1)).first()
    assert (r.start_date, r.end_date) == (dt.date(2023, 1, 1), dt.date(2023, 7, 1))
    r = op.default_range(df, dt.date(2024, 1, 1)).first()
    assert r.start_date == dt.date(2023, 1, 1)
    got = sorted(((c.ord, c.value) for c in op.choices(df, "origin").collect()), key=str)
    assert got == sorted([(0, "all"), (1, "Local"), (1, None)], key=str)
