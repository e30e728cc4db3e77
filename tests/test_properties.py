"""Property tests: column helpers and dedupe against plain Python / pandas."""

import datetime as dt
from fractions import Fraction

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shopmetrics import operators as op
from shopmetrics.functions import half_even_ratio, whole_days

SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))

stamps = st.datetimes(min_value=dt.datetime(1990, 1, 1), max_value=dt.datetime(2030, 1, 1))


@SETTINGS
@given(st.lists(st.tuples(stamps, stamps), min_size=1, max_size=40))
def test_whole_days_is_floor_of_elapsed_days(spark, pairs):
    df = spark.createDataFrame(pairs, "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(whole_days("b", "a")).collect()]
    assert got == [(b - a).days for a, b in pairs]


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 10**9), st.integers(1, 10**6)), min_size=1, max_size=40))
def test_half_even_ratio_matches_exact_rounding(spark, pairs):
    df = spark.createDataFrame(pairs, "n long, d long")
    got = [r[0] for r in df.select(half_even_ratio("n", "d", 4)).collect()]
    # round() of a Fraction is exact and rounds halves to even
    assert got == [round(Fraction(n * 10**4, d)) for n, d in pairs]


rows = st.lists(
    st.tuples(st.sampled_from(["a", "b", "c", None]), st.integers(0, 5), st.integers(0, 10**6)),
    min_size=1,
    max_size=60,
    unique_by=lambda r: r[2],
)


@SETTINGS
@given(rows)
def test_keep_first_and_last_match_pandas(spark, data):
    df = spark.createDataFrame(data, "k string, day int, id long").repartition(3)
    pdf = pd.DataFrame(data, columns=["k", "day", "id"]).sort_values(["day", "id"])
    want_first = sorted(((r.k, r.day, r.id) for r in pdf.drop_duplicates("k", keep="first").itertuples()), key=str)
    want_last = sorted(((r.k, r.day, r.id) for r in pdf.drop_duplicates("k", keep="last").itertuples()), key=str)
    got_first = sorted((tuple(r) for r in op.keep_first(df, ["k"], ["day", "id"]).collect()), key=str)
    got_last = sorted((tuple(r) for r in op.keep_last(df, ["k"], ["day", "id"]).collect()), key=str)
    norm = lambda xs: [(None if isinstance(k, float) else k, d, i) for k, d, i in xs]
    assert norm(got_first) == norm(want_first)
    assert norm(got_last) == norm(want_last)


cells = st.lists(
    st.tuples(st.integers(0, 5), st.integers(1, 8), st.integers(1, 50)),  # (cohort month, period, n)
    min_size=1,
    max_size=40,
    unique_by=lambda c: (c[0], c[1]),
)


@SETTINGS
@given(cells)
def test_churn_matches_adjacent_pivot_columns(spark, data):
    # every cohort has its period-0 cell, as real cohorts do
    rows = {(c, 0): 100 + c for c, _, _ in data}
    rows.update({(c, p): n for c, p, n in data})
    cohorts = [(dt.date(1998, 1 + c, 1), p, n) for (c, p), n in rows.items()]
    df = spark.createDataFrame(cohorts, "cohort date, period_number int, n_customers long")
    got = {(r.cohort, r.period_number): r.churn for r in op.churn_deltas(df).collect()}

    grid = pd.DataFrame(cohorts, columns=["cohort", "period", "n"]).pivot(index="cohort", columns="period", values="n")
    grid = grid.reindex(sorted(grid.columns), axis=1)
    values = grid.to_numpy(dtype=float)
    delta = values.copy()
    delta[:, 1:] = values[:, 1:] - values[:, :-1]
    want = {}
    for i, cohort in enumerate(grid.index):
        for j, period in enumerate(grid.columns):
            if not pd.isna(values[i, j]):
                want[(cohort, int(period))] = None if pd.isna(delta[i, j]) else int(delta[i, j])
    assert got == want


orders_st = st.lists(
    st.tuples(
        st.sampled_from(["a", "b", "c", "d", None]),                 # customer
        st.integers(0, 700),                                          # day offset from 1997-07-01
        st.sampled_from(["COMPLETED", "COMPLETED", "In_Progress", None]),
    ),
    min_size=1,
    max_size=60,
)


@SETTINGS
@given(orders_st)
def test_cohorts_and_retention_match_pandas(spark, data):
    from shopmetrics.schemas import ORDERS

    base = dt.datetime(1997, 7, 1, 9)
    rows = [
        (base + dt.timedelta(days=d), s, "Local", "CARD", str(i), "INTERNE", "Airtime", c, 1, None, False,
         "u", "p", "e", 1.0)
        for i, (c, d, s) in enumerate(data)
    ]
    orders = spark.createDataFrame(rows, ORDERS)
    start, end = dt.date(1998, 1, 1), dt.date(1998, 12, 31)
    counts = op.cohort_counts(orders, start=start, end=end)
    got = {(r.cohort, r.period_number): r.n_customers for r in counts.collect()}
    rates = {(r.cohort, r.period_number): r.retention_rate for r in op.retention(counts).collect()}

    pdf = pd.DataFrame([(r[7], r[0], r[1]) for r in rows], columns=["cust", "ts", "status"])
    sel = pdf[(pdf.ts >= pd.Timestamp(start)) & (pdf.ts <= pd.Timestamp(end))
              & (pdf.status == "COMPLETED") & pdf.cust.notna()].copy()
    sel["month"] = sel.ts.dt.to_period("M")
    sel["cohort"] = sel.groupby("cust")["month"].transform("min")
    n = sel.groupby(["cohort", "month"])["cust"].nunique()
    want = {
        (c.to_timestamp().date(), (m.year - c.year) * 12 + m.month - c.month): int(v) for (c, m), v in n.items()
    }
    assert got == want
    for (c, p), v in want.items():
        assert rates[(c, p)] == v / want[(c, 0)]


funnel_orders = st.lists(
    st.tuples(
        st.sampled_from(["a", "b", "c", "d", "e", "f"]),
        st.integers(0, 30),
        st.sampled_from(["COMPLETED", "In_Progress", "CANCELED", None]),
    ),
    min_size=0,
    max_size=40,
)


@SETTINGS
@given(funnel_orders)
def test_funnel_segments_match_pandas(spark, data):
    from shopmetrics.schemas import ORDERS

    base = dt.datetime(2001, 1, 1)
    rows = [
        (base + dt.timedelta(days=d), s, "Local", "CARD", f"{i:03d}", "INTERNE", "Airtime", c, 1, None, False,
         "u", "p", "e", 1.0)
        for i, (c, d, s) in enumerate(data)
    ]
    orders = spark.createDataFrame(rows, ORDERS)
    users = spark.createDataFrame(
        [(dt.date(2000, 1, 1), c, "L", "F", "p", f"{c}@x", "N", "Local") for c in "abcdeg"],
        "date date, customer_id string, last_name string, first_name string, phone string, email string, "
        "customer_country string, origin string",
    )
    flags = op.signup_flags(orders, users, dt.date(2001, 1, 1))
    got = {k: sorted(r.customer_id for r in v.collect()) for k, v in op.funnel_segments(users, flags).items()}

    so = pd.DataFrame([(r[7], r[0], r[4], r[1]) for r in rows], columns=["cust", "date", "order_id", "status"])
    so = so[so.cust.isin(list("abcdeg"))].sort_values(["date", "order_id"])
    done = so.status == "COMPLETED"
    first = so.drop_duplicates("cust", keep="first")
    first_done = first[first.status == "COMPLETED"]
    ever_done = set(so[done].cust)
    in_prog = first[first.status == "In_Progress"]
    want = {
        "ordered": sorted(first.cust),
        "not_ordered": sorted(set("abcdeg") - set(first.cust)),
        "completed": sorted(first_done.cust),
        "in_progress": sorted(in_prog.cust),
        "checkout_abandoned": sorted(c for c in in_prog.cust if c not in ever_done),
        "not_completed": sorted(c for c in first.cust if c not in set(first_done.cust)),
    }
    assert got == want


ltv_rows = st.lists(
    st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 10**7), st.integers(1, 10**6)),
    min_size=1,
    max_size=30,
)


@SETTINGS
@given(ltv_rows)
def test_customer_ltv_matches_pandas(spark, data):
    from decimal import Decimal

    from pyspark.sql import functions as F

    base = dt.datetime(2000, 1, 1)
    rows = [(str(i), c, base + dt.timedelta(seconds=s), Decimal(cents) / 100) for i, (c, s, cents) in enumerate(data)]
    df = spark.createDataFrame(rows, "order_id string, customer_id string, date timestamp_ntz, total_amount_dzd decimal(18,2)")
    df = df.select(
        "*", F.lit("COMPLETED").alias("status"), F.lit("Airtime").alias("business_cat"), F.lit("Local").alias("origin"),
        F.col("total_amount_dzd").alias("total_amount_eur"), F.col("total_amount_dzd").alias("margin_dzd"),
        F.col("total_amount_dzd").alias("margin_eur"),
    )
    got = {r.customer_id: r for r in op.customer_ltv(df).collect()}

    pdf = pd.DataFrame(rows, columns=["order_id", "cust", "date", "amount"])
    want = {}
    for cust, g in pdf.groupby("cust"):
        months = (g.date.max() - g.date.min()).days / 30
        if months > 0:
            want[cust] = (len(g), float(sum(g.amount)), months)
    assert set(got) == set(want)
    for cust, (n, gmv, months) in want.items():
        r = got[cust]
        assert (r.n_orders, r.gmv_dzd, r.lifetime_months) == (n, gmv, months)
        assert abs(r.ltv_gmv_dzd - gmv) <= 1e-9 * max(1.0, gmv)


geo_rows = st.lists(
    st.tuples(
        st.sampled_from(["X", "Y", "Z", None]),
        st.sampled_from(["W1", "W2", None]),
        st.one_of(st.none(), st.integers(0, 100)),
        st.one_of(st.none(), st.integers(0, 100)),
    ),
    min_size=1,
    max_size=40,
)


@SETTINGS
@given(geo_rows)
def test_communes_match_pandas_first_values(spark, data):
    rows = [(i, c, w, None if la is None else la / 4, None if lo is None else lo / 8) for i, (c, w, la, lo) in enumerate(data)]
    geo = spark.createDataFrame(rows, "row_key long, commune string, wilaya string, Latitude double, Longitude double")
    got = {r.commune: tuple(r)[1:] for r in op.customers_by_commune(geo).select(
        "commune", "n_customers", "latitude", "longitude", "wilaya").collect()}

    pdf = pd.DataFrame(rows, columns=["row_key", "commune", "wilaya", "lat", "lon"]).sort_values("row_key")
    pdf = pdf[pdf.commune.notna()]
    want = {}
    for c, g in pdf.groupby("commune"):
        lat = g.lat.dropna()
        lon = g.lon.dropna()
        want[c] = (len(g), None if lat.empty else float(lat.iloc[0]), None if lon.empty else float(lon.iloc[0]),
                   g.wilaya.iloc[0] if isinstance(g.wilaya.iloc[0], str) else None)
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.integers(-3, 200), st.sampled_from(["In_Progress", "CANCELED", None])), min_size=1, max_size=30))
def test_non_buyer_buckets_match_day_ranges(spark, data):
    from shopmetrics.schemas import ORDERS
    from shopmetrics.vocab import NON_BUYER_BUCKETS

    as_of = dt.datetime(2001, 9, 1, 12, 0)
    rows = [
        (as_of - dt.timedelta(days=d, hours=1), s, "Local", "CARD", str(i), "INTERNE", "Airtime", f"c{i}", 1, None,
         False, "u", "p", "e", 1.0)
        for i, (d, s) in enumerate(data)
    ]
    got = {r.customer_id: (r.bucket, r.days_since) for r in op.non_buyer_buckets(spark.createDataFrame(rows, ORDERS), as_of).collect()}
    want = {}
    for i, (d, _) in enumerate(data):
        days = ((as_of - rows[i][0]).total_seconds() // 86400)
        for label, (lo, hi) in NON_BUYER_BUCKETS.items():
            if (lo is None or days >= lo) and (hi is None or days <= hi):
                want[f"c{i}"] = (label, int(days))
    assert got == want


buyer_rows = st.lists(
    st.tuples(
        st.sampled_from(["a", "b", "c"]),
        st.integers(0, 60),
        st.one_of(st.none(), st.integers(0, 200)),
        st.sampled_from(["COMPLETED", "In_Progress", None]),
        st.sampled_from(["Local", "Diaspora"]),
        st.sampled_from(["Airtime", "Shopping"]),
    ),
    min_size=1,
    max_size=40,
)


@SETTINGS
@given(buyer_rows, st.sampled_from([7, 30, 120, "over_120"]))
def test_retarget_buyers_match_pandas(spark, data, days):
    from shopmetrics.schemas import ORDERS

    as_of = dt.datetime(2001, 9, 1, 12, 0)
    rows = [
        (as_of - dt.timedelta(days=d), s, o, "CARD", f"{i:03d}", "INTERNE", cat, c, 1,
         None if p is None else as_of - dt.timedelta(days=p, hours=3), False, "u", "p", "e", 1.0)
        for i, (c, d, p, s, o, cat) in enumerate(data)
    ]
    got = sorted(
        (r.customer_id, r.date) for r in op.retarget_buyers(spark.createDataFrame(rows, ORDERS), days, as_of,
                                                            ["Local"], ["Airtime"]).collect()
    )
    pdf = pd.DataFrame([(r[7], r[0], r[4], r[1], r[2], r[6], r[9]) for r in rows],
                       columns=["cust", "date", "order_id", "status", "origin", "cat", "prev"])
    pdf["prev"] = pd.to_datetime(pdf.prev)
    age = (pd.Timestamp(as_of) - pdf.prev).dt.days
    keep = (pdf.status == "COMPLETED") & (age > 120 if days == "over_120" else age <= days) & pdf.prev.notna()
    sel = pdf[keep & (pdf.origin == "Local") & (pdf.cat == "Airtime")].sort_values(["date", "order_id"])
    want = sorted((r.cust, r.date.to_pydatetime()) for r in sel.drop_duplicates("cust", keep="last").itertuples())
    assert got == want
