"""DuckDB SQL twins of the registered queries.

Each query is ``WITH <shared CTEs> <body>``; the shared CTEs repeat the
fixture derivations of ``sources.fixtures`` and the cleaning of
``operators.clean`` in plain SQL over the driver's views. Parameters are
the values of ``plans.params`` spelled as literals.
"""

from __future__ import annotations

import re

from . import params as P

_US_PER_DAY = 86_400_000_000


def _d(x) -> str:
    return f"DATE '{x.isoformat()}'"


def _ts(x) -> str:
    return f"TIMESTAMP '{x.strftime('%Y-%m-%d %H:%M:%S')}'"


def _ts_day(x) -> str:
    return f"TIMESTAMP '{x.isoformat()} 00:00:00'"


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _days(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / {_US_PER_DAY}) AS BIGINT)"


def _half_even(num: str, den: str, scale: int) -> str:
    """``num / den`` in units of 10^-scale, ties to even: the engine's own rounding of the exact double or remainder tie."""
    n, d = f"(CAST({num} AS HUGEINT) * {10 ** scale})", f"CAST({den} AS HUGEINT)"
    tie = f"(2 * abs({n}) % abs({d}) = 0 AND (2 * abs({n}) // abs({d})) % 2 = 1)"
    down = f"(abs({n}) // abs({d}))"
    size = f"CASE WHEN {tie} THEN {down} + {down} % 2 ELSE (2 * abs({n}) + abs({d})) // (2 * abs({d})) END"
    return f"(CASE WHEN {d} <> 0 THEN CAST(sign({n}) * sign({d}) AS BIGINT) * CAST({size} AS BIGINT) END)"


def _fixed2(h: str) -> str:
    return (
        f"concat(CASE WHEN {h} < 0 THEN '-' ELSE '' END, CAST(abs({h}) // 100 AS VARCHAR), '.', "
        f"lpad(CAST(abs({h}) % 100 AS VARCHAR), 2, '0'))"
    )


def _short2(h: str) -> str:
    frac = f"(abs({h}) % 100)"
    return (
        f"concat(CASE WHEN {h} < 0 THEN '-' ELSE '' END, CAST(abs({h}) // 100 AS VARCHAR), '.', "
        f"CASE WHEN {frac} % 10 = 0 THEN CAST({frac} // 10 AS VARCHAR) ELSE lpad(CAST({frac} AS VARCHAR), 2, '0') END)"
    )


def _first_by(table: str, key: str, order: str, where: str = "TRUE") -> str:
    return (
        f"SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS _rn "
        f"FROM {table} WHERE {where}) WHERE _rn = 1"
    )


_ORIGIN = "CASE WHEN n.n_regionkey IN (0, 1) THEN 'Local' ELSE 'Diaspora' END"
_EMAIL = "concat(lower(replace(c.c_name, '#', '.')), '@example.com')"
_PHONE = "concat('+213', lpad(CAST(c.c_custkey AS VARCHAR), 9, '0'))"
_STRIP = r"regexp_replace({}, '\.0$', '')"
_GEO_OFFSET = "(n.n_nationkey % 10) * 0.25 + (c.c_custkey % 8) * 0.01 + (c.c_custkey % 5) * 0.001"


def _not_in(col: str, values) -> str:
    return f"NOT coalesce({col} IN ({_in(values)}), false)"


# Shared CTEs in dependency order: name -> body.
BASE: dict[str, str] = {}

BASE["raw_orders"] = f"""
SELECT CAST(o.o_orderkey AS VARCHAR) AS order_id,
  CASE WHEN o.o_orderkey % 97 = 0 THEN NULL ELSE concat(CAST(o.o_custkey AS VARCHAR), '.0') END AS customer_id,
  o.o_orderdate AS date,
  CASE o.o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'In_Progress'
    WHEN 'P' THEN CASE o.o_orderkey % 3 WHEN 0 THEN 'ABANDONED' WHEN 1 THEN 'CANCELED' END END AS job_status,
  {_ORIGIN} AS customer_origine,
  CASE WHEN o.o_orderkey % 2 = 0 THEN 'CARD' ELSE 'CASH' END AS paymentType,
  CASE WHEN o.o_orderkey % 10 = 0 THEN 'EXTERNE' ELSE 'INTERNE' END AS "Order Type",
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Recharge mobile' WHEN '2-HIGH' THEN 'Recharge mobile / ADSL'
    WHEN '3-MEDIUM' THEN 'Alimentation' WHEN '4-NOT SPECIFIED' THEN 'Shopping'
    WHEN '5-LOW' THEN CASE WHEN o.o_orderkey % 2 = 0 THEN 'Services' END END AS businessCat,
  CAST(row_number() OVER w AS BIGINT) AS Occurence,
  lag(o.o_orderdate) OVER w AS previous_order_date,
  row_number() OVER w > 1 AS returning_customer,
  c.c_name AS customer_username,
  {_PHONE} AS customer_phone,
  {_EMAIL} AS customer_email,
  o.o_totalprice AS total_amount_dzd
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
WINDOW w AS (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey)
"""

BASE["orders_clean"] = f"""
SELECT * FROM (
  SELECT date, job_status AS status, customer_origine AS origin, paymentType AS payment_type, order_id,
    "Order Type" AS order_type,
    CASE businessCat WHEN 'Recharge mobile' THEN 'Airtime' WHEN 'Recharge mobile / ADSL' THEN 'Airtime'
      ELSE businessCat END AS business_cat,
    {_STRIP.format('customer_id')} AS customer_id,
    Occurence AS occurrence, previous_order_date, returning_customer, customer_username, customer_phone,
    customer_email, total_amount_dzd
  FROM raw_orders
  WHERE {_not_in('job_status', ['ABANDONED'])}
    AND {_not_in('order_id', P.EXCLUDED_ORDERS)}
    AND {_not_in(_STRIP.format('customer_id'), P.EXCLUDED_CUSTOMERS)}
) WHERE business_cat IS NOT NULL
"""

BASE["orders_clean_nan"] = """
SELECT * REPLACE (coalesce(customer_id, 'nan') AS customer_id) FROM orders_clean
"""

BASE["margin_per_order"] = """
SELECT l_orderkey,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS marge_dzd
FROM lineitem GROUP BY l_orderkey
"""

_EUR = "CAST(CAST(70 + year(o.o_orderdate) - 1995 AS DECIMAL(5,0)) * CAST(0.0001 AS DECIMAL(4,4)) AS DECIMAL(9,4))"

BASE["raw_ltv"] = f"""
SELECT CAST(o.o_orderkey AS VARCHAR) AS order_id,
  concat(CAST(o.o_custkey AS VARCHAR), '.0') AS customer_id,
  CASE WHEN o.o_orderstatus IN ('F', 'O') THEN 'COMPLETED' WHEN o.o_orderkey % 2 = 0 THEN 'ABANDONED'
    ELSE 'CANCELED' END AS job_status,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Airtime' WHEN '2-HIGH' THEN 'Airtime'
    WHEN '3-MEDIUM' THEN 'Alimentation' WHEN '4-NOT SPECIFIED' THEN 'Shopping' WHEN '5-LOW' THEN 'Services' END
    AS businessCat,
  {_ORIGIN} AS customer_origine,
  o.o_orderdate AS date,
  CAST(o.o_totalprice AS DECIMAL(18,2)) AS total_amount_dzd,
  {_EUR} AS EUR,
  m.marge_dzd,
  CAST(m.marge_dzd * {_EUR} AS DECIMAL(28,8)) AS marge_eur
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN margin_per_order m ON o.o_orderkey = m.l_orderkey
"""

BASE["ltv_clean"] = f"""
SELECT order_id, {_STRIP.format('customer_id')} AS customer_id, job_status AS status, businessCat AS business_cat,
  customer_origine AS origin, date, total_amount_dzd, EUR AS eur_rate,
  CAST(total_amount_dzd * EUR AS DECIMAL(28,6)) AS total_amount_eur,
  marge_dzd AS margin_dzd, marge_eur AS margin_eur
FROM raw_ltv
WHERE businessCat IN ({_in(P.LTV_CATEGORIES)})
  AND {_not_in('job_status', ['ABANDONED'])}
  AND {_not_in('order_id', P.EXCLUDED_ORDERS)}
  AND {_not_in(_STRIP.format('customer_id'), P.EXCLUDED_CUSTOMERS)}
  AND job_status = 'COMPLETED'
"""

BASE["raw_users"] = f"""
SELECT concat(CAST(c.c_custkey AS VARCHAR), '.0') AS customer_id,
  DATE '1995-01-01' + CAST((c.c_custkey * 37) % 2400 AS INTEGER) AS date,
  {_EMAIL} AS email, {_PHONE} AS phone,
  concat('First', CAST(c.c_custkey AS VARCHAR)) AS firstName, c.c_name AS lastName,
  n.n_name AS customer_country, {_ORIGIN} AS Origine,
  concat('[''', c.c_mktsegment, ''', "NATION_', CAST(c.c_nationkey AS VARCHAR), '"]') AS tags
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
"""

BASE["users_clean"] = f"""
SELECT {_STRIP.format('customer_id')} AS customer_id, date, email, phone, firstName AS first_name,
  lastName AS last_name, customer_country, Origine AS origin,
  regexp_replace(regexp_replace(tags, '\\[|\\]', '', 'g'), '[''"]', '', 'g') AS tags
FROM raw_users
WHERE {_not_in(_STRIP.format('customer_id'), P.EXCLUDED_CUSTOMERS)}
"""

BASE["raw_geo"] = f"""
SELECT CAST(c.c_custkey AS BIGINT) AS row_key,
  CASE WHEN c.c_custkey % 53 = 0 THEN NULL
    ELSE concat('C', CAST(n.n_nationkey % 10 AS VARCHAR), '_', CAST(c.c_custkey % 8 AS VARCHAR)) END AS commune,
  n.n_name AS wilaya,
  CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE CAST(28 + {_GEO_OFFSET} AS DOUBLE) END AS Latitude,
  CASE WHEN c.c_custkey % 13 = 0 THEN NULL ELSE CAST({_GEO_OFFSET} AS DOUBLE) END AS Longitude
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
"""

BASE["raw_downloads"] = """
SELECT DATE '1998-01-01' + CAST(day(ts) - 1 AS INTEGER) AS date,
  CASE WHEN user_id % 2 = 0 THEN 'Local' ELSE 'Diaspora' END AS customer_origine,
  count(*) AS downloads
FROM events WHERE event_type = 'view' GROUP BY ALL
"""

BASE["raw_first_open"] = f"""
SELECT CAST(e.event_id AS BIGINT) AS row_key, CAST(e.event_id % 3 AS BIGINT) AS sheet_no,
  {_EMAIL} AS email, CAST(e.ts AS DATE) AS first_open_date
FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE e.event_type = 'signup'
"""

BASE["raw_payment_screen"] = f"""
SELECT {_EMAIL} AS email, substr(CAST(o.o_orderdate AS VARCHAR), 1, 10) AS "Date de Payment method screen"
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
"""

# --- report CTEs -----------------------------------------------------------


def _cohort_sql(where_extra: str = "TRUE", table: str = "orders_clean", start=P.SLICE_START) -> str:
    dates = f"date >= {_ts_day(start)} AND date <= {_ts_day(P.SLICE_END)}" if start else "date IS NOT NULL"
    return f"""
SELECT cohort, CAST((year(order_month) - year(cohort)) * 12 + month(order_month) - month(cohort) AS INTEGER)
  AS period_number, count(*) AS n_customers
FROM (
  SELECT customer_id, order_month, min(order_month) OVER (PARTITION BY customer_id) AS cohort
  FROM (
    SELECT DISTINCT customer_id, CAST(date_trunc('month', date) AS DATE) AS order_month
    FROM {table}
    WHERE {dates}
      AND status = 'COMPLETED' AND customer_id IS NOT NULL AND {where_extra}
  )
) GROUP BY cohort, order_month
"""


_AMOUNT = "CAST(total_amount_dzd AS VARCHAR)"
_BAD_AMOUNT = f"paymentType <> 'CARD' AND {_AMOUNT} LIKE '%1.%'"
BASE["misfits"] = f"""
SELECT order_id, 'total_amount_dzd' AS "column", replace({_AMOUNT}, '1.', '1,') AS value, 'not double' AS reason FROM raw_orders WHERE {_BAD_AMOUNT}
UNION ALL SELECT order_id, 'Occurence', '3.5', 'not bigint' FROM raw_orders WHERE Occurence = 3
"""
BASE["orders_good"] = "SELECT * FROM orders_clean WHERE order_id NOT IN (SELECT order_id FROM misfits)"

BASE["cohort_counts_std"] = _cohort_sql()

BASE["retention_std"] = """
SELECT cohort, period_number, n_customers, cohort_size, n_customers / cohort_size AS retention_rate
FROM (SELECT *, first_value(n_customers) OVER (PARTITION BY cohort ORDER BY period_number
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS cohort_size FROM cohort_counts_std)
"""

_MONEY = {
    "gmv_dzd": "total_amount_dzd",
    "gmv_eur": "total_amount_eur",
    "margin_dzd": "margin_dzd",
    "margin_eur": "margin_eur",
}
_LTV_MEASURES = ("ltv_gmv_eur", "ltv_margin_eur", "ltv_gmv_dzd", "ltv_margin_dzd")


def _ltv_sql(keys: str, where: str) -> str:
    sums = ",\n    ".join(f"CAST(coalesce(sum({src}), 0) AS DOUBLE) AS {m}" for m, src in _MONEY.items())
    baskets = ",\n  ".join(f"{m} / n_orders AS basket_{m}" for m in _MONEY)
    ltvs = ",\n  ".join(
        f"(n_orders / lifetime_months) * ({m} / n_orders) * lifetime_months AS ltv_{m}" for m in _MONEY
    )
    return f"""
SELECT {keys}, n_orders, {', '.join(_MONEY)}, min_date, max_date, lifetime_months,
  {baskets},
  n_orders / lifetime_months AS purchase_frequency,
  {ltvs}
FROM (
  SELECT *, CAST({_days('max_date', 'min_date')} AS DOUBLE) / CAST(30.0 AS DOUBLE) AS lifetime_months
  FROM (
    SELECT {keys}, count(order_id) AS n_orders,
    {sums},
    min(date) AS min_date, max(date) AS max_date
    FROM ltv_clean WHERE {where}
    GROUP BY {keys}
  )
) WHERE lifetime_months > 0
"""


_SLICE98 = f"date >= {_ts_day(P.SLICE_START)} AND date <= {_ts_day(P.SLICE_END)}"

BASE["category_ltv_std"] = _ltv_sql("business_cat, customer_id", _SLICE98)

_means = ",\n  ".join(
    f"CAST(sum(CAST({m} AS DECIMAL(38,6))) AS DOUBLE) / count({m}) AS {m}" for m in _LTV_MEASURES
)
_ints = ", ".join(f"CAST(round_even({m}, 0) AS BIGINT) AS {m}" for m in _LTV_MEASURES)
BASE["ltv_summary_std"] = f"""
SELECT business_cat,
  concat(business_cat, ' (', {_short2(_half_even('ltv_margin_dzd', 'ltv_gmv_dzd', 4))}, '%)') AS category_label,
  {', '.join(_LTV_MEASURES)},
  CAST(ltv_margin_dzd AS DOUBLE) / nullif(ltv_gmv_dzd, 0) * 100.0 AS margin_share_pct
FROM (SELECT business_cat, {_ints} FROM (SELECT business_cat, {_means} FROM category_ltv_std GROUP BY business_cat))
"""

BASE["communes_std"] = f"""
SELECT a.commune, a.n_customers, a.latitude, a.longitude, fw.wilaya
FROM (
  SELECT commune, count(*) AS n_customers,
    arg_min(Latitude, row_key) FILTER (WHERE Latitude IS NOT NULL) AS latitude,
    arg_min(Longitude, row_key) FILTER (WHERE Longitude IS NOT NULL) AS longitude
  FROM raw_geo WHERE commune IS NOT NULL GROUP BY commune
) a JOIN ({_first_by('raw_geo', 'commune', 'row_key', 'commune IS NOT NULL')}) fw ON a.commune = fw.commune
"""

BASE["signups_std"] = f"""
SELECT date, customer_id, last_name, first_name, phone, email, customer_country, origin
FROM users_clean WHERE date >= {_d(P.USERS_START)} AND date <= {_d(P.USERS_END)}
"""

BASE["signups_distinct"] = _first_by("signups_std", "customer_id", "date, email", "customer_id IS NOT NULL")

BASE["signups_local"] = "SELECT * FROM signups_std WHERE origin = 'Local'"
BASE["signups_local_distinct"] = _first_by(
    "signups_local", "customer_id", "date, email", "customer_id IS NOT NULL")

BASE["signup_orders_std"] = f"""
SELECT o.date, o.customer_id, o.order_id, o.status, o.origin AS orders_origin, o.business_cat, o.total_amount_dzd,
  s.date AS registration_date, s.last_name, s.first_name, s.phone, s.email, s.customer_country, s.origin,
  CASE WHEN o.status = 'COMPLETED' THEN 'COMPLETED' ELSE 'NOT COMPLETED' END AS new_status
FROM orders_clean o JOIN signups_std s ON o.customer_id = s.customer_id
WHERE o.date >= {_ts_day(P.FUNNEL_SINCE)}
"""


def _flags_sql(category: str | None) -> str:
    where = "customer_id IS NOT NULL" + (f" AND business_cat = '{category}'" if category else "")
    return f"""
SELECT f.*, a.any_completed
FROM ({_first_by('signup_orders_std', 'customer_id', 'date, order_id', where)}) f
JOIN (SELECT customer_id, max(CASE WHEN new_status = 'COMPLETED' THEN 1 ELSE 0 END) = 1 AS any_completed
      FROM signup_orders_std WHERE {where} GROUP BY customer_id) a ON f.customer_id = a.customer_id
"""


BASE["flags_std"] = _flags_sql(None)
BASE["signup_orders_local"] = """
SELECT * FROM signup_orders_std WHERE origin = 'Local'
"""
BASE["flags_local"] = _flags_sql(None).replace("signup_orders_std", "signup_orders_local")
BASE["flags_alimentation"] = _flags_sql("Alimentation")

BASE["first_open_std"] = f"""
{_first_by(
    f"(SELECT u.date, u.email, u.phone, u.origin, u.customer_id, fo.first_open_date FROM users_clean u "
    f"JOIN ({_first_by('raw_first_open', 'email', 'sheet_no, row_key')}) fo ON u.email = fo.email "
    f"WHERE u.date >= {_d(P.USERS_START)} AND u.date <= {_d(P.USERS_END)})",
    'email', 'date, customer_id')}
"""

BASE["non_buyers_std"] = """
SELECT l.customer_id, l.date, l.previous_order_date, l.customer_username, l.customer_phone, l.customer_email,
  l.business_cat, l.origin, l.order_id
FROM (SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
  ORDER BY date DESC, order_id DESC) AS _rn FROM orders_clean WHERE customer_id IS NOT NULL) WHERE _rn = 1) l
JOIN (SELECT customer_id, max(CASE WHEN status = 'COMPLETED' THEN 1 ELSE 0 END) AS done
      FROM orders_clean WHERE customer_id IS NOT NULL GROUP BY customer_id) d ON l.customer_id = d.customer_id
WHERE d.done = 0
"""

_BUCKETS = [("7", None, 6), ("14", 7, 13), ("21", 14, 20), ("30", 21, 29), ("60", 30, 59),
            ("90", 60, 89), ("120", 90, 119), ("over_120", 121, None)]


def _bucket_case(col: str) -> str:
    parts = []
    for label, lo, hi in _BUCKETS:
        conds = []
        if lo is not None:
            conds.append(f"{col} >= {lo}")
        if hi is not None:
            conds.append(f"{col} <= {hi}")
        parts.append(f"WHEN {' AND '.join(conds)} THEN '{label}'")
    return "CASE " + " ".join(parts) + " END"


_EXPORT = ("date, previous_order_date, customer_id, customer_username, customer_phone, customer_email, "
           "business_cat, origin")

BASE["non_buyer_buckets_std"] = f"""
SELECT bucket, days_since, {_EXPORT} FROM (
  SELECT *, {_bucket_case('days_since')} AS bucket FROM (
    SELECT *, {_days(_ts(P.AS_OF), 'date')} AS days_since FROM non_buyers_std))
WHERE bucket IS NOT NULL
"""

# --- query bodies ------------------------------------------------------------

_MONEY_AS_DOUBLE = ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}"
    for c in ("total_amount_dzd", "eur_rate", "total_amount_eur", "margin_dzd", "margin_eur")
)


BODIES: dict[str, str] = {
    "csv_roundtrip": "SELECT * FROM raw_orders",
    "clean_orders": "SELECT * FROM orders_clean",
    "clean_ltv": "SELECT * REPLACE (" + _MONEY_AS_DOUBLE + ") FROM ltv_clean",
    "clean_users": "SELECT * FROM users_clean",
    "clean_orders_overridden": f"SELECT * REPLACE (CASE WHEN customer_id IN ({_in(P.EXTERNAL_CUSTOMERS)}) THEN 'EXTERNE' ELSE order_type END AS order_type) FROM orders_clean",
    "ordering_customers": "SELECT DISTINCT customer_id FROM orders_clean WHERE customer_id IS NOT NULL",
    "csv_misfits": "SELECT * FROM misfits",
    "cohort_counts_of_good_rows": _cohort_sql(table="orders_good"),
    "report_export_roundtrip": "SELECT * REPLACE (concat('Say \"', first_name, '\",', chr(10), 'please') AS first_name) FROM users_clean",
    "first_open_from_sheets": "SELECT * FROM first_open_std",
    "communes_from_export": "SELECT * FROM communes_std",
    "external_orders": "SELECT * FROM orders_clean WHERE order_type = 'EXTERNE'",
    "payment_screen_view": "SELECT date, business_cat, order_id, status, customer_email AS email FROM orders_clean",
    "slice_orders": f"SELECT * FROM orders_clean WHERE origin = 'Local' AND business_cat = 'Alimentation' AND {_SLICE98}",
    "slice_ltv": (
        f"SELECT * REPLACE ({_MONEY_AS_DOUBLE}) FROM ltv_clean "
        f"WHERE origin = 'Diaspora' AND business_cat = 'Shopping' AND {_SLICE98}"
    ),
    "slice_summary": f"SELECT * REPLACE ({_MONEY_AS_DOUBLE}) FROM ltv_clean WHERE origin = 'Local' AND {_SLICE98}",
    "slice_users": (
        f"SELECT * FROM users_clean WHERE origin = 'Local' AND customer_country = '{P.USERS_COUNTRY}' "
        f"AND date >= {_d(P.USERS_START)} AND date <= {_d(P.USERS_END)}"
    ),
    "slice_by_status": f"SELECT * FROM orders_clean WHERE status = 'In_Progress' AND {_SLICE98}",
    "default_date_range": (
        f"SELECT make_date(year({_d(P.DEFAULT_RANGE_AS_OF.date())} - INTERVAL 365 DAY), 1, 1) AS start_date, "
        "CAST(max(date) AS DATE) AS end_date FROM orders_clean"
    ),
    "choices_origin": (
        "SELECT 0 AS ord, 'all' AS value UNION ALL SELECT DISTINCT 1 AS ord, origin AS value FROM orders_clean"
    ),
    "cohort_counts": "SELECT * FROM cohort_counts_std",
    "cohort_counts_local_airtime": _cohort_sql("origin = 'Local' AND business_cat = 'Airtime'"),
    "cohort_counts_all_time": _cohort_sql(start=None),
    "cohort_counts_estimated": f"SELECT cohort, period_number, n_customers, TRUE AS within_bound FROM ({_cohort_sql("origin = 'Local'")})",
    "cohort_counts_nan_ids": _cohort_sql(table="orders_clean_nan"),
    "cohort_matrix": "SELECT cohort, "
    + ", ".join(
        f"max(CASE WHEN period_number = {p} THEN n_customers END) AS period_{p}" for p in P.COHORT_PERIODS
    )
    + " FROM cohort_counts_std GROUP BY cohort",
    "cohort_matrix_24m": "SELECT cohort, "
    + ", ".join(f"max(CASE WHEN period_number = {p} THEN n_customers END) AS period_{p}" for p in P.LONG_PERIODS)
    + f" FROM ({_cohort_sql(start=P.LONG_START)}) GROUP BY cohort",
    "retention_matrix_24m": "SELECT cohort, "
    + ", ".join(f"max(CASE WHEN period_number = {p} THEN n_customers END) / max(CASE WHEN period_number = 0 THEN n_customers END) AS rate_{p}" for p in P.LONG_PERIODS)
    + f" FROM ({_cohort_sql(start=P.LONG_START)}) GROUP BY cohort",
    "retention": "SELECT * FROM retention_std",
    "retention_matrix": "SELECT cohort, "
    + ", ".join(
        f"max(CASE WHEN period_number = {p} THEN retention_rate END) AS rate_{p}" for p in P.COHORT_PERIODS
    )
    + " FROM retention_std GROUP BY cohort",
    "retention_text": (
        "SELECT strftime(cohort, '%Y-%m') AS cohort_label, CAST(period_number AS VARCHAR) AS period_label, "
        f"coalesce({_fixed2(_half_even('n_customers', 'cohort_size', 4))}, '') AS pct_text, "
        f"concat({_fixed2(_half_even('n_customers', 'cohort_size', 4))}, '%') AS hover_text, "
        "CAST(n_customers AS VARCHAR) AS count_text FROM retention_std"
    ),
    "retention_text_matrix": "SELECT strftime(cohort, '%Y-%m') AS cohort_label, "
    + ", ".join(
        f"coalesce(max(CASE WHEN period_number = {p} THEN {_fixed2(_half_even('n_customers', 'cohort_size', 4))} END), '') "
        f"AS pct_{p}"
        for p in P.COHORT_PERIODS
    )
    + " FROM retention_std GROUP BY 1",
    "churn_deltas": """
SELECT c.cohort, c.period_number, concat('Churn_', CAST(c.period_number AS VARCHAR)) AS churn_label,
  CAST(CASE WHEN p.prev_period IS NULL THEN c.n_customers ELSE c.n_customers - b.n_customers END AS BIGINT) AS churn
FROM cohort_counts_std c
JOIN (SELECT period_number, lag(period_number) OVER (ORDER BY period_number) AS prev_period
      FROM (SELECT DISTINCT period_number FROM cohort_counts_std)) p ON c.period_number = p.period_number
LEFT JOIN cohort_counts_std b ON b.cohort = c.cohort AND b.period_number = p.prev_period
""",
    "customer_ltv": _ltv_sql("customer_id", _SLICE98),
    "customer_ltv_local_shopping": _ltv_sql(
        "customer_id", f"origin = 'Local' AND business_cat = 'Shopping' AND {_SLICE98}"
    ),
    "category_ltv": "SELECT * FROM category_ltv_std",
    "category_ltv_summary": "SELECT * FROM ltv_summary_std",
    "category_ltv_summary_text": (
        "SELECT business_cat, category_label, ltv_gmv_eur, ltv_margin_eur, "
        "replace(format('{:,}', ltv_gmv_dzd), ',', '.') AS ltv_gmv_dzd, "
        "replace(format('{:,}', ltv_margin_dzd), ',', '.') AS ltv_margin_dzd FROM ltv_summary_std"
    ),
    "ltv_series_eur": (
        "SELECT category_label, 'ltv_gmv_eur' AS measure, ltv_gmv_eur AS value FROM ltv_summary_std "
        "UNION ALL SELECT category_label, 'ltv_margin_eur', ltv_margin_eur FROM ltv_summary_std"
    ),
    "ltv_series_dzd": (
        "SELECT category_label, 'ltv_gmv_dzd' AS measure, ltv_gmv_dzd AS value FROM ltv_summary_std "
        "UNION ALL SELECT category_label, 'ltv_margin_dzd', ltv_margin_dzd FROM ltv_summary_std"
    ),
    "customers_by_commune": "SELECT * FROM communes_std",
    "communes_ranked": "SELECT *, row_number() OVER (ORDER BY n_customers DESC, commune) AS position FROM communes_std",
    "cohort_counts_in_order": "SELECT *, row_number() OVER (ORDER BY cohort, period_number) AS position FROM cohort_counts_std",
    "commune_map_points": f"""
SELECT wilaya, commune, latitude, longitude, n_customers,
  round(CASE WHEN mn = mx THEN CAST(20.0 AS DOUBLE)
    ELSE CAST(5.0 AS DOUBLE) + (ln(n_customers) - ln(mn)) * CAST(15.0 AS DOUBLE) / (ln(mx) - ln(mn)) END, 6)
    AS marker_size,
  concat('Commune: ', commune, ' - customers: ', CAST(n_customers AS VARCHAR)) AS label
FROM (SELECT *, min(n_customers) OVER (PARTITION BY wilaya) AS mn, max(n_customers) OVER (PARTITION BY wilaya) AS mx
      FROM communes_std WHERE wilaya = '{P.MAP_WILAYA}')
""",
    "commune_map_points_all": """
SELECT wilaya, commune, latitude, longitude, n_customers,
  round(CASE WHEN mn = mx THEN CAST(20.0 AS DOUBLE)
    ELSE CAST(5.0 AS DOUBLE) + (ln(n_customers) - ln(mn)) * CAST(15.0 AS DOUBLE) / (ln(mx) - ln(mn)) END, 6)
    AS marker_size,
  concat('Commune: ', commune, ' - customers: ', CAST(n_customers AS VARCHAR)) AS label
FROM (SELECT *, min(n_customers) OVER (PARTITION BY wilaya) AS mn, max(n_customers) OVER (PARTITION BY wilaya) AS mx
      FROM communes_std)
""",
    "wilaya_centres": (
        "SELECT wilaya, CAST(sum(CAST(latitude AS DECIMAL(24,9))) AS DOUBLE) / count(latitude) AS centre_latitude, "
        "CAST(sum(CAST(longitude AS DECIMAL(24,9))) AS DOUBLE) / count(longitude) AS centre_longitude "
        "FROM communes_std GROUP BY wilaya"
    ),
    "new_signups": "SELECT * FROM signups_std",
    "new_signups_local_country": (
        "SELECT date, customer_id, last_name, first_name, phone, email, customer_country, origin FROM users_clean "
        f"WHERE origin = 'Local' AND customer_country = '{P.USERS_COUNTRY}' "
        f"AND date >= {_d(P.USERS_START)} AND date <= {_d(P.USERS_END)}"
    ),
    "downloads_local": (
        "SELECT * FROM raw_downloads WHERE customer_origine = 'Local' "
        f"AND date >= {_d(P.USERS_START)} AND date <= {_d(P.USERS_END)}"
    ),
    "first_open_signups_diaspora": _first_by(
        f"(SELECT u.date, u.email, u.phone, u.origin, u.customer_id, fo.first_open_date FROM users_clean u "
        f"JOIN ({_first_by('raw_first_open', 'email', 'sheet_no, row_key')}) fo ON u.email = fo.email "
        f"WHERE u.origin = 'Diaspora' AND u.date >= {_d(P.USERS_START)} AND u.date <= {_d(P.USERS_END)})",
        "email", "date, customer_id"),
    "signups_by_month": "SELECT strftime(date, '%Y-%m') AS period, count(*) AS n_signups FROM signups_std GROUP BY 1",
    "signups_by_week": (
        "SELECT date - CAST(dayofweek(date) AS INTEGER) AS period, count(*) AS n_signups FROM signups_std GROUP BY 1"
    ),
    "signups_by_day": "SELECT date AS period, count(*) AS n_signups FROM signups_std GROUP BY 1",
    "signups_by_month_ranked": (
        "SELECT *, row_number() OVER (ORDER BY n_signups, period) AS position "
        "FROM (SELECT strftime(date, '%Y-%m') AS period, count(*) AS n_signups FROM signups_std GROUP BY 1)"
    ),
    "first_open_signups": "SELECT * FROM first_open_std",
    "signup_orders": "SELECT * FROM signup_orders_std",
    "segment_ordered": "SELECT * EXCLUDE (any_completed) FROM flags_std",
    "segment_not_ordered": (
        "SELECT * FROM signups_distinct s WHERE NOT EXISTS "
        "(SELECT 1 FROM flags_std f WHERE f.customer_id = s.customer_id)"
    ),
    "segment_completed": "SELECT * EXCLUDE (any_completed) FROM flags_std WHERE new_status = 'COMPLETED'",
    "segment_in_progress": "SELECT * EXCLUDE (any_completed) FROM flags_std WHERE status = 'In_Progress'",
    "segment_checkout_abandoned": (
        "SELECT * EXCLUDE (any_completed) FROM flags_std WHERE status = 'In_Progress' AND NOT any_completed"
    ),
    "segment_not_completed": "SELECT * EXCLUDE (any_completed) FROM flags_std WHERE new_status <> 'COMPLETED'",
    "retarget_buyers_rows": (
        f"SELECT {_EXPORT} FROM orders_clean WHERE status = 'COMPLETED' AND customer_id IS NOT NULL "
        f"AND {_days(_ts(P.AS_OF), 'previous_order_date')} <= {P.BUYER_DAYS}"
    ),
    "retarget_buyers": (
        f"SELECT {_EXPORT} FROM ("
        + _first_by(
            "orders_clean",
            "customer_id",
            "date DESC, order_id DESC",
            f"status = 'COMPLETED' AND customer_id IS NOT NULL AND origin IN ('Local') "
            f"AND business_cat IN ('Airtime', 'Alimentation') "
            f"AND {_days(_ts(P.AS_OF), 'previous_order_date')} <= {P.BUYER_DAYS}",
        )
        + ")"
    ),
    "retarget_buyers_over_120": (
        f"SELECT {_EXPORT} FROM ("
        + _first_by(
            "orders_clean",
            "customer_id",
            "date DESC, order_id DESC",
            f"status = 'COMPLETED' AND customer_id IS NOT NULL "
            f"AND {_days(_ts(P.AS_OF), 'previous_order_date')} > 120",
        )
        + ")"
    ),
    "retarget_non_buyer_buckets": "SELECT * FROM non_buyer_buckets_std",
    "non_buyers_latest": "SELECT * FROM non_buyers_std",
    "retarget_non_buyers_60": f"SELECT {_EXPORT} FROM non_buyer_buckets_std WHERE bucket = '{P.NON_BUYER_BUCKET}'",
    "non_buyers_cumulative": (
        f"SELECT {_EXPORT} FROM non_buyers_std WHERE {_days(_ts(P.AS_OF), 'previous_order_date')} <= {P.NON_BUYER_CUMULATIVE_DAYS}"
    ),
    "checkout_payment_screen": """
SELECT * EXCLUDE (_rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY email ORDER BY date DESC, order_id DESC) AS _rn FROM (
    SELECT su.email, su.date, su.date_registration, su.phone, su.origin, su.customer_id,
      ov.business_cat, ov.order_id, ov.status
    FROM (SELECT u.date AS date_registration, u.email, u.phone, u.origin, u.customer_id,
            CAST(sc."Date de Payment method screen" AS DATE) AS date
          FROM users_clean u JOIN raw_payment_screen sc ON u.email = sc.email
          WHERE u.date >= {start} AND u.date <= {end}) su
    JOIN (SELECT CAST(date AS DATE) AS date, business_cat, order_id, status, customer_email AS email
          FROM orders_clean WHERE date = CAST(CAST(date AS DATE) AS TIMESTAMP)) ov
      ON su.email = ov.email AND su.date = ov.date
    WHERE NOT coalesce(ov.status = 'COMPLETED', false)))
WHERE _rn = 1
""".format(start=_d(P.USERS_START), end=_d(P.USERS_END)),
}


def _funnel_sql(flags: str, formatted: bool = False, origin: str | None = None) -> str:
    signups = "signups_local_distinct" if origin else "signups_distinct"
    dl_origin = f" AND customer_origine = '{origin}'" if origin else ""
    fo_origin = f" WHERE origin = '{origin}'" if origin else ""
    rows = [
        ("downloads", "SELECT CAST(coalesce(sum(downloads), 0) AS BIGINT) FROM raw_downloads "
                      f"WHERE date >= {_d(P.USERS_START)} AND date <= {_d(P.USERS_END)}{dl_origin}"),
        ("new_signups", f"SELECT count(*) FROM {signups}"),
        ("signups_never_ordered", f"SELECT count(*) FROM {signups} s WHERE NOT EXISTS "
                                  f"(SELECT 1 FROM {flags} f WHERE f.customer_id = s.customer_id)"),
        ("signups_first_open", f"SELECT count(*) FROM first_open_std{fo_origin}"),
        ("signups_ordered", f"SELECT count(*) FROM {flags}"),
        ("signups_ordered_not_purchased", f"SELECT count(*) FROM {flags} WHERE new_status <> 'COMPLETED'"),
        ("signups_checkout_abandoned",
         f"SELECT count(*) FROM {flags} WHERE status = 'In_Progress' AND NOT any_completed"),
        ("signups_purchased", f"SELECT count(*) FROM {flags} WHERE new_status = 'COMPLETED'"),
    ]
    value = "replace(format('{{:,}}', ({q})), ',', ' ')" if formatted else "CAST(({q}) AS BIGINT)"
    return " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS ord, '{m}' AS measure, {value.format(q=q)} AS value"
        for i, (m, q) in enumerate(rows, start=1)
    )


BODIES["default_date_range_from_store"] = BODIES["default_date_range"]
BODIES["non_buyers_from_store"] = BODIES["non_buyers_latest"]
BODIES["customer_flags_from_store"] = BODIES["segment_ordered"]
BODIES["signup_orders_spread"] = BODIES["signup_orders"]
BODIES["funnel_metrics"] = _funnel_sql("flags_std")
BODIES["funnel_metrics_from_sheets"] = BODIES["funnel_metrics"]
BODIES["funnel_metrics_text"] = _funnel_sql("flags_std", formatted=True)
BODIES["funnel_metrics_alimentation"] = _funnel_sql("flags_alimentation")
BODIES["funnel_metrics_local"] = _funnel_sql("flags_local", origin="Local")
_SIGNUP_COLUMNS = "customer_id, registration_date, last_name, first_name, phone, email, customer_country, origin"
_ORDER_COLUMNS = "order_date, order_id, status, new_status, orders_origin, business_cat, total_amount_dzd"
_AS_SIGNUPS = "SELECT * RENAME (date AS registration_date) FROM ({})"
_AS_ORDERS = "SELECT * RENAME (date AS order_date) FROM ({})"
BODIES["segment_export_roundtrip"] = " UNION ALL BY NAME ".join(
    [
        f"SELECT 'new_signups' AS segment, {_SIGNUP_COLUMNS} FROM ({_AS_SIGNUPS.format('SELECT * FROM signups_std')})",
        f"SELECT 'not_ordered' AS segment, {_SIGNUP_COLUMNS} FROM ({_AS_SIGNUPS.format(BODIES['segment_not_ordered'])})",
        *(
            f"SELECT '{seg}' AS segment, {_SIGNUP_COLUMNS}, {_ORDER_COLUMNS} FROM ({_AS_ORDERS.format(BODIES['segment_' + seg])})"
            for seg in ("ordered", "completed", "in_progress", "checkout_abandoned", "not_completed")
        ),
        f"SELECT 'first_open' AS segment, * FROM ({_AS_SIGNUPS.format('SELECT * FROM first_open_std')})",
    ]
)


def _needed(text: str) -> list[str]:
    """Shared CTEs referenced by ``text``, with their dependencies, in order."""
    names = list(BASE)
    need: set[str] = set()
    stack = [text]
    while stack:
        t = stack.pop()
        for n in names:
            if n not in need and re.search(rf"\b{n}\b", t):
                need.add(n)
                stack.append(BASE[n])
    return [n for n in names if n in need]


def build(body: str) -> str:
    ctes = _needed(body)
    if not ctes:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({BASE[n]})" for n in ctes) + "\n" + body


def oracle_sql() -> dict[str, str]:
    return {k: build(v) for k, v in BODIES.items()}
