"""Explicit schemas of the logical input tables.

Ids are text on purpose (T2): a float-typed id printed by Spark would come
out in scientific notation. Readers never infer types.
"""

from pyspark.sql import types as T

S, TS, D, DBL, L, B = (
    T.StringType(),
    T.TimestampNTZType(),
    T.DateType(),
    T.DoubleType(),
    T.LongType(),
    T.BooleanType(),
)


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Export of the order system, as the reports receive it.
RAW_ORDERS = _schema(
    ("order_id", S),
    ("customer_id", S),
    ("date", TS),
    ("job_status", S),
    ("customer_origine", S),
    ("paymentType", S),
    ("Order Type", S),
    ("businessCat", S),
    ("Occurence", L),
    ("previous_order_date", TS),
    ("returning_customer", B),
    ("customer_username", S),
    ("customer_phone", S),
    ("customer_email", S),
    ("total_amount_dzd", DBL),
)

RAW_LTV = _schema(
    ("order_id", S),
    ("customer_id", S),
    ("job_status", S),
    ("businessCat", S),
    ("customer_origine", S),
    ("date", TS),
    ("total_amount_dzd", T.DecimalType(18, 2)),
    ("EUR", T.DecimalType(18, 12)),
    ("marge_dzd", T.DecimalType(24, 8)),
    ("marge_eur", T.DecimalType(28, 8)),
)

RAW_USERS = _schema(
    ("customer_id", S),
    ("date", D),
    ("email", S),
    ("phone", S),
    ("firstName", S),
    ("lastName", S),
    ("customer_country", S),
    ("Origine", S),
    ("tags", S),
)

RAW_GEO = _schema(
    ("row_key", L),
    ("commune", S),
    ("wilaya", S),
    ("Latitude", DBL),
    ("Longitude", DBL),
)

# The location export itself has no row key; its rows' places in the files order them.
RAW_GEO_EXPORT = _schema(("commune", S), ("wilaya", S), ("Latitude", DBL), ("Longitude", DBL))

# Fixed value: the downloads sheet's own column name.
DOWNLOADS_COLUMNS = {"Téléchargement": "downloads"}

RAW_DOWNLOADS = _schema(("date", D), ("customer_origine", S), ("downloads", L))

RAW_FIRST_OPEN = _schema(
    ("row_key", L), ("sheet_no", L), ("email", S), ("first_open_date", D)
)

RAW_PAYMENT_SCREEN = _schema(("email", S), ("Date de Payment method screen", S))

# Cleaned tables (output of operators.clean).
ORDERS = _schema(
    ("date", TS),
    ("status", S),
    ("origin", S),
    ("payment_type", S),
    ("order_id", S),
    ("order_type", S),
    ("business_cat", S),
    ("customer_id", S),
    ("occurrence", L),
    ("previous_order_date", TS),
    ("returning_customer", B),
    ("customer_username", S),
    ("customer_phone", S),
    ("customer_email", S),
    ("total_amount_dzd", DBL),
)
