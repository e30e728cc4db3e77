"""Standard parameters of the registered queries (FIXTURES.md).

The same values are spelled into the oracle SQL, so a change here must be
mirrored in ``plans.oracle``.
"""

import datetime as dt

SLICE_START = dt.date(1998, 1, 1)
SLICE_END = dt.date(1998, 12, 31)
COHORT_PERIODS = tuple(range(12))
LONG_START = dt.date(1997, 1, 1)
LONG_PERIODS = tuple(range(24))

FUNNEL_SINCE = dt.date(2001, 1, 1)
USERS_START = dt.date(1995, 1, 1)
USERS_END = dt.date(2001, 12, 31)

AS_OF = dt.datetime(2001, 9, 1, 12, 0, 0)
DEFAULT_RANGE_AS_OF = dt.datetime(1999, 6, 30, 0, 0, 0)

EXCLUDED_ORDERS = ("10", "20", "30")
EXCLUDED_CUSTOMERS = ("5", "15", "25")
EXTERNAL_CUSTOMERS = ("7", "11", "40", "100")
LTV_CATEGORIES = ("Airtime", "Alimentation", "Shopping")

BUYER_DAYS = 120
NON_BUYER_BUCKET = 60
NON_BUYER_CUMULATIVE_DAYS = 120
MAP_WILAYA = "NATION_3"
USERS_COUNTRY = "NATION_5"
