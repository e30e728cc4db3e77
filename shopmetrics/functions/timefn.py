"""Calendar helpers (month, month offset, Sunday week, whole days).

All helpers return Column expressions built from built-in functions, so
they stay inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

_US_PER_DAY = 86_400_000_000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_start(c) -> Column:
    """First day of the month as DATE.

    ``date_trunc`` on a timestamp_ntz returns a zoned timestamp, so the
    result is cast to DATE to keep one type across engines.
    """
    return F.trunc(F.to_date(_col(c)), "MM")


def month_label(c) -> Column:
    """``yyyy-MM`` text of a date or timestamp."""
    return F.date_format(_col(c), "yyyy-MM")


def month_diff(later, earlier) -> Column:
    """Whole calendar months between two month starts, as INT."""
    a, b = _col(later), _col(earlier)
    return ((F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)).cast("int")


def sunday_week_start(c) -> Column:
    """Sunday that opens the week of ``c``.

    Spark's ``dayofweek`` is 1 for Sunday, so subtracting ``dayofweek-1``
    days lands on the Sunday on or before the date.
    """
    d = F.to_date(_col(c))
    return F.date_sub(d, F.dayofweek(d) - 1)


def to_ts_literal(value) -> Column:
    """A timestamp_ntz literal at midnight (for dates) or at the given time."""
    if isinstance(value, _dt.datetime):
        text = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(value, _dt.date):
        text = value.strftime("%Y-%m-%d 00:00:00")
    else:
        text = str(value)
    return F.to_timestamp_ntz(F.lit(text))


def whole_days(later, earlier) -> Column:
    """Floor of elapsed 24-hour periods from ``earlier`` to ``later``.

    Floors negative differences too (-12 h gives -1), unlike ``datediff``
    which counts midnights, and unlike ``timestampdiff(DAY)`` which
    truncates toward zero. Computed from microseconds so sub-day times
    are honoured.
    """
    micros = F.timestamp_diff("MICROSECOND", _col(earlier), _col(later))
    return F.floor(micros / F.lit(_US_PER_DAY)).cast("long")


def days_before(as_of, days: int) -> Column:
    """A timestamp_ntz literal that many days (of 24 hours) before ``as_of``."""
    if isinstance(as_of, _dt.date):
        at = as_of if isinstance(as_of, _dt.datetime) else _dt.datetime(as_of.year, as_of.month, as_of.day)
        return to_ts_literal(at - _dt.timedelta(days=days))
    return to_ts_literal(as_of) - F.make_dt_interval(F.lit(days))


def days_to_months(days) -> Column:
    """Lifetime in months as DOUBLE: days / 30."""
    return _col(days).cast("double") / F.lit(30.0)
