"""Number → text helpers for report cells.

Percentages are rounded from the exact ratio of two integers with
half-even rounding done in integer arithmetic, so the text does not
depend on how an engine rounds a binary double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even_ratio(num, den, scale: int) -> Column:
    """round_half_even(num * 10**scale / den) as BIGINT, for integer inputs.

    NULL when ``den`` is 0 or NULL (the reference divides by zero into
    inf/NaN; T9). Half-even is symmetric, so the sizes are rounded and the
    sign is put back.
    """
    sign = F.signum(_col(num).cast("double")) * F.signum(_col(den).cast("double"))
    n = F.abs(_col(num).cast("long")) * F.lit(10**scale)
    d = F.abs(_col(den).cast("long"))
    q = F.floor(n / d).cast("long")
    r = n - q * d
    up = (F.lit(2) * r > d) | ((F.lit(2) * r == d) & (q % 2 == 1))
    return F.when(d != 0, (q + F.when(up, 1).otherwise(0)) * sign.cast("long"))


def fixed2_text(hundredths) -> Column:
    """``12.30`` style text of a value held as integer hundredths."""
    h = _col(hundredths)
    whole = F.floor(F.abs(h) / 100).cast("long")
    frac = (F.abs(h) % 100).cast("int")
    sign = F.when(h < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, whole.cast("string"), F.lit("."), F.lpad(frac.cast("string"), 2, "0"))


def short2_text(hundredths) -> Column:
    """Shortest text of a 2-decimal value held as hundredths: 12.0, 12.5, 12.34.

    This is what ``str(round(x, 2))`` prints for a value in normal range.
    """
    h = _col(hundredths)
    whole = F.floor(F.abs(h) / 100).cast("long").cast("string")
    frac = (F.abs(h) % 100).cast("int")
    sign = F.when(h < 0, F.lit("-")).otherwise(F.lit(""))
    tail = (
        F.when(frac % 10 == 0, (frac / 10).cast("int").cast("string"))
        .otherwise(F.lpad(frac.cast("string"), 2, "0"))
    )
    return F.concat(sign, whole, F.lit("."), tail)


def percent_text(num, den) -> Column:
    """``num/den`` as a percentage with two decimals, '' when missing."""
    return F.coalesce(fixed2_text(half_even_ratio(num, den, 4)), F.lit(""))


def percent_hover_text(num, den) -> Column:
    """``x.xx%`` text; NULL stays NULL (X11)."""
    return F.concat(fixed2_text(half_even_ratio(num, den, 4)), F.lit("%"))


def thousands(c, sep: str) -> Column:
    """Integer text with a thousands separator (X14 '.', X15 ' ')."""
    return F.regexp_replace(F.format_number(_col(c), 0), ",", sep)


def label_with_percent(label, hundredths) -> Column:
    """``Category (12.5%)`` label (X13); the bare category where there is no percentage."""
    return F.coalesce(F.concat(_col(label), F.lit(" ("), short2_text(hundredths), F.lit("%)")), _col(label))
