"""Column-level helpers: calendar maths, predicates, text formatting."""

from .predicates import (
    exclude_ids,
    fold_status,
    in_or_all,
    not_in_null_safe,
    strip_float_suffix,
    strip_list_marks,
)
from .textfmt import (
    fixed2_text,
    half_even_ratio,
    label_with_percent,
    percent_hover_text,
    percent_text,
    short2_text,
    thousands,
)
from .timefn import (
    days_to_months,
    month_diff,
    month_label,
    month_start,
    sunday_week_start,
    to_ts_literal,
    whole_days,
)

__all__ = [
    "days_to_months",
    "exclude_ids",
    "fixed2_text",
    "fold_status",
    "half_even_ratio",
    "in_or_all",
    "label_with_percent",
    "month_diff",
    "month_label",
    "month_start",
    "not_in_null_safe",
    "percent_hover_text",
    "percent_text",
    "short2_text",
    "strip_float_suffix",
    "strip_list_marks",
    "sunday_week_start",
    "thousands",
    "to_ts_literal",
    "whole_days",
]
