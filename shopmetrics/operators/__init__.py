"""DataFrame-in / DataFrame-out report operators."""

from .acquisition import (
    distinct_signups,
    downloads_slice,
    first_open_signups,
    funnel_metrics,
    funnel_segments,
    new_signups,
    order_flags,
    segments_long,
    signup_flags,
    signup_orders,
    signups_by_period,
)
from .clean import clean_ltv, clean_orders, clean_users, external_orders, payment_screen_view
from .cohort import (
    churn_deltas,
    cohort_counts,
    cohort_counts_estimate,
    cohort_matrix,
    month_sketches,
    period_range,
    retention,
    retention_matrix,
    retention_text,
    retention_text_matrix,
)
from .dedupe import distinct_ids, keep_first, keep_last
from .dormant import checkout_payment_screen, payment_screen_table
from .geo import commune_map_points, customers_by_commune, wilaya_centres
from .ltv import category_ltv, category_ltv_summary, customer_ltv, ltv_series
from .retargeting import (
    non_buyer_buckets,
    non_buyers,
    non_buyers_cumulative,
    retarget_buyers,
    retarget_non_buyers,
)
from .present import by_count_desc, by_keys, by_total_asc, decimals_as_double, with_position
from .skew import heavy_keys, spread_join
from .slices import choices, default_range, drop_null_keys, since, slice_rows

__all__ = [name for name in dir() if not name.startswith("_")]
