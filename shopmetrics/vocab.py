"""Values the reports share with the order system's exports.

Fixed values: these labels and definitions must equal the ones in the data
and in the reports being rebuilt; changing one changes results.
"""

# Order status labels in the exports.
COMPLETED = "COMPLETED"
IN_PROGRESS = "In_Progress"
ABANDONED = "ABANDONED"
# The other label of the two-value status fold.
NOT_COMPLETED = "NOT COMPLETED"

# Order type of orders placed through the external channel.
EXTERNAL_ORDER_TYPE = "EXTERNE"

# The two mobile-recharge labels folded into one category,
# and the three categories kept by the lifetime-value reports.
CATEGORY_MAP = {"Recharge mobile": "Airtime", "Recharge mobile / ADSL": "Airtime"}
LTV_CATEGORIES = ("Airtime", "Alimentation", "Shopping")

# Recency buckets of customers without a completed order,
# label → inclusive day range (None = open end). Exactly 120 days is in none.
NON_BUYER_BUCKETS = {
    "7": (None, 6),
    "14": (7, 13),
    "21": (14, 20),
    "30": (21, 29),
    "60": (30, 59),
    "90": (60, 89),
    "120": (90, 119),
    "over_120": (121, None),
}
OVER_120 = "over_120"
