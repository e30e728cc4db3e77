"""shopmetrics — customer-commerce reports as lazy Spark DataFrame operators.

Sub-packages:
  sources    readers, report writers, driver-table fixtures
  functions  column helpers (calendar maths, null-safe predicates, text)
  operators  the reports: cohorts, LTV, communes, funnel, retargeting
  plans      the registered queries with their parameters and oracle SQL
"""

__version__ = "0.1.0"
