"""Customers per commune and the map layer.

Counts, first coordinates and first region of a commune come from one
``groupBy("commune")`` with ``min_by`` over the row order key, so the
reference's join back to the raw rows (which fans out N-fold and then
deduplicates) is not needed. The aggregate combines map-side, so one
very large commune costs no more than a small one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def customers_by_commune(geo: DataFrame, order_by: str = "row_key") -> DataFrame:
    """``commune, n_customers, latitude, longitude, wilaya`` (R9: A9, A10, J3, J4, D4).

    Latitude and longitude are each the first non-missing value in row
    order, independently; the region is the one on the commune's first
    row, missing or not. NULL communes are left out.
    """
    k = F.col(order_by)
    lat, lon = F.col("Latitude"), F.col("Longitude")
    return (
        geo.filter(F.col("commune").isNotNull())
        .groupBy("commune")
        .agg(
            F.count(F.lit(1)).alias("n_customers"),
            F.min_by(lat, F.when(lat.isNotNull(), k)).alias("latitude"),
            F.min_by(lon, F.when(lon.isNotNull(), k)).alias("longitude"),
            F.min_by(F.col("wilaya"), k).alias("wilaya"),
        )
    )


def commune_map_points(communes: DataFrame, wilaya: str | None = None, lo: float = 5.0, hi: float = 20.0) -> DataFrame:
    """Map points of one region, or of all regions when ``wilaya`` is None
    (R10: F18, A14, X16, X17).

    Marker size interpolates log(count) between the smallest and largest
    count of the region onto [lo, hi]; a region whose counts are all equal
    gets ``hi``. Sizes are rounded to 6 places.
    """
    pts = communes if wilaya is None else communes.filter(F.col("wilaya") == wilaya)
    w = Window.partitionBy("wilaya")
    mn, mx = F.min("n_customers").over(w), F.max("n_customers").over(w)
    pts = pts.withColumn("_min", mn).withColumn("_max", mx)
    ln_n, ln_min, ln_max = F.log(F.col("n_customers")), F.log(F.col("_min")), F.log(F.col("_max"))
    size = F.when(F.col("_min") == F.col("_max"), F.lit(hi)).otherwise(
        F.lit(lo) + (ln_n - ln_min) * F.lit(hi - lo) / (ln_max - ln_min)
    )
    return pts.select(
        "wilaya",
        "commune",
        "latitude",
        "longitude",
        "n_customers",
        F.round(size, 6).alias("marker_size"),
        F.concat(
            F.lit("Commune: "), F.col("commune"), F.lit(" - customers: "), F.col("n_customers").cast("string")
        ).alias("label"),
    )


def wilaya_centres(communes: DataFrame) -> DataFrame:
    """Map centre of each region: unweighted mean of its communes'
    coordinates, missing ones skipped (A15). Summed as DECIMAL so the mean
    does not depend on summation order."""
    def mean(c):
        total = F.sum(F.col(c).cast("decimal(24,9)")).cast("double")
        return F.try_divide(total, F.count(c)).alias(f"centre_{c}")

    return communes.groupBy("wilaya").agg(mean("latitude"), mean("longitude"))
