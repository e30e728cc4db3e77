"""Cleaned orders stored once, bucketed by customer.

Reports that reduce or join orders per customer read the buckets without a shuffle of the orders. The largest date comes from
the files' statistics, without reading rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefn import to_ts_literal
from ..session import apply_report_conf

DAY = "order_day"  # the order's day as DATE: the type whose bounds Parquet footers answer


def write_order_store(orders: DataFrame, table: str, path: str, buckets: int = 64, files_per_bucket: int = 4) -> DataFrame:
    """Write ``orders`` as catalog table ``table`` at ``path``, bucketed by ``customer_id``, and open it.

    A task writes one file of one bucket; a bucket's rows are dealt over ``files_per_bucket`` tasks by order id, so
    a heavy customer, or the rows without one, are written by that many tasks. (Reading, a bucket is one task: a
    customer with a third of all orders is better served by the plain table.)
    """
    bucket = F.pmod(F.hash("customer_id"), F.lit(buckets))  # the hash that bucketing uses
    place = bucket * files_per_bucket + F.pmod(F.xxhash64("order_id"), F.lit(files_per_bucket))
    rows = orders.withColumn(DAY, F.to_date("date")).repartitionById(buckets * files_per_bucket, place.cast("int"))
    rows.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, "customer_id").saveAsTable(table)
    return orders.sparkSession.table(table)


def open_order_store(spark: SparkSession, table: str, path: str, buckets: int = 64) -> DataFrame:
    """A store that another session wrote, registered under ``table`` where the catalog does not know it."""
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (customer_id) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def statistics_session(spark: SparkSession) -> SparkSession:
    """A session beside the caller's whose Parquet reader answers MIN, MAX and COUNT from file footers."""
    beside = spark.newSession()
    apply_report_conf(beside)
    beside.conf.set("spark.sql.sources.useV1SourceList", "")
    beside.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return beside


def default_range_of_store(spark: SparkSession, path: str, as_of) -> DataFrame:
    """``slices.default_range`` over a stored order table: the end date from the statistics of its files."""
    last = statistics_session(spark).read.parquet(path).agg(F.max(DAY).alias("end_date"))
    start = F.make_date(F.year(F.date_sub(F.to_date(to_ts_literal(as_of)), 365)), F.lit(1), F.lit(1))
    return last.select(start.alias("start_date"), "end_date")
