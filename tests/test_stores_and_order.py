"""Hot keys spread, the bucketed order store, dates from statistics, and places in an order."""

import datetime as dt
import os
import random
import statistics
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from shopmetrics import operators as op
from shopmetrics.sources import default_range_of_store, open_order_store, statistics_session, write_order_store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_help(spark):
    """No broadcast and no run-time splitting."""
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_a_hot_customer_is_spread(spark, no_help):
    facts = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("c"), F.col("id") % 4000)).alias("customer_id"),
        F.col("id").cast("string").alias("order_id"), F.lit(1).alias("part"),
    )
    ones = facts.where("customer_id IS NOT NULL").select("customer_id").distinct().withColumn("name", F.concat(F.lit("n-"), "customer_id"))
    heavy = op.heavy_keys(facts, "customer_id")
    assert set(heavy) == {"hot"} and heavy["hot"] > 100
    for how in ("inner", "left"):
        out = op.spread_join(facts, ones, "customer_id", "order_id", how=how)
        want = facts.join(ones, "customer_id", how)
        assert out.columns == want.columns and out.count() == want.count()
        assert out.exceptAll(want).count() == 0
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 2 * statistics.median(sizes)
    plain = [r["count"] for r in facts.join(ones, "customer_id").groupBy(F.spark_partition_id()).count().collect()]
    assert max(plain) > 2 * statistics.median(plain)


def test_no_heavy_key_and_no_rows(spark):
    facts = spark.createDataFrame([], "customer_id string, order_id string")
    ones = spark.createDataFrame([("a", 1)], "customer_id string, v long")
    assert op.heavy_keys(facts, "customer_id") == {}
    assert op.spread_join(facts, ones, "customer_id", "order_id").count() == 0


@pytest.fixture(scope="module")
def store(spark, small_dir):
    from shopmetrics.plans.catalog import Inputs

    orders = Inputs(spark, small_dir).orders
    path = os.path.join(tempfile.mkdtemp(prefix="shopmetrics-test-"), "orders")
    return orders, write_order_store(orders, f"store_{uuid.uuid4().hex}", path, buckets=4, files_per_bucket=2), path


def test_reports_over_the_store_do_not_shuffle_it(spark, store):
    orders, stored, path = store
    assert stored.drop("order_day").exceptAll(orders).count() == 0 and stored.count() == orders.count()
    as_of = dt.datetime(2001, 9, 1, 12)
    for report in (op.non_buyers, lambda o: op.order_flags(o), lambda o: op.retarget_buyers(o, "over_120", as_of), lambda o: op.non_buyer_buckets(o, as_of)):
        assert "Exchange" not in plan(report(stored))
        assert sorted(map(str, report(stored).collect())) == sorted(map(str, report(orders).collect()))
    again = open_order_store(spark, f"again_{uuid.uuid4().hex}", path, buckets=4)
    assert "Exchange" not in plan(op.non_buyers(again)) and again.count() == orders.count()


def test_customer_joins_move_only_the_sign_ups(spark, store, small_dir, no_help):
    from shopmetrics.plans.catalog import Inputs

    flags = op.signup_flags(store[1], Inputs(spark, small_dir).signups)
    above_orders = plan(flags).split("Scan parquet spark_catalog")[0]
    assert above_orders.count("Exchange hashpartitioning(customer_id") <= 1


def test_largest_date_is_read_from_statistics(spark, store):
    orders, _, path = store
    as_of = dt.datetime(1999, 6, 30)
    assert default_range_of_store(spark, path, as_of).collect() == op.default_range(orders, as_of).collect()
    last = statistics_session(spark).read.parquet(path).agg(F.max("order_day"))
    assert "PushedAggregation: [MAX(order_day)]" in plan(last)
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""  # the caller's session is as it was


def test_positions_are_the_order(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(40), rng.choice(["a", "b", None]), k % 7) for k in range(3000)] + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "n long, place string, v long").repartition(5)
    got = sorted(op.with_position(df, F.desc("n"), "place").collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(1, len(rows) + 1))
    low = lambda v: (v is not None, v or 0 if not isinstance(v, str) else v)  # noqa: E731 - nulls first, as Spark sorts ascending
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] is not None, r[1] or ""), low(r[2])))
    assert [tuple(r)[:3] for r in got] == want
    assert op.with_position(df.limit(0), "n").count() == 0
