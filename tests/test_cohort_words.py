"""Month bitsets, month sketches and exclusions of known size."""

import datetime as dt
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from shopmetrics import operators as op
from shopmetrics.functions import exclude_ids
from shopmetrics.functions import predicates


def orders_of(spark, rows):
    schema = "customer_id string, date timestamp_ntz, origin string, business_cat string, status string"
    return spark.createDataFrame([(c, d, o, "Airtime", s) for c, d, o, s in rows], schema)


def some_orders(seed=2, customers=60, first=1990, years=14):
    rng = random.Random(seed)
    rows = []
    for c in range(customers):
        for _ in range(rng.randint(1, 9)):
            d = dt.datetime(first + rng.randrange(years), rng.randint(1, 12), rng.randint(1, 28), rng.randrange(24))
            rows.append((str(c) if c else None, d, rng.choice(["Local", "Diaspora"]), rng.choice(["COMPLETED"] * 3 + ["In_Progress"])))
    return rows + [("7", None, "Local", "COMPLETED"), ("only-null", None, "Local", "COMPLETED")]


def brute(rows, start=None, end=None):
    months = {}
    for c, d, _, status in rows:
        if c is None or d is None or status != "COMPLETED" or (start and d < dt.datetime.combine(start, dt.time())) or (end and d > dt.datetime.combine(end, dt.time())):
            continue
        months.setdefault(c, set()).add(d.year * 12 + d.month - 1)
    out = {}
    for own in months.values():
        for m in own:
            key = (dt.date(min(own) // 12, min(own) % 12 + 1, 1), m - min(own))
            out[key] = out.get(key, 0) + 1
    return out


@pytest.mark.parametrize("start, end", [(None, None), (dt.date(1995, 3, 15), None), (None, dt.date(1999, 2, 28)), (dt.date(1994, 5, 1), dt.date(1999, 7, 31)), (dt.date(1991, 1, 1), dt.date(2003, 12, 31))])
def test_months_as_bits_are_distinct_months(spark, start, end):
    rows = some_orders() + some_orders(seed=4, customers=20, first=1955, years=20)  # before the epoch too
    got = op.cohort_counts(orders_of(spark, rows), start=start, end=end).collect()
    assert {(r.cohort, r.period_number): r.n_customers for r in got} == brute(rows, start, end)


def test_cohorts_of_no_rows(spark):
    assert op.cohort_counts(orders_of(spark, []), start=dt.date(1998, 1, 1), end=dt.date(1998, 12, 31)).count() == 0


def test_one_slice_is_plain_hash_aggregates(spark, small_dir):
    import __spark_entry__ as E

    plan = E.queries()["cohort_counts"](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan and "Generate" not in plan


def test_sketches_estimate_any_slice_within_the_bound(spark):
    rng = random.Random(5)
    rows = []
    for c in range(6000):
        first = rng.randrange(10)
        for m in {first} | {m for m in range(first, 12) if rng.random() < 0.3}:
            rows.append((f"c{c}", dt.datetime(2020, m + 1, 1 + c % 28), "Local" if c % 3 else "Diaspora", "COMPLETED"))
    sketches = op.month_sketches(orders_of(spark, rows), lg_entries=9)
    for origin, start, end in ((None, None, None), ("Local", dt.date(2020, 4, 1), dt.date(2020, 9, 30))):
        want = brute([r for r in rows if origin in (None, r[2])], start, end)
        got = {(r.cohort, r.period_number): (r.estimate, r.error_bound) for r in op.cohort_counts_estimate(sketches, origin, start=start, end=end, lg_entries=9).collect()}
        assert set(got) <= set(want)
        bound = max(b for _, b in got.values())
        assert bound > 0  # the sketches do not hold every customer here
        assert all(abs(got.get(k, (0, bound))[0] - n) <= got.get(k, (0, bound))[1] + 0.5 for k, n in want.items())


def test_exact_while_the_sketch_holds_all(spark):
    rows = some_orders()
    sketches = op.month_sketches(orders_of(spark, rows))
    got = op.cohort_counts_estimate(sketches, start=dt.date(1995, 1, 1), end=dt.date(1999, 12, 31)).collect()
    assert {(r.cohort, r.period_number): round(r.estimate) for r in got} == brute(rows, dt.date(1995, 1, 1), dt.date(2000, 1, 1))
    assert all(r.error_bound == 0 for r in got)


def test_listed_ids_do_not_shuffle_a_stored_table(spark, monkeypatch):
    path = os.path.join(tempfile.mkdtemp(prefix="shopmetrics-test-"), "orders")
    spark.range(5000).select(F.when(F.col("id") % 9 > 0, F.col("id").cast("string")).alias("order_id"), F.col("id").alias("v")).write.parquet(path)
    stored = spark.read.parquet(path)
    for limit in (predicates.INLINE_IDS, 2):  # as a predicate, and as a relation of known size
        monkeypatch.setattr(predicates, "INLINE_IDS", limit)
        out = exclude_ids(stored, "order_id", ["1", "2", "4000"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(order_id" not in plan and "SortMergeJoin" not in plan
        assert out.count() == 4997
    monkeypatch.setattr(predicates, "INLINE_IDS", 2)
    assert exclude_ids(stored, "order_id", spark.createDataFrame([("1",), (None,)], "x string")).count() == 4999
