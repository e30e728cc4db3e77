"""Plan properties that matter at scale, checked on the physical plans."""

import re

import pytest

import __spark_entry__ as E
from shopmetrics import operators as op

NO_FILE_SIDE_EFFECT = [k for k in sorted(E.queries()) if not k.endswith("roundtrip")]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark, small_dir):
    qs = E.queries()
    return {k: plan_of(qs[k](spark, small_dir)) for k in NO_FILE_SIDE_EFFECT}


def test_no_cross_or_nested_loop_joins_and_no_python_udfs(plans):
    for key, p in plans.items():
        assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", p), key
        assert not re.search(r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas", p), key


def test_date_slices_reach_the_orders_scan(plans):
    # Reports that do not read the order sequence get the date bound in the
    # scan. (Those that output Occurence / previous_order_date, such as
    # slice_orders, must see earlier orders too, so there it stays above.)
    for key in ("cohort_counts", "customer_ltv", "churn_deltas", "signup_orders"):
        scans = [s for s in re.findall(r"FileScan parquet [^\n]*", plans[key]) if "orders.parquet" in s]
        assert scans and all("GreaterThanOrEqual(o_orderdate" in s for s in scans), key


def test_cohort_plan_reads_orders_once(plans):
    # the order-sequence branch of the fixture is pruned when unused
    assert len(re.findall(r"FileScan parquet [^\n]*orders\.parquet", plans["cohort_counts"])) == 1


def test_scans_read_only_needed_columns(plans):
    scan = re.search(r"FileScan parquet \[([^\]]*)\][^\n]*lineitem\.parquet", plans["customer_ltv"])
    assert scan
    assert {re.sub(r"#\d+L?", "", c) for c in scan.group(1).split(",")} == {
        "l_orderkey", "l_extendedprice", "l_discount"
    }


def test_keep_first_is_an_aggregate_not_a_window(spark):
    df = spark.createDataFrame([("a", 1, 2)], "k string, d int, id int")
    p = plan_of(op.keep_first(df, ["k"], ["d", "id"]))
    assert "Window" not in p and "Aggregate" in p
