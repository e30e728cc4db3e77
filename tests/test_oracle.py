"""Every registered query agrees with its DuckDB oracle (sf0.001)."""

import pytest

import __spark_entry__ as E
from shopmetrics.plans import catalog, oracle
from tests.oracle_check import compare

KEYS = sorted(catalog.queries())


def test_every_query_has_an_oracle():
    assert set(oracle.oracle_sql()) == set(catalog.queries())
    assert set(catalog.queries()) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, small_dir, key):
    res = compare(spark, small_dir, [key], verbose=False)[key]
    assert res.startswith("OK"), res


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["cohort", "period_number", "n_customers", "cohort_size", "retention_rate"]
    assert df.count() > 0
