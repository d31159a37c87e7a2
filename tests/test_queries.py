"""Every registered query against its SQL oracle, on the smallest given tables."""

import pytest

import __spark_entry__ as entry
from tests.check import compare

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_oracle(spark, name):
    plan, sql = entry.queries()[name], entry.oracle_sql().get(name)
    df = plan(spark, SF_DIR)
    assert compare(df, SF_DIR, sql) is None
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in physical and "NestedLoopJoin" not in physical
    spark.catalog.clearCache()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["query", "rank", "match", "distance"]
