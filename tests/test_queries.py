"""Every query with SQL gives the rows that DuckDB gives."""

import pytest

from oracle import same, sql_rows
from seriescope.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    same(QUERIES[name](spark, sf).toPandas(), sql_rows(SQL[name], sf))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_entry_module_offers_all(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["signal_id", "start_idx", "end_idx", "severity"]
