"""Record queries over a signal with more than 10,000 candidates, close together, against DuckDB."""

import os

import pytest

from oracle import TABLES, same, sql_rows
from seriescope.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def many(spark, sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("many"))
    for t in TABLES:
        if t != "events":
            os.symlink(f"{sf}/{t}.parquet", f"{folder}/{t}.parquet")
    ts = "cast(timestampadd(second, cast(id as int), timestamp'2024-01-01') as timestamp_ntz) as ts"
    rows = spark.range(60_000).selectExpr("id as event_id", ts, "cast(1 as bigint) as user_id", "'click' as event_type", "if(pmod(xxhash64(id), 4) = 0, 5d, 1d) as value", "'{}' as props")
    rows.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["b12_route", "b13_drop_removed", "p1_validate", "p2_coverage", "p4_record_key", "p6_support", "p7_accept_add", "p9_candidate_groups"])
def test_records_equal_sql(spark, many, name):
    rows = QUERIES[name](spark, many).toPandas()
    assert len(rows) > 2000
    same(rows, sql_rows(SQL[name], many))
