"""Plans keep to what a large cluster needs: pruned scans, no products of tables."""

import re

import pytest

from seriescope.plans.queries import QUERIES


@pytest.mark.parametrize("name", ["b2_interpolate", "b5_detrend", "n1_robust_positive_z", "n3_ewma", "n5_sliding_threshold", "n6_intervals", "n11_interval_bounds", "n12_time_to_index", "n13_binary", "v5_point_f1max", "p3_add_overlap", "p6_support", "j12_interval_overlap"])
def test_no_product_of_tables(spark, sf, name):
    """Queries over one signal are left out: their keys are constants, which the planner folds away."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_two_columns(spark, sf):
    plan = QUERIES["n3_ewma"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    schemas = set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan))
    assert schemas and all("props" not in s and "user_id" not in s for s in schemas)


def test_filters_reach_the_files(spark, tmp_path):
    from seriescope.sources import cache

    m = spark.createDataFrame([("d", "a", True, 1, 5, None), ("e", "b", True, 1, 5, None)], cache.MANIFEST)
    cache.write_stage(m, str(tmp_path), "manifest")
    plan = cache.load_stage(spark, str(tmp_path), "manifest", "d", "a")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*dataset", plan) and re.search(r"PushedFilters: \[[^\]]*signal_id", plan)
