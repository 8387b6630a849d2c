"""Retrieval by pivots equals the comparison of all blocks, and leaves most of its pairs out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriescope.functions.numeric import unit
from seriescope.operators import pruned, retrieval

SCHEMA = "signal_id string, window_id long, start_idx long, vec array<double>"


def clustered(spark, n=1200, clusters=12, seed=3, spread=0.05):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(clusters, 16))
    vectors = centres[rnd.integers(clusters, size=n)] + spread * rnd.normal(size=(n, 16))
    vectors[5:9] = vectors[5]
    rows = [("a" if i % 3 else "b", i, i * 56, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted((r.signal_id, r.query_id, r.rank, r.ref_id, round(r.sim, 9)) for r in df.collect())


@pytest.mark.parametrize(("policy", "gap"), [("non_overlap", 0), ("self_only", 0), ("past_only_non_overlap", 3)])
def test_equal_to_all_pairs(spark, policy, gap):
    w = clustered(spark)
    got = pruned.nearest_references(w, 224, 5, policy, gap, by=["signal_id"], block=64, pivots=24)
    assert rows_of(got) == rows_of(retrieval.top_references(w, 224, 5, policy, gap, by=["signal_id"]))


def test_zero_vectors_short_signals_and_more_wanted_than_there_are(spark):
    zero, one = [0.0] * 4, [1.0, 0.0, 0.0, 0.0]
    rows = [("z", i, i * 224, zero) for i in range(6)] + [("m", i, i * 224, zero if i % 2 else [float(i), 1.0, 0.0, 0.0]) for i in range(20)] + [("s", 0, 0, one)]
    w = spark.createDataFrame(rows, SCHEMA)
    got = pruned.nearest_references(w, 224, 40, by=["signal_id"], block=2)
    assert rows_of(got) == rows_of(retrieval.top_references(w, 224, 40, by=["signal_id"]))
    assert pruned.nearest_references(w.limit(0), 224, 4, by=["signal_id"]).count() == 0


def test_clusters_leave_fewer_than_half_of_the_pairs(spark):
    w = clustered(spark)
    base = w.select("signal_id", "window_id", "start_idx", unit(F.col("vec")).alias("vec"))
    rows, parts = pruned.pivot_blocks(base, ["signal_id"], 24, 64)
    pairs = pruned.part_pairs(parts, ["signal_id"])
    found = retrieval.top_references(w, 224, 5, by=["signal_id"])
    late = pruned.late_pairs(pairs, parts, rows, found, ["signal_id"], 5)
    assert 2 * (late.count() + pairs.where("early").count()) < pairs.count()
    assert rows.count() == 1200 and parts.agg(F.sum("size")).first()[0] == 1200
