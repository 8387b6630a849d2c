"""Counts of overlaps by running counts, against all pairs; intervals of several alphas in one pass."""

import random

from pyspark.sql import functions as F

from seriescope.operators import metrics
from seriescope.operators.decision import alpha_intervals, threshold_flags
from seriescope.operators.intervals import intervals_of

SCHEMA = "dataset string, signal_id string, start_idx long, end_idx long"


def brute(groups, truth, found):
    out = {}
    for g in groups:
        t, f = [x[2:] for x in truth if x[:2] == g], [x[2:] for x in found if x[:2] == g]

        def meets(a, b):
            sound = None not in (*a, *b) and a[0] <= a[1] and b[0] <= b[1]
            return sound and a[0] <= b[1] and b[0] <= a[1]

        tp = sum(meets(a, b) for a in f for b in t)
        out[g] = (len(t), len(f), tp, sum(not any(meets(a, b) for b in t) for a in f), sum(not any(meets(a, b) for b in f) for a in t))
    return out


def test_overlap_counts_equal_those_of_pairs(spark):
    rnd = random.Random(5)
    groups = [("d", s) for s in "abcde"]

    def some(n, names):
        rows = []
        for _ in range(n):
            start = rnd.randrange(200)
            rows.append(("d", rnd.choice(names), start, start + rnd.randrange(-2, 25)))
        return rows

    truth = [*some(60, "abc"), ("d", "a", 7, None), ("d", "z", 1, 2), ("d", None, 1, 2)]
    found = [*some(80, "abd"), ("d", "b", None, 9), ("d", "z", 1, 2)]
    found += found[:10]
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in (truth, found)]
    asked = spark.createDataFrame([*groups, groups[0]], "dataset string, signal_id string")
    for stretch in (1, 16, 65_536):
        got = {(r.dataset, r.signal_id): (r.n_gt, r.n_detected, r.tp, r.fp, r.fn) for r in metrics.overlap_counts(asked, *frames, stretch=stretch).collect()}
        assert got == brute(groups, truth, found)


def test_many_intervals_of_one_signal_make_no_pairs(spark):
    """300,000 detections that all lie in 1000 truths: 300 million pairs are counted, none is made."""
    key = [F.lit("d").alias("dataset"), F.lit("s").alias("signal_id")]
    truth = spark.range(1000).select(*key, F.col("id").alias("start_idx"), (F.col("id") + 1_000_000).alias("end_idx"))
    found = spark.range(300_000).select(*key, (F.col("id") + 2000).alias("start_idx"), (F.col("id") + 2003).alias("end_idx"))
    r = metrics.overlap_counts(truth.select("dataset", "signal_id").distinct(), truth, found).first()
    assert (r.n_gt, r.n_detected, r.tp, r.fp, r.fn) == (1000, 300_000, 300_000_000, 0, 0)


def test_no_interval_and_no_group(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([("d", "a")], "dataset string, signal_id string")
    assert [tuple(r)[2:] for r in metrics.overlap_counts(one, none, none).collect()] == [(0, 0, 0, 0, 0)]
    assert metrics.overlap_counts(one.limit(0), none, none).count() == 0


def test_intervals_of_alphas_equal_those_of_each(spark):
    rnd = random.Random(2)
    rows = [("d", s, i, rnd.gauss(0, 1) if i % 50 else None) for s in "ab" for i in range(900)] + [("d", "flat", i, 1.0) for i in range(20)]
    points = spark.createDataFrame(rows, "dataset string, signal_id string, idx long, score double")
    alphas = [0.1, 0.01, 0.001]
    got = {tuple(r) for r in alpha_intervals(points, alphas).select("signal_id", "alpha", "start_idx", "end_idx").collect()}
    want = {(r.signal_id, a, r.start_idx, r.end_idx) for a in alphas for r in intervals_of(threshold_flags(points, a), F.col("flag")).collect()}
    assert got == want and got
