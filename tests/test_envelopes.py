"""Envelopes of spans from one tree, against those of the spans taken as signals of their own."""

import random

from pyspark.sql import functions as F

from seriescope.operators import evidence


def brute(values, start, end, columns):
    n, out = end - start + 1, set()

    def fine(i):
        return values[i] is not None and abs(values[i]) != float("inf") and values[i] == values[i]

    if n <= columns:
        return {(i, values[i], 0) for i in range(start, end + 1) if fine(i)}
    for b in range(columns):
        cell = [i for i in range(start + b * n // columns, start + (b + 1) * n // columns) if fine(i)]
        if cell:
            out |= {(i, values[i], 1) for i in (min(cell, key=lambda i: (values[i], i)), min(cell, key=lambda i: (-values[i], i)))}
    return out


def test_spans_of_any_width_equal_brute_force(spark):
    rnd = random.Random(11)
    odd = [None, float("nan"), float("inf"), -float("inf")]
    signals = {s: [rnd.choice(odd) if rnd.random() < 0.1 else float(rnd.randrange(6)) for _ in range(n)] for s, n in (("a", 700), ("b", 45), ("c", 1))}
    signals["c"] = [None]
    points = spark.createDataFrame([("d", s, i, v) for s, vs in signals.items() for i, v in enumerate(vs)], "dataset string, signal_id string, idx long, value double")
    spans = []
    for k in range(60):
        s = rnd.choice("aab")
        start = rnd.randrange(len(signals[s]))
        spans.append(("d", s, k, start, rnd.randrange(start, len(signals[s]))))
    spans += [("d", "c", 60, 0, 0), ("d", "a", 61, 5, 4), ("d", "z", 62, 0, 9), ("d", "a", 63, 0, None)]
    requests = spark.createDataFrame(spans, "dataset string, signal_id string, rid long, start_idx long, end_idx long")
    tree = evidence.extremes_tree(points, block=8, fan=3)
    for columns in (1, 7, 100):
        got = {}
        for r in evidence.envelopes(tree, requests, columns).collect():
            got.setdefault(r.rid, set()).add((r.idx, r.value, r.extreme))
        want = {rid: brute(signals[s], a, b, columns) for _, s, rid, a, b in spans[:61]}
        assert got == {rid: rows for rid, rows in want.items() if rows}


def test_whole_signal_equals_the_direct_envelope(spark):
    points = spark.range(5000).select(F.lit("d").alias("dataset"), F.lit("s").alias("signal_id"), F.col("id").alias("idx"), (F.col("id") * 7919 % 1009).cast("double").alias("value"))
    whole = points.groupBy("dataset", "signal_id").agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"))
    found = evidence.envelopes(evidence.extremes_tree(points), whole, 90).select("idx", "value", "extreme")
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in evidence.envelope(points, 90).select("idx", "value", "extreme").collect()}


def test_a_plot_reads_the_written_tree_and_not_the_points(spark, tmp_path):
    path = str(tmp_path / "points")
    spark.range(3000).select(F.lit("d").alias("dataset"), F.lit("s").alias("signal_id"), F.col("id").alias("idx"), F.col("id").cast("double").alias("value")).write.parquet(path)
    tree = evidence.extremes_tree(spark.read.parquet(path))
    asked = spark.createDataFrame([("d", "s", 10, 2900)], "dataset string, signal_id string, start_idx long, end_idx long")
    plan = evidence.envelopes(tree, asked, 50)._jdf.queryExecution().toString()
    assert "parquet" not in plan.lower() and "Scan ExistingRDD" in plan
