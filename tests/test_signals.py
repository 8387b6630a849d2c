"""Cleaning, windows, decisions and intervals on small cases worked out by hand."""

import json
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriescope.operators import clean, decision, intervals, windows
from seriescope.sources.config import parse_config, read_config
from seriescope.sources.signals import normalise, resolve_columns, select_files


def signal(spark, values, name="s"):
    return spark.createDataFrame([("d", name, i, None if v is None else float(v)) for i, v in enumerate(values)], "dataset string, signal_id string, idx long, value double")


def by_idx(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.orderBy("idx").collect()]


def test_gaps_are_filled_on_a_line(spark):
    got = by_idx(clean.interpolate(signal(spark, [None, 1, None, 3, None, None])), "value")
    assert got == [1, 1, 2, 3, 3, 3]
    assert by_idx(clean.interpolate(signal(spark, [None, None])), "value") == [None, None]


def test_numbers_and_labels(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("Infinity",), (None,), ("-3",), ("2.7",)], "s string")
    got = [(r.v, r.l) for r in df.select(clean.to_number(F.col("s")).alias("v"), clean.clip_label(F.col("s")).alias("l")).collect()]
    assert got == [(1.5, 1), (None, 0), (None, 0), (None, 0), (None, 0), (-3.0, 0), (2.7, 1)]


def test_constant_signal_scales_to_zero(spark):
    assert by_idx(clean.minmax(signal(spark, [4, 4, 4])), "value") == [0, 0, 0]
    assert np.allclose(by_idx(clean.detrend(signal(spark, [1, 3, 5, 7])), "value"), 0)
    assert np.allclose(by_idx(clean.detrend(signal(spark, [5])), "value"), 0)


def test_area_resample(spark):
    flat = clean.area_resample(signal(spark, [7.0] * 448)).orderBy("bin").collect()
    assert [r.value for r in flat] == [7.0] * 224
    ramp = clean.area_resample(signal(spark, range(448))).orderBy("bin").collect()
    assert [r.value for r in ramp] == [0.5 + 2 * i for i in range(224)]
    odd = [r.value for r in clean.area_resample(signal(spark, [0, 3, 6]), 2).orderBy("bin").collect()]
    assert np.allclose(odd, [1.0, 5.0])
    with pytest.raises(Exception, match="finite"):
        clean.area_resample(signal(spark, [1, float("nan")])).collect()
    with pytest.raises(ValueError):
        clean.area_resample(signal(spark, [1]), 0)


def test_window_starts_drop_the_tail(spark):
    n = spark.createDataFrame([("d", "a", 850), ("d", "b", 100)], "dataset string, signal_id string, n long")
    got = windows.window_starts(n).groupBy("signal_id", "scale").agg(F.count("*").alias("c"), F.max("start_idx").alias("m")).collect()
    assert {(r.signal_id, r.scale): (r.c, r.m) for r in got} == {("a", 224): (12, 616), ("a", 448): (4, 336), ("a", 672): (2, 168)}
    w = windows.sliding_windows(signal(spark, range(10)), [4]).orderBy("window_id").collect()
    assert [r.vals for r in w] == [[float(i + j) for j in range(4)] for i in range(7)]


def test_long_windows_own_candidates_once():
    plan = windows.plan_windows(25_000, [[100, 200], [22_000, 22_100]])
    assert len(plan) == 2
    assert [w["candidates"] for w in plan] == [[1], [2]]
    assert plan[0]["core_end"] == plan[1]["core_start"]
    one = windows.plan_windows(200, [[1, 2]])
    assert one == [{"window": 1, "start": 0, "end": 199, "core_start": 0, "core_end": 199, "candidates": []}]
    moved = windows.plan_windows(50_000, [[19_500, 20_500]])
    assert all(not 19_500 <= w["core_end"] <= 20_500 for w in moved)
    with pytest.raises(ValueError):
        windows.plan_windows(30_000, [], 20_000, 0)


def reference_z(x):
    med = np.median(x)
    mad = np.median(np.abs(x - med))
    if mad < 1e-12:
        return np.zeros_like(x) if x.std() < 1e-12 else np.maximum((x - med) / (x.std() + 1e-12), 0)
    return np.maximum((x - med) / (1.4826 * mad + 1e-12), 0)


@pytest.mark.parametrize("values", [[1.0, 2, 3, 10, 4], [0.0, 0, 0, 0, 5], [2.0, 2, 2], [float("nan"), 1, 2, 5]])
def test_robust_z(spark, values):
    got = by_idx(decision.robust_positive_z(signal(spark, values), "value"), "value")
    assert np.allclose(got, reference_z(np.nan_to_num(np.array(values, float))))


@pytest.mark.parametrize("n", [5, 150, 250, 1234])
def test_smoothing_equals_pandas(spark, n):
    x = np.abs(np.sin(np.arange(n) * 0.7)) * 3
    got = by_idx(decision.ewma(signal(spark, x), "value"), "value")
    want = pd.Series(x).ewm(span=max(1, int(n * 0.01))).mean()
    assert np.allclose(got, want)


def test_sliding_threshold(spark):
    x = np.abs(np.sin(np.arange(97) * 1.3)) + (np.arange(97) == 50) * 5
    n, win, step, flags = len(x), 97 // 3, 97 // 10, np.zeros(97, bool)
    for s in range(0, n, step):
        part = x[s : s + win]
        flags[s : s + win] |= part > part.mean() + NormalDist().inv_cdf(0.99) * part.std()
    assert by_idx(decision.sliding_flags(signal(spark, x), 0.01, score="value"), "flag") == flags.tolist()


def test_decide_pads_and_merges(spark):
    values = [0.0] * 40
    values[10] = values[13] = 9.0
    points, found = decision.decide(signal(spark, values), 0.1, smoothing=False, padding=1, score="value")
    assert [(r.start_idx, r.end_idx) for r in found.collect()] == [(9, 14)]
    assert points.where("flag").count() == 2
    with pytest.raises(ValueError):
        decision.gaussian_factor(1.0)
    with pytest.raises(ValueError):
        decision.threshold_flags(points, 0.1, "mode")


def test_fusion_needs_all_scales(spark):
    rows = [("d", "s", 224, i, v) for i, v in enumerate([0.0, 1.0, 2.0, 0.0])] + [("d", "s", 448, i, v) for i, v in enumerate([0.0, 2.0, 1.0, 0.0])] + [("d", "s", 672, i, v) for i, v in enumerate([0.0, 0.5, 1.5, 0.0])]
    df = spark.createDataFrame(rows, "dataset string, signal_id string, scale int, idx long, score double")
    got = by_idx(decision.fuse_scales(df), "score")
    parts = [reference_z(np.array(x, float)) for x in ([0, 1, 2, 0], [0, 2, 1, 0], [0, 0.5, 1.5, 0])]
    assert np.allclose(got, np.mean(parts, axis=0))
    with pytest.raises(Exception, match="lacks a scale"):
        decision.fuse_scales(df.where("not (scale = 448 and idx = 2)")).collect()
    with pytest.raises(ValueError):
        decision.fuse_scales(df, [0, 0, 0])


def test_merging_touches_at_one(spark):
    df = spark.createDataFrame([("d", "s", 1, 3), ("d", "s", 4, 5), ("d", "s", 7, 9), ("d", "s", 2, 2)], "dataset string, signal_id string, start_idx long, end_idx long")
    got = sorted((r.start_idx, r.end_idx) for r in intervals.merge_intervals(df).collect())
    assert got == [(1, 5), (7, 9)]


def test_bounds_are_clipped_and_swapped(spark):
    pts = signal(spark, [1, 2, 3, 4]).withColumn("ts", F.col("idx") * 10)
    iv = spark.createDataFrame([("d", "s", 9, 2)], "dataset string, signal_id string, start_idx long, end_idx long")
    r = intervals.interval_bounds(pts, iv, score="value").first()
    assert (r.start_idx, r.end_idx, r.start_ts, r.end_ts, r.severity) == (2, 3, 20, 30, 3.5)


def test_long_interval_over_buckets(spark):
    pts = signal(spark, range(300))
    iv = spark.createDataFrame([("d", "s", 5, 280), ("d", "s", 270, 290)], "dataset string, signal_id string, start_idx long, end_idx long")
    assert intervals.points_in(pts, iv, ["dataset", "signal_id"], bucket=16).count() == 276 + 21
    assert intervals.flags_of(pts, iv).where("flag = 1").count() == 286


def test_columns_by_name():
    f = lambda *names: T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    assert resolve_columns(f("Time", "KPI", "is_anomaly")) == ("Time", "KPI", "is_anomaly")
    assert resolve_columns(f("metric", "value")) == (None, "value", None)
    assert resolve_columns(f("label", "x7")) == (None, "x7", "label")
    with pytest.raises(ValueError):
        resolve_columns(T.StructType([T.StructField("a", T.StringType())]))


def test_normalise(spark):
    raw = spark.createDataFrame([("d", "s", 3, "x", 0), ("d", "s", 1, "1.0", 1), ("d", "s", 2, "2.0", 5)], "dataset string, signal_id string, timestamp int, value string, label int")
    assert [(r.idx, r.ts, r.value, r.label) for r in normalise(raw).orderBy("idx").collect()] == [(0, 1, 1.0, 1), (1, 2, 2.0, 1), (2, 3, 2.0, 0)]
    empty = normalise(raw.limit(0))
    assert empty.count() == 0


def test_file_selection(spark):
    files = spark.createDataFrame([("b.csv",), ("a_1.csv",), ("a.csv",), ("x.txt",), ("za.csv",)], "name string")
    got = [r["name"] for r in select_files(files, ["b", "a"], 3).orderBy("position").collect()]
    assert got == ["b.csv", "a.csv", "a_1.csv"]
    assert select_files(files).count() == 4


def test_config(tmp_path):
    nested = {"scales": [224, 448], "windowing": {"step_ratio": 4.0}, "reference_selection": {"top_k": 8}, "scale_fusion": {"weights": {"224": 0.5, "448": 0.5}}, "decision": {"alpha_candidates": [0.1], "method": "median"}}
    (tmp_path / "c.json").write_text(json.dumps(nested))
    c = read_config(str(tmp_path / "c.json"))
    assert (c.scales, c.top_k, c.retained, c.weights, c.method) == ((224, 448), 8, 4, {224: 0.5, 448: 0.5}, "median")
    for bad in ({"scales": []}, {"scales": [1, 1]}, {"decision": {"alpha_candidates": [2]}}, {"scales": [1], "scale_fusion": {"weights": {"1": 0}}}, {"retrieval_mode": "other"}, {"decision": {"method": "mode"}}):
        with pytest.raises(ValueError):
            parse_config(bad)


def test_empty_tables(spark):
    none = signal(spark, [])
    assert decision.robust_positive_z(none, "value").count() == 0
    assert decision.decide(none, 0.1, score="value")[1].count() == 0
    assert windows.sliding_windows(none).count() == 0
    assert clean.area_resample(none).count() == 0
    assert math.isclose(decision.gaussian_factor(0.01), 2.3263478740408408)


def test_spread_numbering_and_stretches(spark):
    from seriescope.operators.common import running_sums

    df = spark.createDataFrame([("d", "a", (i * 37) % 101, i) for i in range(101)] + [("d", "b", 5, 1), ("d", "b", 5, 0)], "dataset string, signal_id string, ts int, tie int")
    one = sorted((r.signal_id, r.ts, r.tie, r.idx) for r in clean.time_index(df, "ts", "tie").collect())
    assert one == sorted((r.signal_id, r.ts, r.tie, r.idx) for r in clean.time_index(df, "ts", "tie", spread=True).collect())
    got = running_sums(signal(spark, range(50)), {"so_far": F.col("value")}, stretch=7)
    assert by_idx(got, "so_far") == [sum(range(i + 1)) for i in range(50)]


def test_long_signals_by_stretches(spark):
    """Operators that go along a signal give the same whatever the stretch, across its edges."""
    from seriescope.operators import clean, common, metrics

    rng = np.random.default_rng(31)
    n = 200
    values = [None if rng.random() < 0.5 else float(round(v, 3)) for v in rng.normal(size=n)]
    rows = [("d", s, i, v) for s, vs in (("a", values), ("none", [None] * 40), ("b", [None] * 70 + [2.0] + [None] * 70)) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "dataset string, signal_id string, idx long, value double")
    for stretch in (7, 64, common.STRETCH):
        got = clean.interpolate(df, stretch=stretch).orderBy("signal_id", "idx").toPandas()
        a = got[got.signal_id == "a"].value.to_numpy()
        known = [i for i, v in enumerate(values) if v is not None]
        assert np.allclose(a, np.interp(range(n), known, [values[i] for i in known]))
        assert got[got.signal_id == "none"].value.isna().all() and (got[got.signal_id == "b"].value == 2.0).all()
        nxt = common.with_next(df, "value", "next", stretch=stretch).where("signal_id = 'a'").orderBy("idx").toPandas()
        want = [*values[1:], None]
        assert [None if x != x else x for x in nxt.next] == want
    timed = df.select("dataset", "signal_id", (F.col("idx") * 7 % 200).alias("t"), F.col("idx").alias("tie"))
    one = clean.time_index(timed, "t", "tie").orderBy("signal_id", "idx").collect()
    two = clean.time_index(timed, "t", "tie", part=F.floor(F.col("t") / 30)).orderBy("signal_id", "idx").select(*timed.columns, "idx").collect()
    assert one == two
    scores = rng.integers(0, 60, 500) / 10
    labels = (rng.random(500) < scores / 8).astype(int)
    pts = spark.createDataFrame([("d", "a", float(s), int(y)) for s, y in zip(scores, labels, strict=True)] + [("d", "same", 1.0, 1), ("d", "same", 1.0, 0)], "dataset string, signal_id string, score double, label int")
    curve = metrics._curve(pts, "label", "score", ["dataset", "signal_id"]).where("signal_id = 'a'").collect()
    assert len(curve) == len(set(scores))
    for r in curve:
        assert (r.tp, r["all"], r.positives) == (int(labels[scores >= r.score].sum()), int((scores >= r.score).sum()), int(labels.sum()))


def test_long_signals_have_no_task_or_row_of_their_own(spark):
    """Windows of these plans are of stretches as well as of signals, and no array is as long as a signal."""
    import re

    from seriescope.operators import clean, evidence, maps, metrics

    d = spark.createDataFrame([("d", "a", 0, 1.0, 0.5, 1)], "dataset string, signal_id string, idx long, value double, score double, label int")
    requests = spark.createDataFrame([("d", "a", 0, 1)], "dataset string, signal_id string, start_idx long, end_idx long")
    for df in (clean.interpolate(d), clean.time_index(d.drop("idx"), "score", part=F.floor("score")), evidence.difference_zscores(d, requests), metrics.point_f1max(d), metrics.average_precision(d)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" in plan
        for spec in re.findall(r"windowspecdefinition\(([^)]*)", plan):
            # Those of signals alone run over sums of stretches.
            assert re.search(r"__[kp]#", spec), spec
    shape = spark.createDataFrame([("d", "a", 150_000, 100_000, 1, 1)], "dataset string, signal_id string, n long, size long, step long, windows long")
    stitched = spark.range(50).select(F.lit("d").alias("dataset"), F.lit("a").alias("signal_id"), F.col("id").alias("pos"), F.col("id").cast("double").alias("score"))
    out = maps.align(stitched, shape)
    assert out.count() == 150_000
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_hooks_annotations_and_files(spark, tmp_path):
    from seriescope.operators import metrics
    from seriescope.sources import cache, signals

    keys = "dataset string, signal_id string, start_idx long, end_idx long"
    roster = spark.createDataFrame([("d", "a"), ("d", "b")], "dataset string, signal_id string")
    truth = spark.createDataFrame([("d", "a", 1, 5), ("d", "b", 2, 3)], keys)
    found = spark.createDataFrame([("d", "a", 0.1, 1, 5), ("d", "a", 0.1, 9, 9), ("d", "b", 0.01, 7, 8)], "dataset string, signal_id string, alpha double, start_idx long, end_idx long")

    def covered(groups, truth, detected, keys):
        return detected.groupBy(*keys).agg(F.sum(F.col("end_idx") - F.col("start_idx") + 1).alias("value"))

    rows = {(r.signal_id, r.alpha): r for r in metrics.per_alpha(roster, truth, found, [0.1, 0.01], {"vus_pr": covered, "length": covered}).collect()}
    assert rows["a", 0.1].vus_pr == rows["a", 0.1].length == 6.0 and rows["b", 0.01].length == 2.0
    assert rows["a", 0.01].length is None and rows["a", 0.1].affiliation_f1 is None and len(rows) == 4
    assert metrics.per_alpha(roster, truth, found, [0.1]).select(*metrics.HOOKS).distinct().collect() == [(None, None, None)]

    noted = spark.createDataFrame([("json", "[[1, 2], [3, 4.5]]", 1), ("tuples", "[(1, 2), (3, 4.5),]", 1), ("mixed", "([1, 2], (3, 4.5))", 1), ("bad", "{1: 2}", 1), ("null", None, 1), ("empty", "[]", 1)], "signal string, anomalies string, row_order int")
    got = signals.parse_annotations(noted).orderBy("signal_id", "start_value").collect()
    assert [tuple(r) for r in got] == [(s, *p) for s in ("json", "mixed", "tuples") for p in ((1.0, 2.0), (3.0, 4.5))]

    per_alpha = metrics.per_alpha(roster, truth, found, [0.1, 0.01]).select("dataset", "signal_id", "alpha", "f1")
    cache.write_per_alpha(per_alpha, str(tmp_path), "metrics")
    assert sorted(x.parent.name for x in (tmp_path / "metrics").rglob("*.json")) == ["alpha_dir=0.01"] * 2 + ["alpha_dir=0.1"] * 2
    points = spark.range(3 * cache.ROWS, step=cache.ROWS // 2).select(F.lit("d").alias("dataset"), F.lit("a").alias("signal_id"), F.col("id").alias("idx"))
    cache.write_stage(points, str(tmp_path), "points")
    assert spark.read.parquet(str(tmp_path / "points")).count() == 6
