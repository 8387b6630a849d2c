"""Structures that keep long signals out of single tasks: cells, order statistics, scans, parts, files."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriescope.operators import decision, metrics, protocol
from seriescope.operators.dyadic import overlapping
from seriescope.operators.intervals import merge_intervals
from seriescope.operators.quantiles import order_statistics
from seriescope.sources import signals

KEYS = "dataset string, signal_id string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def random_spans(rng, n, size, longest):
    start = rng.integers(0, size, n)
    return [(int(a), int(a + b)) for a, b in zip(start, rng.integers(0, longest, n) ** rng.integers(1, 3, n), strict=True)]


@pytest.mark.parametrize("seed,longest", [(1, 3), (2, 40), (3, 1)])
def test_overlaps_by_cells_equal_all_pairs(spark, seed, longest):
    rng = np.random.default_rng(seed)
    bank, asked = random_spans(rng, 120, 300, longest), [*random_spans(rng, 120, 300, 40), (-3, 2), (5, 5), (9, 8), (0, 4000)]
    b = spark.createDataFrame([("d", "ab"[i % 2], i, *x) for i, x in enumerate([*bank, (-5, -4), (7, 6)])], KEYS + ", seq long, start_idx long, end_idx long")
    q = spark.createDataFrame([("d", "ab"[i % 2], i, *x) for i, x in enumerate(asked)], KEYS + ", qid long, start_idx long, end_idx long")
    got = overlapping(q, b, ["dataset", "signal_id"], {"low": (F.col("seq"), F.min), "high": (F.col("seq"), F.max)})
    all_ = [*bank, (-5, -4), (7, 6)]
    for r in got.collect():
        (s, e), g = asked[r.qid], r.qid % 2
        hits = [i for i, (x, y) in enumerate(all_) if i % 2 == g and x <= y and s <= e and x <= e and s <= y]
        assert (r.low, r.high) == ((min(hits), max(hits)) if hits else (None, None)), (s, e)
    assert got.count() == len(asked)


def test_conflicts_and_support_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    spans = random_spans(rng, 150, 2000, 20)
    add = spark.createDataFrame([("d", "s", i, *x) for i, x in enumerate(spans)], KEYS + ", seq long, final_start long, final_end long")
    taken = random_spans(rng, 10, 2000, 20)
    occupied = spark.createDataFrame([("d", "s", *x) for x in taken], KEYS + ", start_idx long, end_idx long")
    got = {r.seq for r in protocol.conflicting_additions(add, occupied).collect()}
    touch = lambda a, b: a[0] <= b[1] and b[0] <= a[1]
    assert got == {i for i, x in enumerate(spans) if any(touch(x, y) for y in taken) or any(touch(x, y) for y in spans[:i])}
    families = ["visual", "raw_numeric", "statistical", "reference"]
    e = [("d", "s", families[int(rng.integers(4))], "ok" if rng.random() < 0.9 else "error", *x) for x in random_spans(rng, 300, 2000, 12)]
    evidence = spark.createDataFrame(e, KEYS + ", family string, status string, focus_start long, focus_end long")
    rec = [("d", "s", f"r{i}", ["keep", "refine", "remove"][i % 3], a, b, None if i % 3 == 2 else a - i % 4, None if i % 3 == 2 else b + i % 5) for i, (a, b) in enumerate(spans)]
    records = spark.createDataFrame(rec, KEYS + ", record_key string, action string, reviewed_start long, reviewed_end long, final_start long, final_end long")
    got = {r.record_key: r.supported for r in protocol.evidence_support(records, evidence).collect()}
    for _, _, key, action, a, b, fs, fe in rec:
        near = [x for x in e if x[3] == "ok" and (touch((a, b), x[4:]) or (fs is not None and touch((fs, fe), x[4:])))]
        ok = len({x[2] for x in near}) >= 2 and any(x[2] in protocol.HARD_FAMILIES for x in near)
        if action == "refine":
            ok = ok and any(x[4] <= fs <= x[5] for x in near) and any(x[4] <= fe <= x[5] for x in near)
        assert got[key] == ok, key


def test_one_signal_with_many_records(spark):
    """200,000 additions of one signal, half of which lie on an earlier one: no pairs, cells as join keys."""
    n = 200_000
    adds = spark.range(n).select(F.lit("d").alias("dataset"), F.lit("s").alias("signal_id"), F.col("id").alias("seq"), (F.floor(F.col("id") / 2) * 100).alias("final_start"), (F.floor(F.col("id") / 2) * 100 + 50).alias("final_end"))
    none = adds.limit(0).select("dataset", "signal_id", F.col("final_start").alias("start_idx"), F.col("final_end").alias("end_idx"))
    found = protocol.conflicting_additions(adds, none)
    assert found.agg(F.count("*"), F.sum(F.col("seq") % 2)).first()[:] == (n // 2, n // 2)
    plan = plan_of(found)
    assert "__cell" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_order_statistics_equal_the_built_in(spark):
    """Ties, infinities, NaN, nulls, even and odd counts; narrowed from 2 values on."""
    rng = np.random.default_rng(6)
    values = {
        "one": [3.5], "two": [1.0, 2.0], "ties": [1.0] * 50 + [2.0] * 49, "odd": rng.normal(size=301).tolist(), "even": rng.normal(size=300).tolist(),
        "tail": (10.0 ** rng.uniform(-300, 300, 400)).tolist(), "inf": [float("inf")] * 30 + [float("-inf")] * 20 + [0.0, -0.0] * 5, "nan": [float("nan")] * 20 + [1.0, 2.0] * 15, None: [1.0, 4.0, 2.0],
    }
    df = spark.createDataFrame([(k, v) for k, x in values.items() for v in x] + [("one", None), ("nothing", None)], "k string, v double").cache()
    shares = [0.0, 0.05, 0.25, 0.5, 0.77, 0.95, 1.0]
    want = {r.k: r.q for r in df.where("v is not null").groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    disc = {r.k: [r[f"d{i}"] for i in range(len(shares))] for r in df.where("v is not null").groupBy("k").agg(*[F.expr(f"percentile_disc({s}) within group (order by v)").alias(f"d{i}") for i, s in enumerate(shares)]).collect()}
    for limit in (2, 60, 10_000):
        for discrete, right in ((False, want), (True, disc)):
            got = {r.k: r.q for r in order_statistics(df, F.col("v"), shares, ["k"], "q", discrete, limit, 8).collect()}
            assert set(got) == set(right)
            for k in right:
                assert all(a == b or (math.isnan(a) and math.isnan(b)) for a, b in zip(got[k], right[k], strict=True)), (k, limit, discrete)
    whole = order_statistics(df.where("k = 'odd'"), F.col("v"), [0.5], [], "q", limit=20).collect()
    assert whole[0].q == [want["odd"][3]]
    assert order_statistics(df.limit(0), F.col("v"), [0.5], ["k"], "q").count() == 0


def test_robust_z_of_a_long_signal_has_no_growing_buffer(spark, monkeypatch):
    from seriescope.operators import quantiles

    df = spark.createDataFrame([("d", "s", i, float(i * i % 97)) for i in range(500)], KEYS + ", idx long, score double")
    want = [r.score for r in decision.robust_positive_z(df).orderBy("idx").collect()]
    kept, plans = quantiles._at_ranks, []
    monkeypatch.setattr(quantiles.order_statistics, "__defaults__", (False, 32, 8))
    monkeypatch.setattr(quantiles, "_at_ranks", lambda *a: plans.append(plan_of(out := kept(*a))) or out)
    got = decision.robust_positive_z(df)
    assert [r.score for r in got.orderBy("idx").collect()] == want
    assert len(plans) == 2 and not any("percentile(" in p for p in [*plans, plan_of(got)])


def test_merging_carries_ends_over_stretches(spark):
    rng = np.random.default_rng(8)
    spans = [*random_spans(rng, 400, 3000, 6), (10, 2500), (40, 41)]
    df = spark.createDataFrame([("d", "ab"[i % 2] if i % 5 else None, *x) for i, x in enumerate(spans)], KEYS + ", start_idx long, end_idx long")
    for gap in (1, 0, 7):
        want = []
        for g in ("a", "b", None):
            mine = sorted((r.start_idx, r.end_idx) for r in df.collect() if r.signal_id == g)
            merged = []
            for s, e in mine:
                if merged and s <= merged[-1][1] + gap:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            want += [(g, *m) for m in merged]
        got = merge_intervals(df, None, gap=gap, stretch=64)
        assert sorted(((r.signal_id, r.start_idx, r.end_idx) for r in got.collect()), key=str) == sorted(want, key=str)
    assert "__k" in plan_of(merge_intervals(df, None)).split("Window")[1]


def test_curves_of_skewed_scores(spark):
    """One score of 1e12 beside many small ones: exact, and no part with over a few percent of them."""
    rng = np.random.default_rng(9)
    score = np.round(rng.exponential(1.0, 20_000), 4)
    score[0] = 1e12
    label = (rng.random(20_000) < 0.1 + 0.2 * (score > 1)).astype(int)
    df = spark.createDataFrame([("d", "s", float(s), int(y)) for s, y in zip(score, label, strict=True)], KEYS + ", score double, label int")
    order = np.argsort(-score, kind="stable")
    tp, n = np.cumsum(label[order]), np.arange(1, len(score) + 1)
    last = np.append(np.diff(score[order]) != 0, True)
    precision, recall = (tp / n)[last], (tp / tp[-1])[last]
    gain = np.diff(recall, prepend=0)
    assert math.isclose(metrics.average_precision(df).first().auprc, float((gain * precision).sum()), rel_tol=1e-9)
    assert math.isclose(metrics.point_f1max(df).first().f1max, float((2 * precision * recall / (precision + recall + 1e-12)).max()), rel_tol=1e-9)
    seen = []
    real = metrics.running_sums
    metrics.running_sums = lambda d, *a, part=None, **k: seen.append(d.groupBy(part.alias("p")).count()) or real(d, *a, part=part, **k)
    try:
        metrics.average_precision(df)
    finally:
        metrics.running_sums = real
    sizes = [r["count"] for r in seen[0].collect()]
    assert max(sizes) < 0.03 * sum(sizes)


def test_files_have_columns_of_their_own(spark, tmp_path):
    d = tmp_path / "sig"
    d.mkdir()
    (d / "a.csv").write_text("timestamp,value,label\n10,1.5,0\n9,2.5,1\n")
    (d / "c+d.csv").write_text("value,timestamp\n5,100\n6,20\n")
    (d / "50% e f.csv").write_text('Label, Time ,"KPI"\n1,2024-01-02,"7"\n0,2024-01-01,\n')
    (d / "numbers.csv").write_text("date,name,reading,more\n1,x,3,4\n2,y,4,5\n\n")
    (d / "plain.csv").write_text("y\n3\n1\n")
    rows = signals.read_signal_files(spark, str(d), "d")
    got = sorted((r.signal_id, r.timestamp, r.value, r.label) for r in rows.where("signal_id <> 'plain'").collect())
    assert got == sorted([("a", "10", "1.5", "0"), ("a", "9", "2.5", "1"), ("c+d", "100", "5", None), ("c+d", "20", "6", None), ("50% e f", "2024-01-02", "7", "1"), ("50% e f", "2024-01-01", None, "0"), ("numbers", "1", "3", None), ("numbers", "2", "4", None)], key=lambda x: (x[0], x[1]))
    assert [r.value for r in rows.where("signal_id = 'plain'").orderBy("row_order").collect()] == ["3", "1"]
    made = signals.normalise(rows.where("signal_id <> 'plain'"), "row_order")
    assert [(r.signal_id, r.value) for r in made.orderBy("signal_id", "idx").collect()] == [("50% e f", 7.0), ("50% e f", 7.0), ("a", 2.5), ("a", 1.5), ("c+d", 6.0), ("c+d", 5.0), ("numbers", 3.0), ("numbers", 4.0)]
    (d / "none.csv").write_text("time,name\n1,x\n")
    with pytest.raises(Exception, match="no value column in none.csv"):
        signals.read_signal_files(spark, str(d), "d").collect()
    (tmp_path / "results_d_m_alpha_0.1.csv").write_text("f1,signal\n0.5,a\n")
    (tmp_path / "results_d_m_alpha_0.01.csv").write_text("signal,status,f1\nb,success,0.25\nc,failed,0.1\n")
    assert sorted((r.alpha, r.signal, r.f1) for r in signals.read_results(spark, str(tmp_path)).collect()) == [(0.01, "b", 0.25), (0.1, "a", 0.5)]
