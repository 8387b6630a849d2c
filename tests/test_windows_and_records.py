"""Retrieval, maps, metrics, evidence, decision records, sessions and stage tables."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriescope.operators import evidence, maps, metrics, protocol, retrieval, tokens
from seriescope.plans import pipeline, session
from seriescope.sources import cache, signals

DS = "dataset string, signal_id string, "


def test_validity_of_references(spark):
    w = spark.createDataFrame([(i, 56 * i) for i in range(5)], "window_id long, start_idx long")
    valid = {p: retrieval.validity_audit(w, 112, p).where("query_id = 2").first() for p in retrieval.POLICIES}
    assert [valid[p]["valid"] for p in retrieval.POLICIES] == [4, 2, 1]
    assert valid["past_only_non_overlap"]["past_excluded"] == 1
    with pytest.raises(ValueError):
        retrieval.validity_audit(w, 112, "other")


@pytest.mark.parametrize("policy", retrieval.POLICIES)
@pytest.mark.parametrize("block", [4, 8192])
def test_top_references_equal_brute_force(spark, policy, block):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(23, 6))
    v[7] = v[3]
    w = spark.createDataFrame([(i, 56 * i, [float(x) for x in v[i]]) for i in range(23)], "window_id long, start_idx long, vec array<double>")
    got = {}
    for r in retrieval.top_references(w, 224, 5, policy, gap=1, block=block).collect():
        got[r.query_id, r["rank"]] = r.ref_id
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {}
    for q in range(23):
        ok = [r for r in range(23) if abs(r - q) > 1 and {"self_only": True, "non_overlap": abs(r - q) >= 4, "past_only_non_overlap": r <= q - 4}[policy]]
        for k, r in enumerate(sorted(ok, key=lambda r: (-round(float(u[q] @ u[r]), 12), r))[:5]):
            want[q, k + 1] = r
    assert got == want


def test_retention_takes_the_lower_median_and_order(spark):
    ref = np.array([[[1.0, 0.0]], [[1.0, 0.0]], [[0.0, 1.0]]])
    assert pipeline.keep_central(ref, 2).tolist() == [0, 1]
    assert [len(pipeline.keep_central(np.random.default_rng(1).normal(size=(k, 4, 3)), 4)) for k in (1, 2, 7)] == [1, 2, 4]
    refs = spark.createDataFrame([(0, k + 1, k) for k in range(3)], "query_id long, rank int, ref_id long")
    vectors = spark.createDataFrame([(k, [float(x) for x in ref[k].ravel()]) for k in range(3)], "window_id long, vec array<double>")
    assert [r.ref_id for r in retrieval.retain(refs, vectors, 2).orderBy("retained_rank").collect()] == [0, 1]


def test_patch_scores_vanish_with_complementary_references():
    q = np.array([[1.0, 0.0], [0.0, 1.0]])
    assert pipeline.level_scores(q, np.array([q, q[::-1], q, q]), 4).tolist() == [0, 0]
    assert pipeline.level_scores(q, np.empty((0, 2, 2)), 4).tolist() == [0, 0]


def test_pools_spread_like_the_relational_form(spark):
    rng = np.random.default_rng(5)
    for level, k in tokens.LEVELS.items():
        n = 14 - k + 1
        s = rng.uniform(0.1, 1, n * n)
        pools = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(s)], "window_id long, group_id long, score double")
        mask = tokens.pool_masks(spark).where(F.col("level") == level).select("group_id", "cell_id")
        for shift in (0, 1):
            got = [r.score for r in maps.harmonic_cells(pools, mask, shift=shift, by=["window_id"]).orderBy("cell_id").collect()]
            assert np.allclose(got, pipeline.spread_pools(s, 14, k, shift), equal_nan=True)
            assert np.isnan(got[-1]) == bool(shift)


def test_resize_keeps_constants_and_edges():
    w = maps.resize_weights(224, 14)
    assert np.allclose(w.sum(axis=1), 1)
    assert w[0, 0] == 1 and w[-1, -1] == 1
    assert maps.top_rows_mean(np.arange(8.0).reshape(8, 1)).tolist() == [6.5]


def test_align_equals_numpy(spark):
    rng = np.random.default_rng(2)
    for n in (100, 180, 230):
        v = rng.uniform(size=61)
        covered = 80 + 3 * 40
        y = np.interp(np.linspace(0, 60, covered), np.arange(61), v)
        want = y[:n] if n <= covered else np.concatenate([y, y[-1] + (y[-1] - y[-2]) * np.arange(1, n - covered + 1)])
        st = spark.createDataFrame([("d", "s", i, float(x)) for i, x in enumerate(v)], DS + "pos long, score double")
        shape = spark.createDataFrame([("d", "s", n, 80, 40, 4)], DS + "n int, size int, step int, windows int")
        got = [r.score for r in maps.align(st, shape).orderBy("idx").collect()]
        assert np.allclose(got, want)


def test_drawing_is_a_line():
    img = tokens.draw_line(np.linspace(0, 1, 224))
    assert img.shape == (224, 224) and img[223, 0] == 0 and img[0, 223] == 0 and img[0, 0] == 1
    assert tokens.mean_pool_encoder(img[None]).shape == (1, 196, 8)


def test_whole_screening_finds_a_block(spark):
    x = np.sin(0.04 * np.arange(1400))
    x[700:740] += 3
    pts = spark.createDataFrame([("d", "s", i, float(v)) for i, v in enumerate(x)], DS + "idx long, value double")
    scores = pipeline.scale_scores(pts)
    assert {(r.scale, r.n) for r in scores.groupBy("scale").agg(F.count("*").alias("n")).collect()} == {(s, 1400) for s in (224, 448, 672)}
    found = pipeline.screen(pts)
    assert {r.alpha for r in found.select("alpha").distinct().collect()} <= set(pipeline.ALPHAS)
    assert found.where("alpha = 0.1 and start_idx <= 740 and end_idx >= 700").count() > 0


def test_metrics_follow_definitions(spark):
    iv = DS + "start_idx long, end_idx long"
    groups = spark.createDataFrame([("d", "a"), ("d", "b")], "dataset string, signal_id string")
    truth = spark.createDataFrame([("d", "a", 10, 20), ("d", "a", 22, 30)], iv)
    det = spark.createDataFrame([("d", "a", 20, 22), ("d", "a", 40, 41), ("d", "b", 1, 2)], iv)
    r = {x.signal_id: x for x in metrics.evaluate_intervals(groups, truth, det).collect()}
    assert (r["a"].tp, r["a"].fp, r["a"].fn, r["b"].fp) == (2, 1, 0, 1)
    assert r["a"].precision == pytest.approx(2 / 3) and r["a"].recall == 1 and r["b"].f1 == 0
    n = {x.signal_id: x.f1 for x in metrics.evaluate_intervals(groups, truth, det, nan_without_truth=True).collect()}
    assert np.isnan(n["b"]) and n["a"] == pytest.approx(0.8)


def test_summary_takes_the_best_alpha_then_the_mean(spark):
    rows = []
    for s, hit in (("a", 0.1), ("b", 0.01)):
        for alpha in (0.1, 0.01, 0.001):
            for stage in ("screening", "final"):
                rows.append(("d", s, alpha, stage, 1.0 if alpha == hit else 0.0, True))
    schema = DS + "alpha double, stage string, f1 double, complete boolean"
    roster = spark.createDataFrame([("d", "a"), ("d", "b"), ("e", "c")], "dataset string, signal_id string")
    r = {x.dataset: x for x in metrics.experiment_summary(roster, spark.createDataFrame(rows, schema)).collect()}
    assert (r["d"].final_f1max, r["d"].n_complete, r["e"].n_complete, r["e"].final_f1max) == (1.0, 2, 0, None)
    rows[0] = (*rows[0][:5], False)
    assert metrics.experiment_summary(roster, spark.createDataFrame(rows, schema)).where("dataset = 'd'").first().n_complete == 1


def test_point_curve(spark):
    df = spark.createDataFrame([("x", 0.9, 1), ("x", 0.8, 0), ("x", 0.7, 1), ("y", 0.5, 0)], "g string, score double, label int")
    r = metrics.point_f1max(df, by=["g"]).where("g = 'x'").first()
    assert (r.f1max, r.threshold) == (pytest.approx(0.8), 0.7)
    assert metrics.average_precision(df, by=["g"]).where("g = 'x'").first().auprc == pytest.approx((1 + 2 / 3) / 2)
    assert np.isnan(metrics.point_f1max(df, by=["g"]).where("g = 'y'").first().f1max)


def decisions(spark, rows):
    return spark.createDataFrame([("d", "s", *r) for r in rows], DS + "candidate_id string, reviewed_start long, reviewed_end long, action string, final_start long, final_end long, confidence_level int, confidence double, rationale string, evidence_sufficient boolean")


def test_records_of_the_protocol(spark):
    n = spark.createDataFrame([("d", "s", 100)], DS + "n long")
    good = decisions(spark, [("C1", 1, 5, "keep", 1, 5, 3, 0.99, "", True), ("C2", 10, 20, "remove", None, None, 2, 0.8, "", True), ("C3", 30, 40, "refine", 29, 43, 1, 0.5, "", True), (None, 60, 65, "add", 60, 65, 3, 0.97, "", True)])
    assert protocol.violations(good, n).where("violation is not null").count() == 0
    assert sorted(r.candidate_id for r in protocol.verification_targets(good).collect()) == ["C2", "C3"]
    assert sorted((r.start_idx, r.end_idx) for r in protocol.final_intervals(good).collect()) == [(1, 5), (29, 43), (60, 65)]
    bad = decisions(spark, [("a", 5, 1, "keep", 5, 1, 3, 0.99, "", True), ("b", 1, 2, "drop", 1, 2, 3, 0.99, "", True), ("c", 1, 2, "remove", 1, 2, 3, 0.99, "", True), ("d", 1, 2, "keep", 1, 3, 3, 0.99, "", True), ("e", 1, 2, "keep", 1, 2, 3, float("nan"), "", True), ("f", 1, 2, "keep", 1, 2, 1, 0.9, "", True), ("g", 1, 2, "keep", 1, 2, 4, 0.9, "", True), ("h", 1, 2, "refine", 1, 200, 3, 0.99, "", True), ("i", 1, 2, "keep", 1, 2, 3, 0.99, None, True)])
    got = [r.violation for r in protocol.violations(bad, n).orderBy("candidate_id").collect()]
    assert got == ["reviewed_interval", "action", "remove_with_interval", "bounds_changed", "confidence", "band", "confidence_level", "final_interval", "explanation"]
    c = spark.createDataFrame([("d", "s", "C1", 1, 5), ("d", "s", "C9", 7, 8)], DS + "candidate_id string, start_idx long, end_idx long")
    assert {(r.candidate_id, r.problem) for r in protocol.coverage(c, good).collect()} == {("C9", "missing"), ("C2", "unknown"), ("C3", "unknown")}


def test_refined_bounds_need_evidence(spark):
    rec = decisions(spark, [("C1", 100, 200, "refine", 80, 220, 2, 0.9, "", True)]).withColumn("record_key", protocol.record_key())
    for focus, want in (((100, 200), False), ((50, 250), True)):
        e = spark.createDataFrame([("d", "s", f, "ok", *focus) for f in ("visual", "statistical")], DS + "family string, status string, focus_start long, focus_end long")
        assert protocol.evidence_support(rec, e).first().supported is want
    assert protocol.evidence_support(rec, e.where("family = 'visual'")).first().supported is False


def test_home_windows_meet_their_bucket_only(spark):
    from seriescope.operators.windows import home_windows

    c = spark.createDataFrame([("d", "s", a, b) for a, b in ((0, 3), (5, 6), (5, 6), (9, 30), (9_000, 9_001), (70, 80))], DS + "start_idx long, end_idx long")
    w = spark.createDataFrame([("d", "s", 2, 5, 9_500), ("d", "s", 1, 0, 5), ("d", "s", 3, 60, 72)], DS + "window long, core_start long, core_end long")
    got = home_windows(c, w)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.start_idx, r.window) for r in got.collect()) == [(0, 1), (5, 1), (5, 1), (9, 2), (70, 2), (9_000, 2)]
    assert [r.window for r in home_windows(c.where("start_idx = 9000"), w.where("window <> 2")).collect()] == [3]


def test_session_keeps_what_is_strong(spark):
    x = [0.0, 1.0] * 100
    x[50], x[120] = 40.0, 1.5
    pts = spark.createDataFrame([("d", "s", i, v) for i, v in enumerate(x)], DS + "idx long, value double")
    c = spark.createDataFrame([("d", "s", "C0001", 50, 50, 50.0), ("d", "s", "C0002", 120, 121, 1.0)], DS + "candidate_id string, start_idx long, end_idx long, severity double")
    records, final = session.run_session(pts, c, session.RuleReviewer())
    assert [(r.start_idx, r.end_idx) for r in final.collect()] == [(50, 50)]
    assert {r.verdict for r in records.collect()} == {"assessment_final", "verification_accepted"}

    class Broken(session.RuleReviewer):
        asked = 0

        def assess(self, candidates, problems):
            Broken.asked += 1
            return super().assess(candidates, problems).withColumn("confidence", F.lit(2.0))

    with pytest.raises(ValueError, match="protocol"):
        session.run_session(pts, c, Broken())
    assert Broken.asked == 3


def test_session_needs_evidence_of_two_families(spark, tmp_path):
    x = [0.0, 1.0] * 12_000
    x[50], x[120], x[22_000], x[23_000] = 40.0, 1.5, 1.5, 30.0
    pts = spark.createDataFrame([("d", "s", i, v) for i, v in enumerate(x)], DS + "idx long, value double")
    c = spark.createDataFrame([("d", "s", "C0001", 50, 50, 50.0), ("d", "s", "C0002", 120, 121, 1.0), ("d", "s", "C0003", 22_000, 22_001, 1.0)], DS + "candidate_id string, start_idx long, end_idx long, severity double")

    class OneFamily(session.RuleReviewer):
        def ask(self, targets, seen, turn):
            return super().ask(targets, seen, turn) if turn == 0 else None

    records, final = session.run_session(pts, c, OneFamily())
    assert sorted((r.start_idx, r.end_idx) for r in final.collect()) == [(50, 50), (120, 121), (22_000, 22_001)]
    assert {r.verdict for r in records.where("candidate_id <> 'C0001'").collect()} == {"assessment_preserved_insufficient_evidence"}

    class Adds(session.RuleReviewer):
        places = ((23_000, 23_000, 3, 0.99), (300, 300, 2, 0.8), (400, 400, 1, 0.5))

        def ask(self, targets, seen, turn):
            call = super().ask(targets, seen, turn)
            more = [("d", "s", 2, "new", 22_990, 23_010)]
            return call and (call[0], call[1].unionByName(spark.createDataFrame(more, DS + "window long, record_key string, start_idx long, end_idx long")) if turn < 2 else call[1], call[2])

        def add(self, targets, seen, problems):
            return decisions(spark, [(None, a, b, "add", a, b, level, q, "", True) for a, b, level, q in self.places]).withColumn("seq", F.monotonically_increasing_id())

    for _ in range(2):
        records, final = session.run_session(pts, c, Adds(), root=str(tmp_path / "session"))
        assert sorted((r.start_idx, r.end_idx) for r in final.collect()) == [(50, 50), (23_000, 23_000)]
        assert {(r.record_key, r.window, r.verdict) for r in records.where("candidate_id is null").collect()} == {("ADD:23000:23000", 2, "new_add_accepted")}
    Adds.places = ((119, 125, 3, 0.99),)
    with pytest.raises(ValueError, match="overlap"):
        session.run_session(pts, c, Adds())

    class Greedy(session.RuleReviewer):
        def ask(self, targets, seen, turn):
            return super().ask(targets, seen, 0)

    with pytest.raises(ValueError, match="budget"):
        session.run_session(pts, c, Greedy())


def test_steps_are_committed_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert session.committed(spark, str(tmp_path), "one", {"a": 1}, make).count() == 3
    assert len(made) == 1
    with pytest.raises(ValueError, match="another request"):
        session.committed(spark, str(tmp_path), "one", {"a": 2}, make)
    log = spark.read.json(f"{tmp_path}/one/attempts")
    assert sorted(r["event"] for r in log.collect()) == ["completed", "started"]
    with pytest.raises(ZeroDivisionError):
        session.committed(spark, str(tmp_path), "two", {"a": 1}, lambda: 1 / 0)
    log = spark.read.json(f"{tmp_path}/two/attempts")
    assert sorted(r["event"] for r in log.collect()) == ["failed", "started"]
    assert log.where("event = 'failed'").first()["error"].startswith("ZeroDivisionError")
    session.check_identity({"a": 1}, {"a": 1})
    with pytest.raises(ValueError):
        session.check_identity({"a": 1}, {"a": 2})
    lock = str(tmp_path / "lock")
    with session.output_lock(lock), pytest.raises(RuntimeError), session.output_lock(lock):
        pass
    (tmp_path / "lock").write_text("999999999")
    with session.output_lock(lock):
        pass


def test_stage_tables(spark, tmp_path):
    m = spark.createDataFrame([("d", "a", True, 1, 5, None), ("d", "b", False, 1, 5, "x"), ("e", "c", True, 9, 5, None)], cache.MANIFEST)
    assert [r.signal_id for r in cache.list_complete(m).collect()] == ["a"]
    cache.write_stage(m, str(tmp_path), "manifest")
    assert cache.load_stage(spark, str(tmp_path), "manifest", "d", "b").count() == 1
    new = spark.createDataFrame([("d", "b", True, 1, 5, None)], cache.MANIFEST)
    assert {(r.dataset, r.n_complete, r.n_failed) for r in cache.manifest_counts(cache.upsert_manifest(m, new)).collect()} == {("d", 2, 0), ("e", 1, 0)}
    cache.write_report(m.select("dataset", F.lit(0.123456).alias("f1")), str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r/summary_csv"), header=True).first().f1 == "0.1235"


def test_files_are_read(spark, tmp_path):
    (tmp_path / "sig").mkdir()
    pd.DataFrame({"timestamp": [2, 1, 3], "value": [5.0, 4.0, None]}).to_csv(tmp_path / "sig/s 1.csv", index=False)
    got = signals.normalise(signals.read_signal_files(spark, str(tmp_path / "sig"), "d").drop("row_order")).orderBy("idx").collect()
    assert [(r.signal_id, r.value) for r in got] == [("s 1", 4.0), ("s 1", 5.0), ("s 1", 5.0)]
    (tmp_path / "a.csv").write_text('signal,anomalies\na,"[[1, 2], [5, 6.5]]"\nb,oops\na,"[[3, 4]]"\n')
    assert [(r.signal_id, r.start_value, r.end_value) for r in signals.read_annotations(spark, str(tmp_path / "a.csv")).collect()] == [("a", 3.0, 4.0)]
    (tmp_path / "r.json").write_text(json.dumps({"count": 2, "signals": [{"dataset": "d", "signal_id": "a"}, {"dataset": "d", "signal_id": "b"}]}))
    assert signals.read_roster(spark, str(tmp_path / "r.json"), 2).count() == 2
    with pytest.raises(ValueError):
        signals.read_roster(spark, str(tmp_path / "r.json"), 252)
    (tmp_path / "results_d_m_x_alpha_0.01.csv").write_text("signal,f1,status\na,0.5,success\nb,0.1,failed\n")
    assert [(r.model, r.alpha, r.signal, r.f1) for r in signals.read_results(spark, str(tmp_path)).collect()] == [("m_x", 0.01, "a", 0.5)]


def test_envelope_and_lanes(spark):
    pts = spark.createDataFrame([("d", "s", i, v) for i, v in enumerate([1.0, 5.0, 2.0, 2.0, float("nan"), 0.0])], DS + "idx long, value double")
    assert sorted(r.idx for r in evidence.envelope(pts, 3).collect()) == [0, 1, 2, 5]
    assert evidence.envelope(pts, 6).where("extreme = 1").count() == 0
    assert evidence.label_lanes([(0, 5), (3, 8), (6, 9)]) == [0, 1, 0]
    assert evidence.parse_reference_id(F.lit("nonsense")) is not None
    assert spark.range(1).select(evidence.parse_reference_id(F.lit("s224:q000012:r000007")).alias("x")).first().x == (224, 12, 7)


def test_private_columns_go(spark):
    df = spark.sql("select 1 as a, named_struct('x', 2, 'path', 3) as data, 4 as uri, array(named_struct('root', 1, 'y', 5)) as media")
    assert protocol.redact(df).first().asDict(recursive=True) == {"a": 1, "data": {"x": 2}, "media": [{"y": 5}]}


def test_stream_matches_batch(spark, tmp_path):
    from seriescope.streaming.ewma import running_ewma

    rows = spark.sql("select 'a' as signal_id, timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,id) as ts, cast(id * id % 7 as double) as value from range(40)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = running_ewma(stream).writeStream.format("memory").queryName("smoothed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = [r.smooth for r in spark.sql("select * from smoothed order by ts").collect()]
    want = pd.Series([i * i % 7 for i in range(40)], dtype=float).ewm(span=10).mean()
    assert np.allclose(got, want)


def test_tools_by_name(spark):
    from seriescope.plans.tools import Registry, Tables, check_step

    pts = spark.createDataFrame([("d", "s", i, float(i)) for i in range(50)], DS + "idx long, value double")
    n = spark.createDataFrame([("d", "s", 50)], DS + "n long")
    ask = spark.createDataFrame([("d", "s", 60, 40)], DS + "start_idx long, end_idx long")
    known = Registry()
    assert len(known.tools) == 8 and "segment_statistics" in known.catalogue()
    r = known.dispatch("inspect_raw_segment", Tables(pts, n), ask)
    assert r.status == "ok" and [x.idx for x in r.rows.orderBy("idx").collect()] == list(range(40, 50))
    assert known.dispatch("get_screening_evidence", Tables(pts, n), ask).status == "error"
    with pytest.raises(KeyError):
        known.dispatch("other", Tables(pts, n), ask)
    with pytest.raises(ValueError):
        known.register(known.tools["value_zscore"])
    call = {"type": "call_tool", "tool": "value_zscore", "arguments": {}, "focus_interval": [1, 5]}
    check_step(call, known, 50, 0, 0, set())
    check_step({"type": "finalize", "decisions": [{"record_key": "C1"}]}, known, 50, 0, 0, {"C1"})
    for bad, calls in ((call, 5), ({**call, "tool": "x"}, 0), ({**call, "focus_interval": [5, 99]}, 0), ({"type": "finalize", "decisions": []}, 0), ({"type": "?"}, 0)):
        with pytest.raises(ValueError):
            check_step(bad, known, 50, calls, 0, {"C1"})


def test_range_joins_equal_brute_force(spark):
    from seriescope.operators import intervals

    rng = np.random.default_rng(8)
    make = lambda n: [("d", str(i % 2), int(a), int(a + w)) for i, (a, w) in enumerate(zip(rng.integers(0, 400, n), rng.integers(0, 90, n), strict=True))]
    a, b = make(60), make(50)
    schema = DS + "start_idx long, end_idx long"
    x, y = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    want = sorted((p, q[2:]) for p in a for q in b if p[1] == q[1] and p[2] <= q[3] and q[2] <= p[3])
    for bucket in (16, 4096):
        got = sorted(((r.dataset, r.signal_id, r.start_idx, r.end_idx), (r.other_start, r.other_end)) for r in intervals.overlap_pairs(x, y, ["dataset", "signal_id"], bucket).collect())
        assert got == want
    pts = spark.createDataFrame([("d", s, i, 10 * i) for s in "01" for i in range(30)], DS + "idx long, ts long")
    spans = spark.createDataFrame([("d", "0", 5, 25), ("d", "1", 10, 10), ("d", "1", 11, 19), ("d", "0", -5, 1000)], DS + "start_ts long, end_ts long")
    late = pts.unionByName(spark.createDataFrame([("d", "0", -1, None)], DS + "idx long, ts long"))
    for part in (None, lambda c: F.floor(c / 20), lambda c: F.floor(c / 1000)):
        got = sorted((r.signal_id, r.start_ts, r.start_idx, r.end_idx) for r in intervals.to_index_space(pts, spans, part=part).collect())
        assert got == [("0", -5, 0, 29), ("0", 5, 1, 2), ("1", 10, 1, 1)]
        # A point without a time comes before all others.
        got = sorted((r.signal_id, r.start_ts, r.start_idx, r.end_idx) for r in intervals.to_index_space(late, spans, part=part).collect())
        assert got == [("0", -5, 1, 30), ("0", 5, 2, 3), ("1", 10, 1, 1)]


def test_single_scale_detector(spark):
    x = np.sin(0.04 * np.arange(900))
    x[400:430] += 3
    pts = spark.createDataFrame([("d", "s", i, float(v)) for i, v in enumerate(x)], DS + "idx long, value double")
    scores, found = pipeline.detect(pts, 0.1)
    got = np.array([r.score for r in scores.orderBy("idx").collect()])
    assert found.where("severity <= 0").count() == 0

    t = np.polyfit(np.arange(900), x, 1)
    y = x - np.polyval(t, np.arange(900))
    y = (y - y.min()) / (y.max() - y.min())
    images = np.stack([tokens.draw_line(y[a : a + 224]) for a in range(0, 900 - 224 + 1, 56)])
    patch = tokens.mean_pool_encoder(images).astype(np.float32).astype(float)
    levels, side = {"patch": patch}, 14
    for name, k in tokens.LEVELS.items():
        n = side - k + 1
        grid = tokens.mean_pool_encoder(images).reshape(len(images), side, side, -1)
        pools = np.stack([grid[:, r : r + k, c : c + k].mean(axis=(1, 2)) for r in range(n) for c in range(n)], axis=1)
        levels[name] = pools.astype(np.float32).astype(float)
    vectors = []
    memory = {name: np.sort(v, axis=0)[(len(v) - 1) // 2] for name, v in levels.items()}
    for w in range(len(images)):
        scores_ = {name: pipeline.memory_distances(v[w], memory[name], False) for name, v in levels.items()}
        vectors.append(pipeline.board_vector(scores_, maps.resize_weights(), side, 1))
    total, count = np.zeros(56 * (len(images) - 1) + 224), np.zeros(56 * (len(images) - 1) + 224)
    for w, v in enumerate(vectors):
        total[56 * w : 56 * w + 224] += v
        count[56 * w : 56 * w + 224] += 1
    want = total / count
    want = np.concatenate([want, want[-1] + (want[-1] - want[-2]) * np.arange(1, 900 - len(want) + 1)])
    assert np.allclose(got, want, atol=1e-9)
    rows = pipeline.memory_distances(patch[0], memory["patch"], True)
    assert (rows >= pipeline.memory_distances(patch[0], memory["patch"], False) - 1e-12).all()


def test_files_per_alpha_and_their_nan_policy(spark, tmp_path):
    from seriescope.sources import cache

    rows = spark.createDataFrame([("d", "s", 0.1, 0.5), ("d", "s", 0.01, float("nan")), ("d", "t", 0.1, None)], "dataset string, signal_id string, alpha double, f1 double")
    cache.write_per_alpha(rows, str(tmp_path), "metrics", form="csv")
    got = spark.read.option("header", True).csv(f"{tmp_path}/metrics").collect()
    assert sorted((r["signal_id"], str(r["alpha_dir"]), r["f1"]) for r in got if r["f1"] is not None) == [("s", "0.01", "NaN"), ("s", "0.1", "0.5")]
    cache.write_per_alpha(rows.where("alpha = 0.1"), str(tmp_path), "decisions", allow_nan=False)
    assert spark.read.json(f"{tmp_path}/decisions").count() == 2
    with pytest.raises(Exception, match="f1 is not a finite number"):
        cache.write_per_alpha(rows, str(tmp_path), "strict", allow_nan=False)
    with pytest.raises(ValueError):
        cache.write_per_alpha(rows, str(tmp_path), "other", form="xml")


def test_input_adapters():
    import numpy as np

    from seriescope.operators import tokens

    images = np.array([[[0.0, 0.5], [1.2, -1.0]]])
    assert tokens.input_adapter()(images).dtype == np.float32
    seen = tokens.input_adapter("official", lambda x: x.astype(float).mean(axis=-1) / 255)(images)
    assert seen.shape == (1, 2, 2) and seen[0, 1].tolist() == [1.0, 0.0] and abs(seen[0, 0, 1] - 128 / 255) < 1e-12
    with pytest.raises(ValueError):
        tokens.input_adapter("official")
    with pytest.raises(ValueError):
        tokens.input_adapter("other")


def test_trace_holds_scores_and_valid_ranges(spark):
    from seriescope.sources.cache import query_trace

    key = "'d' as dataset, 's' as signal_id, 8 as scale"
    w = spark.sql(f"select {key}, id as window_id, id * 4 as start_idx from range(4)")
    refs = spark.sql(f"select {key}, 0L as query_id, 2L as ref_id, 1 as rank, 0.5D as sim, 1 as retained_rank, 0.25D as distance")
    cols = spark.sql(f"select {key}, 0L as query_id, id as col, id / 2D as score from range(3)")
    got = {r["query_window_id"]: r for r in query_trace(refs, w, 8, window_scores=cols).collect()}
    assert [got[i]["valid_reference_ranges"] for i in range(4)] == ["[[2,3]]", "[[3,3]]", "[[0,0]]", "[[0,1]]"]
    assert (got[0]["retained_distances"], got[0]["retained_ranks"], got[0]["window_score_mean"], got[0]["window_score_max"]) == ("[0.25]", "[1]", 0.5, 1.0)
    assert got[1]["window_score_mean"] is None and got[1]["patch_score_max"] is None and got[1]["reference_status"] == "no_non_overlap_reference"
    past = {r["query_window_id"]: r["valid_reference_ranges"] for r in query_trace(refs, w, 8, "past_only_non_overlap").collect()}
    assert past == {0: "[]", 1: "[]", 2: "[[0,0]]", 3: "[[0,1]]"}
    alone = {r["query_window_id"]: r["valid_reference_ranges"] for r in query_trace(refs, w, 8, "self_only").collect()}
    assert alone == {0: "[[1,3]]", 1: "[[0,0],[2,3]]", 2: "[[0,1],[3,3]]", 3: "[[0,2]]"}
