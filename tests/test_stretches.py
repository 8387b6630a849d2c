"""Operators along a signal give the same rows whatever the length of the stretches they are dealt by."""

import pytest

from seriescope.operators import retrieval
from seriescope.operators import windows as win

#: Starts of two signals: repeated, touching, far apart and negative-free odd ones.
STARTS = {"a": [0, 0, 3, 7, 10, 14, 15, 29, 30, 31, 64, 90, 97, 98], "b": [5, 11, 12, 40, 41]}


@pytest.fixture(scope="module")
def windows(spark):
    rows = [("d", s, i, x) for s, starts in STARTS.items() for i, x in enumerate(starts)]
    return spark.createDataFrame(rows, "dataset string, signal_id string, window_id long, start_idx long").repartition(3)


def _audit(starts, length, policy):
    out = {}
    for i, q in enumerate(starts):
        same = sum(r == q for r in starts)
        over = sum(abs(r - q) < length and r != q for r in starts)
        past = sum(r + length <= q for r in starts)
        n = len(starts)
        if policy == "self_only":
            out[i] = (n, same, 0, 0, n - same)
        elif policy == "non_overlap":
            out[i] = (n, same, over, 0, n - same - over)
        else:
            out[i] = (n, same, over, n - same - over - past, past)
    return out


@pytest.mark.parametrize("policy", retrieval.POLICIES)
@pytest.mark.parametrize("length", [1, 8])
@pytest.mark.parametrize("stretch", [1, 10, 1000])
def test_validity_audit_by_stretches(windows, policy, length, stretch):
    got = retrieval.validity_audit(windows, length, policy, stretch=stretch).collect()
    assert len(got) == sum(map(len, STARTS.values()))
    for s, starts in STARTS.items():
        assert {r["query_id"]: tuple(r)[3:] for r in got if r["signal_id"] == s} == _audit(starts, length, policy)


def test_validity_audit_without_keys_and_rows(windows):
    one = windows.where("signal_id = 'b'").select("window_id", "start_idx")
    got = retrieval.validity_audit(one, 8, stretch=10)
    assert got.columns[0] == "query_id"
    assert {r["query_id"]: tuple(r)[1:] for r in got.collect()} == _audit(STARTS["b"], 8, "non_overlap")
    assert retrieval.validity_audit(one.limit(0), 8).isEmpty()


@pytest.mark.parametrize("stretch", [1, 10, 1000])
def test_nearest_window_by_stretches(spark, windows, stretch):
    focus = [(s, i, a, a + n) for s in STARTS for i, (a, n) in enumerate([(0, 0), (4, 9), (50, 3), (79, 0), (200, 5), (16, 1)])]
    f = spark.createDataFrame([("d", *x) for x in focus], "dataset string, signal_id string, focus_id long, start_idx long, end_idx long")
    got = {(r["signal_id"], r["focus_id"]): r["window_id"] for r in retrieval.nearest_window(windows, f, 8, stretch=stretch).collect()}
    for s, i, a, b in focus:
        assert got[s, i] == min(range(len(STARTS[s])), key=lambda w: (abs(STARTS[s][w] + 3.5 - (a + b) / 2), w))


def test_assessment_windows_equal_the_plan_of_each_signal(spark):
    cases = {
        "short": (30, [(2, 5)]), "free": (200, []), "cut": (200, [(40, 50), (88, 92), (93, 99), (150, 400)]), "long": (300, [(0, 60), (61, 140), (100, 120), (-5, 3)]),
        "whole": (250, [(0, 249)]), "middles": (400, [(i, i + 3) for i in range(5, 390, 7)]), "one": (1, [(0, 0)]), "edge": (101, [(44, 44), (46, 49), (300, 310), (20, 10)]),
    }
    lengths = spark.createDataFrame([("d", s, n) for s, (n, _) in cases.items()], "dataset string, signal_id string, n long")
    c = spark.createDataFrame([("d", s, a, b) for s, (_, found) in cases.items() for a, b in found] + [("d", "free", None, 7)], "dataset string, signal_id string, start_idx long, end_idx long")
    got = {}
    for r in win.assessment_windows(lengths, c, 50, 10).orderBy("window").collect():
        got.setdefault(r["signal_id"], []).append(tuple(r)[2:])
    for s, (n, found) in cases.items():
        plan = win.plan_windows(n, [x for x in found if x[0] <= x[1]], 50, 10)
        assert got[s] == [(w["window"], w["start"], w["end"], w["core_start"], w["core_end"]) for w in plan], s
    assert win.assessment_windows(lengths.limit(0), c, 50, 10).isEmpty()
