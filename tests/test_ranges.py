"""Range aggregates by a tree of blocks, windows from blocks, drawn windows."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seriescope.operators import evidence, intervals, ranges, windows
from seriescope.plans import pipeline

KEYS = "dataset string, signal_id string"
SCHEMA = KEYS + ", idx long, value double"
ASKED = KEYS + ", rid long, start_idx long, end_idx long"


def every_kind():
    v, i = F.col("value"), F.col("idx")
    return {"m": ("moments", v), "n": ("count", v), "lo": ("min", v), "hi": ("max", v), "first": ("first", i), "last": ("last", i)}


@pytest.mark.parametrize("block,fan", [(4, 3), (1, 2), (64, 16)])
def test_ranges_equal_direct_aggregates(spark, block, fan):
    """Random, whole, single, outer and reversed ranges; a negative first index, values far from zero, a gap."""
    rng = np.random.default_rng(block)
    idx = np.array([i for i in range(-7, 493) if not 100 <= i < 140])
    v = rng.normal(size=len(idx)) + 1e6
    points = spark.createDataFrame([("d", "s", int(i), float(x)) for i, x in zip(idx, v, strict=True)] + [("d", "t", 3, 2.0)], SCHEMA)
    spans = [*((int(a), int(b)) for a, b in rng.integers(-20, 520, (120, 2))), (-100, 1000), (-(2**60), 2**60), (5, 5), (110, 120), (600, 700), (-7, -7), (492, 492)]
    requests = spark.createDataFrame([("d", "s", i, a, b) for i, (a, b) in enumerate([*spans, spans[0]])] + [("d", "t", 900, 0, 9), ("d", "u", 901, 0, 9), (None, "s", 902, 0, 9), ("d", "s", 903, None, 9)], ASKED)
    got = {r.rid: r for r in ranges.range_aggregates(points, requests.unionByName(requests.where("rid = 3")), every_kind(), ["dataset", "signal_id"], block, fan).collect()}
    for i, (a, b) in enumerate([*spans, spans[0]]):
        at = (idx >= a) & (idx <= b)
        if not at.any():
            assert i not in got
            continue
        r, x = got.pop(i), v[at]
        assert (r.n, r.lo, r.hi, r["first"].value, r["last"].value) == (len(x), x.min(), x.max(), idx[at][0], idx[at][-1])
        assert r.m.total / r.m.n == pytest.approx(x.mean(), rel=1e-12) and (r.m.squares / r.m.n) ** 0.5 == pytest.approx(x.std(), abs=1e-7)
    assert set(got) == {900}


def test_ranges_of_odd_values(spark):
    """Nulls, NaN and infinities as the built-in aggregates have them; empty points and requests."""
    values = [1.0, None, float("nan"), 4.0, float("inf"), None, None, 2.0, float("inf"), -1.0]
    points = spark.createDataFrame([("d", "s", i, x) for i, x in enumerate(values)], SCHEMA)
    requests = spark.createDataFrame([("d", "s", 10 * a + b, a, b) for a in range(10) for b in range(a, 10)], ASKED)
    found = ranges.range_aggregates(points, requests, every_kind(), ["dataset", "signal_id"], 2, 2)
    got = found.select("rid", "n", ranges.mean_of(F.col("m")).alias("mean"), ranges.deviation_of(F.col("m")).alias("std"), "lo", "hi", "first.value")
    want = intervals.points_in(points, requests, ["dataset", "signal_id"]).groupBy("rid").agg(F.count("*"), F.avg("value"), F.stddev_pop("value"), F.min("value"), F.max("value"), F.min("idx"))

    def plain(df):
        return sorted(tuple("none" if x is None else f"{x:.9g}" for x in row) for row in df.collect())

    assert plain(got) == plain(want)
    none = points.limit(0)
    assert ranges.range_aggregates(none, requests, every_kind(), ["dataset", "signal_id"]).count() == 0
    assert ranges.range_aggregates(points, requests.limit(0), every_kind(), ["dataset", "signal_id"]).count() == 0


def test_many_long_ranges_of_one_signal(spark):
    """10,000 ranges of a tenth of a signal hold a billion points together; none is met again."""
    n, count, span = 1_000_000, 10_000, 100_000
    x = (np.arange(n) * 7919 % 10_007).astype(float)
    points = spark.range(n).select(F.lit("d").alias("dataset"), F.lit("s").alias("signal_id"), F.col("id").alias("idx"), (F.col("id") * 7919 % 10_007).cast("double").alias("value"))
    requests = spark.range(count).select(F.lit("d").alias("dataset"), F.lit("s").alias("signal_id"), F.col("id").alias("rid"), (F.col("id") * 89).alias("start_idx"), (F.col("id") * 89 + span - 1).alias("end_idx"))
    found = ranges.range_aggregates(points, requests, {"m": ("moments", F.col("value"))}, ["dataset", "signal_id"])
    got = found.select("rid", "m.total").toPandas().set_index("rid")["total"]
    sums = np.concatenate([[0], np.cumsum(x)])
    at = got.index.to_numpy() * 89
    assert len(got) == count and (got.to_numpy() == sums[at + span] - sums[at]).all()
    # Rows that meet a request: at most 30 nodes a level and two blocks.
    a, b = F.floor(F.col("start_idx") / 256) + 1, F.floor(F.col("end_idx") / 256)
    assert requests.agg(F.max(F.size(ranges._cover(a, b, 3, 16)))).first()[0] <= 60


def test_statistics_of_segments_equal_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=3000).round(2)
    points = spark.createDataFrame([("d", "s", i, float(v)) for i, v in enumerate(x)], SCHEMA)
    spans = [(0, 2999), (17, 17), (255, 256), (100, 1700), (2000, 9000)]
    got = {r.rid: r for r in evidence.segment_statistics(points, spark.createDataFrame([("d", "s", i, *s) for i, s in enumerate(spans)], ASKED)).collect()}
    for i, (a, b) in enumerate(spans):
        v, r = x[a : b + 1], got[i]
        assert [r.mean, r.std, r.lo, r.hi, r.q05, r.q25, r.q50, r.q75, r.q95, r.global_median] == pytest.approx([v.mean(), v.std(), v.min(), v.max(), *np.quantile(v, [0.05, 0.25, 0.5, 0.75, 0.95]), np.median(x)])
        assert r.n_points == len(v)


@pytest.mark.parametrize("sizes,steps", [([10, 7, 9], 4), ([4], 4), ([3], 4), ([12, 30], 5), ([224, 448, 672], 4)])
def test_windows_from_blocks_equal_slices(spark, sizes, steps):
    """Sizes that are no multiple of the blocks, steps of one, and a null value."""
    n = 700
    x = [None if i == 11 else float(i * 31 % 97) for i in range(n)]
    points = spark.createDataFrame([("d", "s", i, v) for i, v in enumerate(x)] + [("d", "short", 0, 1.0), ("d", "short", 1, 2.0)], SCHEMA)
    got = {(r.scale, r.window_id): (r.start_idx, r.vals) for r in windows.sliding_windows(points, sizes, steps).where("signal_id = 's'").collect()}
    want = {(s, k): (k * step, x[k * step : k * step + s]) for s in sizes for step in [max(1, s // steps)] for k in range((n - s) // step + 1)}
    assert got == want
    short = windows.sliding_windows(points, sizes, steps).where("signal_id = 'short'")
    assert short.count() == 0


def test_windows_of_a_long_signal_are_made_of_blocks(spark):
    """The second shuffle takes a row for each block and window, not for each point and window."""
    n = 56_000
    points = spark.range(n).select(F.lit("s").alias("signal_id"), F.col("id").alias("idx"), F.col("id").cast("double").alias("value"))
    found = windows.sliding_windows(points)
    parts, values = found.select(F.count("*"), F.sum(F.size("vals"))).first()
    windows_of = {s: (n - s) // (s // 4) + 1 for s in windows.SCALES}
    assert (parts, values) == (sum(windows_of.values()), sum(s * k for s, k in windows_of.items()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate explode", 1)
    assert "collect_list" in above and "collect_list" in below


def test_drawn_windows_are_those_with_the_lowest_hashes(spark):
    """Chosen in each partition before the shuffle; ids hashed anew outside Spark."""
    lengths = spark.createDataFrame([("d", "a", 5000), ("d", "b", 700), ("d", "c", 100)], KEYS + ", n long")
    starts = windows.window_starts(lengths)
    drawn = windows.draw_windows(starts, 10, 7)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan[plan.index("Exchange hashpartitioning") :]

    def place(window):
        first = xxhash.xxh64_intdigest(int(window).to_bytes(KINDS[types["window_id"]], "little"), 42)
        h = xxhash.xxh64_intdigest((7).to_bytes(4, "little"), first)
        return (h - 2**64 if h >= 2**63 else h, window)

    types, groups = dict(starts.dtypes), {}
    for r in starts.collect():
        groups.setdefault((r.signal_id, r.scale), []).append((r.window_id, r.start_idx))
    want = {(*g, *w) for g, ws in groups.items() for w in sorted(ws, key=lambda w: place(w[0]))[:10]}
    assert {(r.signal_id, r.scale, r.window_id, r.start_idx) for r in drawn.collect()} == want


#: Bytes of the types that ids may have.
KINDS = {"int": 4, "bigint": 8}


def make_mean_cosine():
    """A second policy: half of 1 - the mean cosine with the references' patches of the same place. It is
    made in a function, as tasks can't import this file."""

    def mean_cosine(query, kept):
        a, b = (x / np.linalg.norm(x, axis=-1, keepdims=True) for x in (query, kept))
        return 0.5 * (1 - (a[None] * b).sum(axis=-1).mean(axis=0))

    return mean_cosine


@pytest.mark.parametrize("policy", [pipeline.nearest_patch, make_mean_cosine()])
def test_window_vectors_of_fixed_tokens(spark, policy):
    """Tokens of a 4 x 4 board -> a score for each of 8 columns, step by step, under two policies."""
    rng, side, size, dims = np.random.default_rng(3), 4, 8, 3
    sides = {"patch": 4, "mid": 3, "large": 2}
    boards = [{n: rng.normal(size=(k * k, dims)).astype(np.float32) for n, k in sides.items()} for _ in range(5)]
    encoded = spark.createDataFrame([("s", 224, i, *(b[n].ravel().tolist() for n in sides)) for i, b in enumerate(boards)], "signal_id string, scale int, window_id long, patch array<float>, mid array<float>, large array<float>")
    pairs = [(0, 1, 2), (0, 2, 3), (0, 3, 4), (1, 1, 4), (2, 1, 0), (2, 2, 4)]
    refs = spark.createDataFrame([("s", 224, *p) for p in pairs], "signal_id string, scale int, query_id long, rank int, ref_id long")
    got = {r.window_id: r.vals for r in pipeline.window_vectors(encoded, refs, 2, side, size, similarity=policy).collect()}
    assert set(got) == set(range(5))
    for w in range(5):
        ref = [r for q, _, r in sorted(pairs) if q == w]
        levels = {}
        for name, k in sides.items():
            q, bank = boards[w][name].astype(float), np.array([boards[r][name] for r in ref], float)
            if not ref:
                levels[name] = np.zeros(k * k)
                continue
            flat = bank.reshape(len(bank), -1)
            mid = np.sort(flat, axis=0)[(len(flat) - 1) // 2]
            far = [1 - f @ mid / np.linalg.norm(f) / np.linalg.norm(mid) for f in flat]
            kept = bank[sorted(range(len(bank)), key=lambda i: (round(far[i], 12), i))[:2]]
            if policy is not pipeline.nearest_patch:
                levels[name] = policy(q, kept)
            else:
                levels[name] = [min(0.5 * (1 - p @ o / np.linalg.norm(p) / np.linalg.norm(o)) for o in kept.reshape(-1, dims)) for p in q]
        board = np.zeros(16)
        for c in range(16):
            total = levels["patch"][c]
            for name, k in (("mid", 2), ("large", 3)):
                n, (r, col) = side - k + 1, divmod(c + 1, side)
                scores = [levels[name][a * n + b] for a in range(n) for b in range(n) if a <= r < a + k and b <= col < b + k]
                total += np.nan if not scores else 0.0 if min(scores) == 0 else len(scores) / sum(1 / s for s in scores)
            board[c] = total / 3 if np.isfinite(total) else 0.0
        grid, at = board.reshape(side, side), np.clip((np.arange(size) + 0.5) * side / size - 0.5, 0, None)
        wide = np.array([np.interp(at, np.arange(side), row) for row in grid])
        full = np.array([np.interp(at, np.arange(side), col) for col in wide.T]).T
        assert got[w] == pytest.approx(np.sort(full, axis=0)[-size // 4 :].mean(axis=0), abs=1e-9), w


def test_a_policy_of_another_shape_is_an_error():
    with pytest.raises(ValueError, match="one score a patch"):
        pipeline.level_scores(np.ones((4, 2)), np.ones((1, 4, 2)), 1, lambda q, k: np.zeros(3))
