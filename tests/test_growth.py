"""Plans whose time and memory grow with the input, no faster."""

import pytest

from seriescope.plans.queries import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["b2_interpolate", "b4_missing_time", "j9_nearest_window"])
def test_no_frame_shrinks(spark, sf, name):
    """A frame up to the last row of a stretch is computed anew for each row: the square of the stretch."""
    assert "unboundedfollowing" not in plan_of(QUERIES[name](spark, sf)).lower()


@pytest.mark.parametrize("name", ["m1_harmonic", "m1_harmonic_all", "m2_map_mean", "m2_map_mean_all"])
def test_only_masks_are_joined(spark, sf, name):
    """A board of 196 cells a window looks small to the planner, which would broadcast it."""
    assert sum("Join" in line for line in plan_of(QUERIES[name](spark, sf)).split("== Initial Plan ==")[-1].splitlines()) == 1


def test_products_are_narrowed_before_they_are_ordered(monkeypatch):
    """Of a row of similarities only a few near the k-th are put in order, and ranges say what is invalid."""
    import numpy as np
    import pyarrow as pa

    from seriescope.operators import retrieval

    n, k = 2000, 5
    v = np.random.default_rng(3).normal(size=(n, 16))
    v[700:1000] = v[700]  # copies: more ties than are asked for
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[5] = np.nan
    rows = {"window_id": np.arange(n), "start_idx": np.arange(n) * 56, "vec": list(v)}
    table = pa.concat_tables([pa.table({"side": np.full(n, side), **rows}) for side in (0, 1)])
    seen, sort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda by: seen.append(len(by[0])) or sort(by))
    got = retrieval._nearest_in([], 224, k, "non_overlap", 0)(table).to_pandas()
    assert 0 < sum(seen) < n * n / 10
    sim = np.round(np.nan_to_num(v) @ np.nan_to_num(v).T, 12)
    for q in (0, 4, 800, n - 1):
        valid = [r for r in range(n) if abs(r - q) >= 4 and r != 5]
        assert list(got[got["query_id"] == q]["ref_id"]) == sorted(valid, key=lambda r: (-sim[q, r], r))[:k]
    assert not len(got[got["query_id"] == 5])


def test_a_task_makes_few_pairs(spark):
    """All pairs of a task are rows, so a task meets some 2 million."""
    from seriescope.operators import retrieval

    def sizes(df):
        return df.selectExpr("id as window_id", "array(1d, cast(id as double)) as vec")

    df = retrieval.cosines(sizes(spark.range(600)), sizes(spark.range(9000)))
    assert df.count() == 600 * 9000
    assert retrieval.cosines.__defaults__[1] * retrieval.cosines.__defaults__[2] <= 1 << 21


def test_a_length_is_taken_once(spark):
    """A length inside a lambda is computed anew for each element of a vector."""
    from seriescope.functions.numeric import unit

    df = spark.range(1).selectExpr("array(3d, 4d) as v").select(unit("v").alias("u"))
    assert df.first().u == [0.6, 0.8]
    assert "/ greatest(" not in plan_of(spark.range(1).selectExpr("array(cast(id as double), 4d) as v").select(unit("v").alias("u")))


def test_vectors_travel_packed(spark):
    """What goes to each pair of blocks is a row for many vectors."""
    from seriescope.operators import retrieval

    rows = spark.range(5000).selectExpr("0 as k", "0 as part", "id as window_id", "id * 56 as start_idx", "array(if(id = 7, cast('nan' as double), 1d), cast(id as double)) as vec")
    got = retrieval.packed(rows, ["k"], "part").selectExpr("length(ids) / 8 as n", "length(vecs) / 16 as m").collect()
    assert sorted(r.n for r in got) == [903, 2048, 2048] == sorted(r.m for r in got)


@pytest.mark.parametrize("policy", ["self_only", "non_overlap", "past_only_non_overlap"])
@pytest.mark.parametrize("shuffled", [False, True])
def test_tiles_equal_brute_force(monkeypatch, policy, shuffled):
    """Several tiles and products, many copies, starts in any order, candidates thinned out on the way."""
    import numpy as np
    import pyarrow as pa

    from seriescope.operators import retrieval

    monkeypatch.setattr(retrieval, "HELD", 500)
    n, k, gap, rnd = 4500, 5, 3, np.random.default_rng(5)
    v = rnd.normal(size=(n, 8))
    v[1000:1200] = v[1000]
    v /= np.linalg.norm(v, axis=1)[:, None]
    starts = (rnd.permutation(n) if shuffled else np.arange(n)) * 56
    half = np.array_split(np.arange(n), 2)
    data = [(0, half[1]), (1, half[1]), (1, half[0]), (0, half[0])]
    table = pa.concat_tables([pa.table({"side": [side], **{c: pa.array([x[i].tobytes()], pa.binary()) for c, x in (("ids", np.arange(n)), ("starts", starts), ("vecs", v))}}) for side, i in data])
    got = retrieval._nearest_in([], 224, k, policy, gap)(table).to_pandas().groupby("query_id")["ref_id"].agg(list)
    sim = np.round(v @ v.T, 12)
    for q in [*range(0, n, 50), *range(1000, 1010), n - 1]:
        off = starts - starts[q]
        shut = {"self_only": off == 0, "non_overlap": np.abs(off) < 224, "past_only_non_overlap": off > -224}[policy] | (np.abs(np.arange(n) - q) <= gap)
        valid = np.flatnonzero(~shut)
        assert got.get(q, []) == list(valid[np.lexsort((valid, -sim[q, valid]))][:k])


def test_found_references_travel_packed(spark, sf):
    """What a pair of blocks gives is merged as bytes: a row for each would be sorted, k of them a block and query."""
    assert "row_number" not in plan_of(QUERIES["j3_topk_references"](spark, sf))


def test_blocks_hold_rows_wherever_ids_lie(spark):
    """Several blocks of both sides, found references of all of them in order, ties to the smaller id."""
    import numpy as np

    from seriescope.operators import retrieval

    n, k, rnd = 150, 7, np.random.default_rng(7)
    v = rnd.normal(size=(n, 6))
    v[20:60] = v[20]
    far = np.arange(n) * np.where(np.arange(n) < 75, 1, 1000)
    w = spark.createDataFrame([(int(far[i]), 56 * i, [float(x) for x in v[i]]) for i in range(n)], "window_id long, start_idx long, vec array<double>")
    got = {}
    for r in retrieval.top_references(w, 224, k, block=8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.ref_id)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(n):
        valid = np.flatnonzero(np.abs(np.arange(n) - q) >= 4)
        assert got[far[q]] == [far[r] for r in sorted(valid, key=lambda r: (-round(float(u[q] @ u[r]), 12), r))[:k]]


def test_packing_scales_as_columns_do(spark):
    """The bits are those of ``unit``, also of a vector of zeros."""
    import numpy as np

    from seriescope.functions.numeric import unit
    from seriescope.operators import retrieval

    df = spark.range(500).selectExpr("0 as part", "id as window_id", "id as start_idx", "transform(sequence(1, 64), x -> if(id = 3, 0d, sin(x * id + 1))) as vec")
    got = np.frombuffer(retrieval.packed(df, [], "part", scaled=True).first().vecs).reshape(500, 64)
    want = [r.u for r in df.orderBy("window_id").select(unit("vec").alias("u")).collect()]
    assert (got == np.array(want)).all()


def test_centres_are_found_without_columns_in_columns(spark, sf):
    """A sort for each component of a query, and lengths for each reference, were most of the work."""
    from seriescope.operators import retrieval

    plan = plan_of(QUERIES["j5_retain"](spark, sf))
    assert "MapInArrow" in plan and "array_sort" not in plan
    # Lists and vectors of several lengths, equal distances, a vector of zeros.
    refs = spark.createDataFrame([(q, r + 1, 10 * (q % 2) + r) for q in range(4) for r in range(q + 1)], "query_id long, rank int, ref_id long")
    vectors = spark.createDataFrame([(i, [float((i * j) % 3) for j in range(3 + i // 10)]) for i in range(20)], "window_id long, vec array<double>")
    got = retrieval.retain(refs, vectors, 2).orderBy("query_id", "retained_rank").collect()
    assert [(r.query_id, r["rank"], r.ref_id) for r in got] == [(0, 1, 0), (1, 1, 10), (1, 2, 11), (2, 2, 1), (2, 3, 2), (3, 1, 10), (3, 2, 11)]


def test_references_meet_a_window_once(spark, sf):
    """Patches of a query are not joined with those of its references one by one."""
    from seriescope.operators import retrieval

    patches = spark.createDataFrame([(w, p, [1.0 + w, float(p)]) for w in range(4) for p in range(3)], "window_id long, patch_id int, vec array<double>")
    kept = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "query_id long, ref_id long")
    df = retrieval.patch_bank_scores(kept, patches)
    assert "MapInArrow" in plan_of(df)
    got = {(r.query_id, r.patch_id): r.score for r in df.collect()}
    assert len(got) == 12 and not any(got[q, p] for q in (2, 3) for p in range(3))

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    for q, refs in ((0, (1, 2)), (1, (3,))):
        for p in range(3):
            top = max(cos((1 + q, p), (1 + r, o)) for r in refs for o in range(3))
            assert abs(got[q, p] - 0.5 * (1 - top)) < 1e-12


def test_points_are_dealt_before_scales_are_summed(spark, sf):
    """Sums before a shuffle would hold all points of a task's rows, once for each pass of a distinct count."""
    lines = plan_of(QUERIES["n2_fuse"](spark, sf)).split("== Initial Plan ==")[-1].splitlines()
    above = lines[: next(i for i, line in enumerate(lines) if "REPARTITION_BY_COL" in line)]
    assert sum("HashAggregate" in line for line in above) == 2
    assert not any("Exchange" in line for line in above)


def test_ranges_of_whole_blocks_are_slices(spark):
    """A block without gaps isn't searched; one with gaps or with an index twice is."""
    from pyspark.sql import functions as F

    from seriescope.operators.ranges import Tree

    idx = [*range(3, 16), 16, 18, 19, 32, 32, 34, *range(48, 64)]
    points = spark.createDataFrame([("a", i, float(n)) for n, i in enumerate(idx)], "k string, idx long, v double")
    tree = Tree(points, {"n": ("count", F.col("v")), "hi": ("max", F.col("v"))}, ["k"], 16, 2)
    assert {r["__cell"]: r["__from"] for r in tree.blocks.collect()} == {0: 3, 1: None, 2: None, 3: 48}
    asked = [(a, b) for a in (0, 3, 5, 17, 32, 50, 63) for b in (2, 3, 9, 15, 18, 32, 33, 49, 63, 90)]
    got = tree.ask(spark.createDataFrame([("a", a, b) for a, b in asked], "k string, start_idx long, end_idx long")).collect()
    want = {(a, b): [n for n, i in enumerate(idx) if a <= i <= b] for a, b in asked}
    assert {(r.start_idx, r.end_idx): (r.n, r.hi) for r in got} == {k: (len(v), float(max(v))) for k, v in want.items() if v}


def test_a_session_makes_its_input_once(spark):
    """Every step of a session looks at points and candidates, however they came about."""
    from pyspark.sql import functions as F

    from seriescope.plans import session

    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        made.add(1)
        return x

    signal = spark.range(200, numPartitions=1).selectExpr("'d' as dataset", "'s' as signal_id", "id as idx", "cast(id % 2 as double) as x")
    spans = spark.createDataFrame([("d", "s", "C0001", 50, 50, 9.0), ("d", "s", "C0002", 120, 121, 1.0)], "dataset string, signal_id string, candidate_id string, start_idx long, end_idx long, x double")
    points, candidates = signal.withColumn("value", counted("x")).drop("x"), spans.withColumn("severity", counted("x")).drop("x")
    session.run_session(points, candidates, session.RuleReviewer())[1].collect()
    assert made.value == 202


def test_long_groups_are_narrowed_in_place(spark, monkeypatch):
    """Rows of a few long groups aren't shuffled to a task for each group, and pivots lie beside the wanted ranks."""
    from pyspark.sql import functions as F

    from seriescope.operators import quantiles

    plans, sizes, kept, narrowed = [], [], quantiles.materialise, quantiles._narrowed
    monkeypatch.setattr(quantiles, "materialise", lambda df: plans.append(plan_of(df)) or kept(df))
    monkeypatch.setattr(quantiles, "_narrowed", lambda *a: sizes.append(a[1].agg(F.max("__inside")).first()[0]) or narrowed(*a))
    df = kept(spark.range(60_000).selectExpr("id % 2 as k", "cast((id * 7919) % 30011 as double) as v"))
    want = {r.k: [r.m] for r in df.groupBy("k").agg(F.percentile("v", 0.5).alias("m")).collect()}
    assert {r.k: r.q for r in quantiles.order_statistics(df, F.col("v"), [0.5], ["k"], "q", limit=1000).collect()} == want
    assert sizes == [30_000]
    sketched = next(p for p in plans if "percentile_approx" in p)
    assert "BroadcastHashJoin" in sketched and sketched.count("Exchange hashpartitioning") <= 2


@pytest.mark.parametrize("policy", ["self_only", "non_overlap", "past_only_non_overlap"])
def test_references_are_counted_without_pairs(spark, policy):
    """How many references a window gets follows from starts, so the whole search isn't needed for it."""
    from seriescope.operators import retrieval

    v = spark.range(30).selectExpr("id as window_id", "id * 56 as start_idx", "array(1d, cast(id as double)) as vec")
    want = {r["query_id"]: r["count"] for r in retrieval.top_references(v, 224, 9, policy).groupBy("query_id").count().collect()}
    got = retrieval.reference_counts(v, 224, 9, policy)
    assert {r.query_id: r.n_refs for r in got.collect()} == want


@pytest.mark.parametrize("name", ["j7_no_reference", "j7_no_reference_all"])
def test_status_compares_no_vectors(spark, sf, name):
    assert "FlatMapGroupsInArrow" not in plan_of(QUERIES[name](spark, sf))
