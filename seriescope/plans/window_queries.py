"""Queries of tokens, retrieval and score maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriescope.operators import maps, metrics, retrieval, tokens
from seriescope.operators import windows as win
from seriescope.operators.common import materialise
from seriescope.operators.pruned import nearest_references
from seriescope.plans import views as V
from seriescope.plans.signal_queries import SHIP, add, cand_sql, out

LENGTH = 224
VEC = "vec as (select vec_id as id, vec_id * 56 as st, cast(embedding as double[]) as v from embeddings)"


def _audit_sql(valid: str, overlap: str, past: str) -> str:
    return f"""
with {VEC}
select q.id as query_id, cast(count(*) as bigint) as raw, cast(count(*) filter (r.st = q.st) as bigint) as self_excluded,
       cast(count(*) filter ({overlap}) as bigint) as overlap_excluded, cast(count(*) filter ({past}) as bigint) as past_excluded, cast(count(*) filter ({valid}) as bigint) as valid
from vec q, vec r group by q.id
"""


_OV = "(r.st < q.st + 224 and q.st < r.st + 224)"


def _audit(policy: str):  # noqa: ANN202
    def q(spark: SparkSession, d: str) -> DataFrame:
        return out(retrieval.validity_audit(V.vectors(spark, d), LENGTH, policy), "query_id", "raw", "self_excluded", "overlap_excluded", "past_excluded", "valid")

    return q


add("b9_reference_filter_self", _audit_sql("r.st <> q.st", "false", "false"))(_audit("self_only"))
add("b9_reference_filter_nonoverlap", _audit_sql(f"not {_OV}", f"{_OV} and r.st <> q.st", "false"))(_audit("non_overlap"))
add("b9_reference_filter_past", _audit_sql("r.st + 224 <= q.st", f"{_OV} and r.st <> q.st", f"not {_OV} and r.st > q.st"))(_audit("past_only_non_overlap"))


def top_sql(k: int, gap: int = 0) -> str:
    return f"""
with {VEC},
pairs as (select q.id as query_id, r.id as ref_id, round(list_cosine_similarity(q.v, r.v), 12) as sim from vec q, vec r where not {_OV} and abs(q.id - r.id) > {gap}),
top as (select *, row_number() over (partition by query_id order by sim desc, ref_id) as rank from pairs qualify rank <= {k})
"""


TOP_OUT = "select query_id, cast(rank as bigint) as rank, ref_id, round(sim, 6) as sim from top"


@add("b10_temporal_gap", top_sql(4, 9) + TOP_OUT)
def b10(spark: SparkSession, d: str) -> DataFrame:
    return out(retrieval.top_references(V.vectors(spark, d), LENGTH, 4, gap=9), "query_id", "rank", "ref_id", "sim")


@add("j1_cosine", f"with {VEC} select q.id as query_id, r.id as ref_id, round(list_cosine_similarity(q.v, r.v), 6) as sim from vec q, vec r where q.id % 100 = 0")
def j1(spark: SparkSession, d: str) -> DataFrame:
    v = V.vectors(spark, d)
    return out(retrieval.cosines(v.where("window_id % 100 = 0"), v), "query_id", "ref_id", "sim")


@add("j2_topk", f"""
with {VEC}, pairs as (select q.id as query_id, r.id as ref_id, round(list_cosine_similarity(q.v, r.v), 12) as sim from vec q, vec r where q.id <> r.id)
select query_id, cast(rank as bigint) as rank, ref_id, round(sim, 6) as sim from (select *, row_number() over (partition by query_id order by sim desc, ref_id) as rank from pairs) where rank <= 5
""")  # fmt: skip
def j2(spark: SparkSession, d: str) -> DataFrame:
    return out(retrieval.top_references(V.vectors(spark, d), LENGTH, 5, "self_only"), "query_id", "rank", "ref_id", "sim")


@add("j3_topk_references", top_sql(16) + TOP_OUT)
def j3(spark: SparkSession, d: str) -> DataFrame:
    return out(retrieval.top_references(V.vectors(spark, d), LENGTH, 16), "query_id", "rank", "ref_id", "sim")


@add("j3_pruned_references", top_sql(16) + TOP_OUT)
def j3b(spark: SparkSession, d: str) -> DataFrame:
    """The same references by pivots and bounds of angles."""
    return out(nearest_references(V.vectors(spark, d), LENGTH, 16), "query_id", "rank", "ref_id", "sim")


@add("j4_reference_audit", top_sql(16).replace(f"not {_OV}", "q.id <> r.id") + """
, a as (select v.id as query_id, t.ref_id, t.ref_id * 56 - v.id * 56 as off from vec v left join top t on t.query_id = v.id)
select query_id, cast(count(ref_id) as bigint) as n, cast(count(*) filter (abs(off) < 224) as bigint) as overlaps, round(count(*) filter (abs(off) < 224) / count(ref_id), 6) as overlap_rate,
  round(avg(greatest(0, 224 - abs(off)) / 224.0), 6) as mean_shared, cast(count(*) filter (abs(off) = 56) as bigint) as adjacent_1, cast(count(*) filter (abs(off) = 112) as bigint) as adjacent_2,
  cast(count(*) filter (abs(off) = 168) as bigint) as adjacent_3, count(ref_id) < 16 as shortage from a group by query_id
""")  # fmt: skip
def j4(spark: SparkSession, d: str) -> DataFrame:
    v = V.vectors(spark, d)
    a = retrieval.reference_audit(retrieval.top_references(v, LENGTH, 16, "self_only"), v, LENGTH, 16, 56)
    return out(a, "query_id", "n", "overlaps", "overlap_rate", "mean_shared", "adjacent_1", "adjacent_2", "adjacent_3", "shortage")


RETAIN_SQL = top_sql(16) + """
, long as (select query_id, rank, ref_id, unnest(range(1, 65)) as dim, unnest(v) as x from top join vec on vec.id = ref_id),
centre as (select query_id, dim, quantile_disc(x, 0.5) as c from long group by query_id, dim),
far as (select query_id, rank, ref_id, round(1 - sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))), 12) as distance from long join centre using (query_id, dim) group by query_id, rank, ref_id),
kept as (select *, row_number() over (partition by query_id order by distance, rank) as retained_rank from far qualify retained_rank <= 4)
"""


def _retained(spark: SparkSession, d: str) -> DataFrame:
    refs = retrieval.top_references(V.vectors(spark, d), LENGTH, 16)
    return retrieval.retain(refs, V.vectors(spark, d), 4)


@add("j5_retain", RETAIN_SQL + "select query_id, cast(rank as bigint) as rank, ref_id, cast(retained_rank as bigint) as retained_rank, round(distance, 6) as distance from kept")
def j5(spark: SparkSession, d: str) -> DataFrame:
    return out(_retained(spark, d), "query_id", "rank", "ref_id", "retained_rank", "distance")


@add("j6_patch_bank", RETAIN_SQL + """
, pt as (select id, p, v[p * 8 + 1 : p * 8 + 8] as pv from vec, range(8) t(p))
select q.id as query_id, cast(q.p as bigint) as patch_id, round(coalesce(0.5 * (1 - max(list_cosine_similarity(q.pv, r.pv))), 0), 6) as score
from pt q left join kept k on k.query_id = q.id left join pt r on r.id = k.ref_id group by q.id, q.p
""")  # fmt: skip
def j6(spark: SparkSession, d: str) -> DataFrame:
    return out(retrieval.patch_bank_scores(_retained(spark, d), V.patches(spark, d)), "query_id", "patch_id", "score")


@add("j7_no_reference", f"""
with {VEC}
select q.id as query_id, cast(least(count(r.id), 16) as bigint) as n_refs, case when count(r.id) > 0 then 'ok' else 'no_non_overlap_reference' end as status
from vec q left join vec r on r.st + 224 <= q.st group by q.id
""")  # fmt: skip
def j7(spark: SparkSession, d: str) -> DataFrame:
    """References from the past only: the first windows have none."""
    v = V.vectors(spark, d)
    refs = retrieval.reference_counts(v, LENGTH, 16, "past_only_non_overlap")
    return out(retrieval.reference_status(v.select(F.col("window_id").alias("query_id")), refs), "query_id", "n_refs", "status")


@add("j7_no_reference_all", f"""
with {VEC}
select q.id as query_id, cast(least(count(r.id), 16) as bigint) as n_refs, case when count(r.id) > 0 then 'ok' else 'no_non_overlap_reference' end as status
from vec q left join vec r on not {_OV} group by q.id
""")  # fmt: skip
def j7_all(spark: SparkSession, d: str) -> DataFrame:
    """References on both sides of a window."""
    v = V.vectors(spark, d)
    refs = retrieval.reference_counts(v, LENGTH, 16)
    return out(retrieval.reference_status(v.select(F.col("window_id").alias("query_id")), refs), "query_id", "n_refs", "status")


@add("t2_compare_references_all", RETAIN_SQL + """
, n as (select max(st) + 224 as n from vec),
p as (select distinct query_id, 'query' as panel, query_id * 56 + 111.5 as c from kept union all select query_id, 'r' || ref_id, ref_id * 56 + 111.5 from kept),
f as (select p.*, least(n, 224 + 128) as span, n from p, n), g as (select *, c - (span - 1) / 2.0 as raw from f),
h as (select *, case when raw - floor(raw) = 0.5 then 2 * round(raw / 2.0) else round(raw) end as lo0 from g)
select cast(query_id as bigint) as query_id, panel, cast(greatest(0, least(lo0, n - span)) as bigint) as lo, cast(greatest(0, least(lo0, n - span)) + span - 1 as bigint) as hi from h
""")  # fmt: skip
def t2_all(spark: SparkSession, d: str) -> DataFrame:
    """The retained references of every embedding beside it, from retrieval on."""
    from seriescope.operators.evidence import reference_id
    from seriescope.plans.tools import Registry, Tables

    signal = {"dataset": F.lit("made"), "signal_id": F.lit("embeddings")}
    w = V.vectors(spark, d).select("window_id", "start_idx").withColumns(signal)
    n = w.groupBy("dataset", "signal_id").agg((F.max("start_idx") + LENGTH).alias("n"))
    kept = materialise(_retained(spark, d)).withColumns(signal)
    asked = kept.select("dataset", "signal_id", reference_id(F.lit(LENGTH), F.col("query_id"), F.col("ref_id")).alias("reference_id"))
    r = Registry().dispatch("compare_references_visually", Tables(w, n, None, w, kept), asked, context="short")
    return out(r.rows, "query_id", "panel", "lo", "hi")


@add("t1_get_references_all", RETAIN_SQL + """
, focus as (select id as rid, st + id % 50 as start_idx, st + id % 50 + 30 + (id * 13) % 200 as end_idx from vec),
nr as (select rid, id as query_id from (select rid, id, row_number() over (partition by rid order by abs(st + 111.5 - (start_idx + end_idx) / 2.0), id) as o from focus, vec where abs(vec.id - rid) <= 9) where o = 1)
select rid, query_id, ref_id, cast(rank as bigint) as rank, cast(retained_rank as bigint) as retained_rank, 's224:q' || lpad(cast(query_id as varchar), 6, '0') || ':r' || lpad(cast(ref_id as varchar), 6, '0') as reference_id
from nr join kept using (query_id)
""")  # fmt: skip
def t1_all(spark: SparkSession, d: str) -> DataFrame:
    """A look beside every embedding's window, with the references that retrieval kept for the nearest one."""
    from seriescope.plans.tools import Registry, Tables

    signal = {"dataset": F.lit("made"), "signal_id": F.lit("embeddings")}
    w = V.vectors(spark, d).select("window_id", "start_idx").withColumns(signal)
    start = F.col("start_idx") + F.col("window_id") % 50
    asked = w.select("dataset", "signal_id", F.col("window_id").alias("rid"), start.alias("start_idx"), (start + 30 + (F.col("window_id") * 13) % 200).alias("end_idx"))
    r = Registry().dispatch("get_references", Tables(w, w, None, w, _retained(spark, d).withColumns(signal)), asked)
    return out(r.rows, "rid", "query_id", "ref_id", "rank", "retained_rank", "reference_id")


@add("t8_reference_screening_all", RETAIN_SQL + """
, pt as (select id, p, v[p * 8 + 1 : p * 8 + 8] as pv from vec, range(8) t(p)),
ps as (select q.id as query_id, q.p, coalesce(0.5 * (1 - max(list_cosine_similarity(q.pv, r.pv))), 0) as score from pt q left join kept k on k.query_id = q.id left join pt r on r.id = k.ref_id group by q.id, q.p),
tot as (select avg(score) as m, max(score) as x from ps)
select 's224:q' || lpad(cast(query_id as varchar), 6, '0') || ':r' || lpad(cast(ref_id as varchar), 6, '0') as reference_id, round(sim, 6) as similarity, round(m, 6) as mean, round(x, 6) as peak, 'ok' as status
from kept join top using (query_id, ref_id), tot
""")  # fmt: skip
def t8_all(spark: SparkSession, d: str) -> DataFrame:
    """Every retained reference of the embeddings: its similarity beside the patch scores of its scale."""
    from seriescope.operators.evidence import reference_id
    from seriescope.plans.tools import Registry, Tables

    signal = {"dataset": F.lit("made"), "signal_id": F.lit("embeddings"), "scale": F.lit(LENGTH)}
    refs = materialise(retrieval.top_references(V.vectors(spark, d), LENGTH, 16))
    kept = materialise(retrieval.retain(refs, V.vectors(spark, d), 4))
    scores = retrieval.patch_bank_scores(kept, V.patches(spark, d)).withColumns(signal)
    ids = kept.withColumns(signal).select("dataset", "signal_id", reference_id(F.lit(LENGTH), F.col("query_id"), F.col("ref_id")).alias("reference_id"))
    t = Tables(scores, scores, scores, nearest=refs.withColumns(signal))
    r = Registry().dispatch("get_screening_evidence", t, ids, target_type="reference")
    return out(r.rows, "reference_id", "similarity", "mean", "peak", "status")


@add("k3_query_trace_all", RETAIN_SQL + """
, pt as (select id, p, v[p * 8 + 1 : p * 8 + 8] as pv from vec, range(8) t(p)),
ps as (select q.id as query_id, q.p, coalesce(0.5 * (1 - max(list_cosine_similarity(q.pv, r.pv))), 0) as score from pt q left join kept k on k.query_id = q.id left join pt r on r.id = k.ref_id group by q.id, q.p),
pm as (select query_id, avg(score) as m, max(score) as x from ps group by query_id),
al as (select query_id, '[' || string_agg(cast(ref_id as varchar), ',' order by rank) || ']' as t, count(*) as n from top group by query_id),
kl as (select query_id, '[' || string_agg(cast(ref_id as varchar), ',' order by retained_rank) || ']' as t, '[' || string_agg(cast(rank as varchar), ',' order by retained_rank) || ']' as k, sum(distance) as s from kept group by query_id),
rg as (select id, id - 4 as a, id + 4 as b, (select max(id) from vec) as z, st from vec)
select id as query_window_id, st as query_start, st + 224 as query_end, case when al.n > 0 then 'ok' else 'no_non_overlap_reference' end as reference_status,
  '[' || concat_ws(',', case when a >= 0 then '[0,' || a || ']' end, case when b <= z then '[' || b || ',' || z || ']' end) || ']' as valid_reference_ranges,
  al.t as topk_indices, kl.t as retained_window_ids, kl.k as retained_ranks, round(kl.s, 6) as distances, round(pm.m, 6) as patch_score_mean, round(pm.x, 6) as patch_score_max
from rg left join al on al.query_id = id left join kl on kl.query_id = id left join pm on pm.query_id = id
""")  # fmt: skip
def k3_all(spark: SparkSession, d: str) -> DataFrame:
    """The trace of every embedding, from retrieval on; distances as their sum."""
    from seriescope.sources.cache import query_trace

    signal = {"dataset": F.lit("made"), "signal_id": F.lit("embeddings"), "scale": F.lit(LENGTH)}
    v = V.vectors(spark, d)
    # Both are read several times.
    refs = materialise(retrieval.top_references(v, LENGTH, 16))
    kept = materialise(retrieval.retain(refs, v, 4).drop("rank"))
    scores = retrieval.patch_bank_scores(kept, V.patches(spark, d)).withColumns(signal)
    t = query_trace(refs.join(kept, ["query_id", "ref_id"], "left").withColumns(signal), v.select("window_id", "start_idx").withColumns(signal), LENGTH, patch_scores=scores)
    total = F.aggregate(F.from_json("retained_distances", "array<double>"), F.lit(0.0), lambda a, x: a + x)
    return out(
        t, "query_window_id", "query_start", "query_end", "reference_status", "valid_reference_ranges", "topk_indices", "retained_window_ids", "retained_ranks",
        total.alias("distances"), "patch_score_mean", "patch_score_max",
    )


def memory_sql(extra: str) -> str:
    return f"""
with {VEC}, pt as (select id, p, v[p * 8 + 1 : p * 8 + 8] as pv from vec, range(8) t(p)),
el as (select p, unnest(range(1, 9)) as dim, unnest(pv) as x from pt),
md as (select p, dim, quantile_disc(x, 0.5) as x from el group by p, dim),
mem as (select p as mp, list(x order by dim) as mv from md group by p)
select id as window_id, cast(p as bigint) as patch_id, round(0.5 * min(1 - list_cosine_similarity(pv, mv)), 6) as score from pt, mem {extra} group by id, p
"""


@add("j8_median_memory", memory_sql(""))
def j8(spark: SparkSession, d: str) -> DataFrame:
    long = V.patches(spark, d).select("window_id", "patch_id", F.posexplode("vec").alias("dim", "value"))
    return out(retrieval.median_memory_scores(long), "window_id", "patch_id", "score")


@add("j8_median_memory_rows", memory_sql("where p // 3 = mp // 3"))
def j8b(spark: SparkSession, d: str) -> DataFrame:
    """Eight patches round to a board of side 3: rows 0-2, 3-5, 6-7."""
    long = V.patches(spark, d).select("window_id", "patch_id", F.posexplode("vec").alias("dim", "value"))
    return out(retrieval.median_memory_scores(long, row_wise=True), "window_id", "patch_id", "score")


@add("j9_nearest_window", cand_sql() + """
, w as (select signal_id, k as window_id, k * 56 as st from len, range(0, 100000) t(k) where k * 56 <= n - 224)
select signal_id, cast(seq as bigint) as focus_id, cast(window_id as bigint) as window_id from (select c.signal_id, seq, window_id, row_number() over (partition by c.signal_id, seq order by abs(st + 111.5 - (start_idx + end_idx) / 2.0), window_id) as rn from cand c join w on w.signal_id = c.signal_id) where rn = 1
""")  # fmt: skip
def j9(spark: SparkSession, d: str) -> DataFrame:
    """The window nearest to every candidate of the events."""
    s = V.sig_etype(spark, d)
    f = V.candidates(s).select("dataset", "signal_id", F.col("seq").alias("focus_id"), "start_idx", "end_idx")
    return out(retrieval.nearest_window(win.window_starts(V.lengths(s), [LENGTH]), f, LENGTH), "signal_id", "focus_id", "window_id")


@add("j10_reference_page", RETAIN_SQL + "select query_id, ref_id, cast(rank as bigint) as rank, cast(retained_rank as bigint) as retained_rank from kept where retained_rank > 1 and retained_rank <= 3")
def j10(spark: SparkSession, d: str) -> DataFrame:
    return out(retrieval.reference_page(_retained(spark, d), 1, 2), "query_id", "ref_id", "rank", "retained_rank")


# --- tokens ---------------------------------------------------------------------------------------

MASKS = """
masks as (select lev as level, (r * (14 - k + 1) + c) as group_id, (r + i) * 14 + c + j as cell_id
  from (values ('mid', 2), ('large', 3)) t(lev, k), range(0, 13) a(r), range(0, 13) b(c), range(0, 3) x(i), range(0, 3) y(j)
  where r <= 14 - k and c <= 14 - k and i < k and j < k)
"""


@add("d3_pool_masks", f"""
with {MASKS}, {VEC}, cells as (select id as window_id, c as cell_id, v[c % 64 + 1] as x from vec, range(0, 196) b(c)),
p as (select window_id, level, group_id, avg(x) as m from cells join masks using (cell_id) group by window_id, level, group_id)
select window_id, level, cast(count(*) as bigint) as pools, round(min(m), 6) as lo, round(max(m), 6) as hi from p group by window_id, level
""")  # fmt: skip
def d3(spark: SparkSession, d: str) -> DataFrame:
    """The pools of every embedding laid on the board: how many there are, their smallest and largest mean."""
    cells = V.vectors(spark, d).select("window_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(195)), lambda c: F.get("vec", c % 64))).alias("cell_id", "x"))
    means = cells.join(F.broadcast(tokens.pool_masks(spark)), "cell_id").groupBy("window_id", "level", "group_id").agg(F.avg("x").alias("m"))
    return out(means.groupBy("window_id", "level").agg(F.count("*").alias("pools"), F.min("m").alias("lo"), F.max("m").alias("hi")), "window_id", "level", "pools", "lo", "hi")


@add("d4_pool_tokens", f"""
with {VEC}, pt as (select id, p, v[p * 8 + 1 : p * 8 + 8] as pv from vec, range(8) t(p)),
el as (select id, p, unnest(range(0, 8)) as dim, unnest(pv) as x from pt),
mk as (select g as group_id, g + o as cell_id from range(0, 7) a(g), range(0, 2) b(o))
select id as window_id, 'pair' as level, cast(group_id as bigint) as group_id, cast(dim as bigint) as dim, round(avg(x), 6) as value from el join mk on p = cell_id group by id, group_id, dim
""")  # fmt: skip
def d4(spark: SparkSession, d: str) -> DataFrame:
    long = V.patches(spark, d).select("window_id", "patch_id", F.posexplode("vec").alias("dim", "value"))
    mask = spark.range(7).select(F.lit("pair").alias("level"), F.col("id").alias("group_id"), F.explode(F.array("id", F.col("id") + 1)).alias("cell_id"))
    return out(tokens.pool_tokens(long, mask), "window_id", "level", "group_id", "dim", "value")


@add("d5_class_token", f"""
with {VEC}, el as (select id, p, unnest(range(0, 8)) as dim, unnest(v[p * 8 + 1 : p * 8 + 8]) as x from vec, range(8) t(p))
select id as window_id, cast(dim as bigint) as dim, round(avg(x), 6) as value from el group by id, dim
""")  # fmt: skip
def d5(spark: SparkSession, d: str) -> DataFrame:
    long = V.patches(spark, d).select("window_id", "patch_id", F.posexplode("vec").alias("dim", "value"))
    return out(tokens.class_token(long), "window_id", "dim", "value")


@add("d7_tensor_stats", f"""
with {VEC}, el as (select id, unnest(v) as x from vec)
select id as window_id, cast(count(*) as bigint) as n, round(min(x), 6) as lo, round(max(x), 6) as hi, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std, false as has_nan, false as has_inf from el group by id
""")  # fmt: skip
def d7(spark: SparkSession, d: str) -> DataFrame:
    return out(metrics.tensor_stats(V.long_vectors(spark, d), by=["window_id"]), "window_id", "n", "lo", "hi", "mean", "std", "has_nan", "has_inf")


@add("d2_encode_windows")
def d2(spark: SparkSession, d: str) -> DataFrame:
    t = tokens.encode_windows(win.sliding_windows(V.sig_ship(spark, d)))
    return out(t, "scale", "window_id", "start_idx", *[F.size(c).alias(f"n_{c}") for c in ("patch", "mid", "large")])


# --- maps -----------------------------------------------------------------------------------------

#: Scores of pools and cells that follow from each embedding; small ones of pools are zero.
def _all_maps(level: str, pools: int) -> str:
    return f"""
{MASKS}, {VEC},
pools as (select id as window_id, g as group_id, case when abs(v[g % 64 + 1]) < 0.01 then 0 else abs(v[g % 64 + 1]) end as score from vec, range(0, {pools}) b(g)),
cells as materialized (select id as window_id, c as cell_id, abs(v[c % 64 + 1]) as score from vec, range(0, 196) b(c)),
spread as materialized (select p.window_id, k.cell_id - 1 as cell_id, p.score from pools p join masks k on k.level = '{level}' and k.group_id = p.group_id),
sums as materialized (select window_id, cell_id, case when count(*) filter (score = 0) > 0 then 0 else count(*) / sum(1 / nullif(score, 0)) end as score from spread group by window_id, cell_id),
har as materialized (select c.window_id, c.cell_id, case when s.window_id is null then 'nan'::double else s.score end as score from cells c left join sums s on s.window_id = c.window_id and s.cell_id = c.cell_id)
"""


ALL_MAPS, LARGE_MAPS = _all_maps("mid", 169), _all_maps("large", 144)


def _scored(spark: SparkSession, d: str, n: int, name: str) -> DataFrame:
    place = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    return V.vectors(spark, d).select("window_id", "vec", place).select("window_id", name, F.abs(F.get("vec", (F.col(name) % 64).cast("int"))).alias("score"))


def _harmonic_all(spark: SparkSession, d: str, level: str = "mid", pools: int = 169) -> DataFrame:
    mid = tokens.pool_masks(spark).where(F.col("level") == level).select("group_id", "cell_id")
    return maps.harmonic_cells(_scored(spark, d, pools, "group_id").withColumn("score", F.when(F.col("score") < 0.01, 0.0).otherwise(F.col("score"))), mid, by=["window_id"])


@add("m1_harmonic", f"with {LARGE_MAPS} select cast(window_id as bigint) as window_id, cast(cell_id as bigint) as cell_id, round(score, 6) as score from har where not isnan(score)")
def m1(spark: SparkSession, d: str) -> DataFrame:
    """Pools of 3 x 3 patches of every embedding; ``m1_harmonic_all`` takes those of 2 x 2."""
    return out(_harmonic_all(spark, d, "large", 144).where(~F.isnan("score")), "window_id", "cell_id", "score")


@add("m2_map_mean", f"""
with {LARGE_MAPS}
select cast(h.window_id as bigint) as window_id, cast(h.cell_id as bigint) as cell_id, round(case when isnan(h.score) then 0 else (h.score + 2 * b.score) / 3 end, 6) as score from har h join cells b using (window_id, cell_id)
""")  # fmt: skip
def m2(spark: SparkSession, d: str) -> DataFrame:
    base = _scored(spark, d, 196, "cell_id")
    return out(maps.mean_of_maps(base, base, _harmonic_all(spark, d, "large", 144), by=["window_id"]), "window_id", "cell_id", "score")


@add("m1_harmonic_all", f"with {ALL_MAPS} select cast(window_id as bigint) as window_id, cast(cell_id as bigint) as cell_id, round(score, 6) as score from har where not isnan(score)")
def m1_all(spark: SparkSession, d: str) -> DataFrame:
    return out(_harmonic_all(spark, d).where(~F.isnan("score")), "window_id", "cell_id", "score")


@add("m2_map_mean_all", f"""
with {ALL_MAPS}
select cast(h.window_id as bigint) as window_id, cast(h.cell_id as bigint) as cell_id, round(case when isnan(h.score) then 0 else (h.score + 2 * b.score) / 3 end, 6) as score from har h join cells b using (window_id, cell_id)
""")  # fmt: skip
def m2_all(spark: SparkSession, d: str) -> DataFrame:
    base = _scored(spark, d, 196, "cell_id")
    return out(maps.mean_of_maps(base, base, _harmonic_all(spark, d), by=["window_id"]), "window_id", "cell_id", "score")


def _resized_sql(size: int) -> str:
    """A 14 x 14 map of each embedding resized, then the mean of the top quarter of each column."""
    return f"""
with {VEC}, g as (select id as window_id, k // 14 as r, k % 14 as c, abs(v[k % 64 + 1]) as v from vec, range(0, 196) t(k)),
ax as (select o, greatest((o + 0.5) * 14 / {size}.0 - 0.5, 0) as x from range(0, {size}) t(o)),
w as (select o, cast(least(floor(x), 13) as int) as lo, cast(least(floor(x) + 1, 13) as int) as hi, x - floor(x) as f from ax),
big as (select g1.window_id, a.o as r, b.o as c, (1 - a.f) * ((1 - b.f) * g1.v + b.f * g2.v) + a.f * ((1 - b.f) * g3.v + b.f * g4.v) as v
  from w a cross join w b join g g1 on g1.r = a.lo and g1.c = b.lo join g g2 on g2.window_id = g1.window_id and g2.r = a.lo and g2.c = b.hi
  join g g3 on g3.window_id = g1.window_id and g3.r = a.hi and g3.c = b.lo join g g4 on g4.window_id = g1.window_id and g4.r = a.hi and g4.c = b.hi),
rk as (select window_id, c, v, row_number() over (partition by window_id, c order by v desc) as n from big)
select cast(window_id as bigint) as window_id, cast(c as bigint) as col, round(avg(v), 6) as score from rk where n <= {size // 4} group by window_id, c
"""


def _resized(spark: SparkSession, d: str, size: int) -> DataFrame:
    v = maps.column_scores(_scored(spark, d, 196, "cell_id"), size=size, by=["window_id"])
    return out(v.select("window_id", F.posexplode("vals").alias("col", "score")), "window_id", "col", "score")


@add("m3_resize_reduce", _resized_sql(20))
def m3(spark: SparkSession, d: str) -> DataFrame:
    return _resized(spark, d, 20)


@add("m3_resize_reduce_all", _resized_sql(28))
def m3_all(spark: SparkSession, d: str) -> DataFrame:
    return _resized(spark, d, 28)


WV = f"{SHIP}, n as (select count(*) as n from ship), w as (select k as window_id, k * 56 as st from n, range(0, 100000) t(k) where k * 56 <= n - 224), wv as (select window_id, idx - st as j, value from w join ship on idx >= st and idx < st + 224)"


@add("m4_top_quarter", f"with {WV}, rk as (select window_id, value, row_number() over (partition by window_id order by value desc) as n from wv) select cast(window_id as bigint) as window_id, round(avg(value), 6) as score from rk where n <= 56 group by window_id")
def m4(spark: SparkSession, d: str) -> DataFrame:
    return out(win.sliding_windows(V.sig_ship(spark, d), [LENGTH]), "window_id", maps.top_share_mean(F.col("vals")).alias("score"))


STITCH = f"{WV}, st as (select 56 * window_id + j as pos, avg(value * (1 + j / 224.0)) as score from wv group by 1)"


def _stitched(spark: SparkSession, d: str) -> DataFrame:
    w = win.sliding_windows(V.sig_ship(spark, d), [LENGTH])
    return maps.stitch(w.withColumn("vals", F.transform("vals", lambda v, j: v * (1 + j / 224.0))))


@add("m5_stitch", f"with {STITCH} select cast(pos as bigint) as pos, round(score, 6) as score from st")
def m5(spark: SparkSession, d: str) -> DataFrame:
    return out(_stitched(spark, d), "pos", "score")


#: The stitched vector of 224-windows stretched as if it came from windows of 448 at steps of 112.
ALIGN = f"""
with {STITCH}, dim as (select max(pos) + 1 as l, (select count(*) from w) as m from st), c as (select l, 448 + (m - 1) * 112 as cov from dim),
grid as (select k, k * (l - 1) / (cov - 1.0) as x, l, cov from c, range(0, 100000) t(k) where k < cov),
v as (select k, cov, a.score + (coalesce(b.score, a.score) - a.score) * (x - floor(x)) as y from grid join st a on a.pos = cast(least(floor(x), l - 1) as bigint) left join st b on b.pos = a.pos + 1),
sl as (select max(y) filter (k = cov - 1) as y1, max(y) filter (k = cov - 2) as y0, max(cov) as cov from v)
"""


@add("m6_align", ALIGN + "select cast(k as bigint) as idx, round(y, 5) as score from v where k < 4000")
def m6(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d, 4000)


@add("m6_align_extrapolate", ALIGN + "select cast(k as bigint) as idx, round(y, 5) as score from v union all select k, round(y1 + (y1 - y0) * (k - cov + 1), 5) from sl, range(0, 7000) t(k) where k >= cov")
def m6b(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d, 7000)


def _aligned(spark: SparkSession, d: str, n: int) -> DataFrame:
    count = win.window_starts(V.lengths(V.sig_ship(spark, d)), [LENGTH]).groupBy("dataset", "signal_id").agg(F.count("*").alias("windows"))
    shape = count.select("dataset", "signal_id", F.lit(224).alias("scale"), F.lit(n).alias("n"), F.lit(448).alias("size"), F.lit(112).alias("step"), "windows")
    a = maps.align(_stitched(spark, d).drop("scale"), shape.drop("scale"))
    return a.select(F.col("idx").cast("long").alias("idx"), F.round("score", 5).alias("score"))


@add("m7_trace_summary", f"with {WV} select cast(window_id as bigint) as window_id, round(avg(value), 6) as mean, round(max(value), 6) as max from wv group by window_id")
def m7(spark: SparkSession, d: str) -> DataFrame:
    return out(maps.trace_summary(win.sliding_windows(V.sig_ship(spark, d), [LENGTH])), "window_id", "mean", "max")
