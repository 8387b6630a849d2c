"""Queries of cleaning, windows, decisions and intervals, with SQL written from their definitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriescope.functions.numeric import finite_or
from seriescope.operators import clean, decision, intervals, windows
from seriescope.operators.common import materialise
from seriescope.plans import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Signals in SQL.
SHIP = "ship as (select 'tpch' as dataset, 'ship' as signal_id, row_number() over (order by l_shipdate) - 1 as idx, l_shipdate as ts, sum(l_quantity) as value from lineitem group by l_shipdate)"
ORDER = "orderv as (select 'tpch' as dataset, 'order' as signal_id, row_number() over (order by o_orderdate) - 1 as idx, o_orderdate as ts, round(sum(o_totalprice), 2) as value from orders group by o_orderdate)"
ETYPE = "etype as (select 'events' as dataset, event_type as signal_id, row_number() over (partition by event_type order by ts, event_id) - 1 as idx, ts, value from events)"
EVENTS = "ev as (select 'all' as signal_id, row_number() over (order by ts, event_id) - 1 as idx, ts, value, cast(event_type = 'error' as int) as label from events)"
USERS = "users as (select cast(user_id as varchar) as signal_id, row_number() over (partition by user_id order by ts, event_id) - 1 as idx, value from events)"
Z = {0.1: "1.2815515655446008", 0.01: "2.3263478740408408", 0.001: "3.090232306167813"}


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and its SQL."""

    def put(q: Query) -> Query:
        QUERIES[name] = q
        if sql is not None:
            # A negative zero becomes a zero, here and in ``out``.
            SQL[name] = sql.replace(", 6) as ", ", 6) + 0.0 as ").replace(", 5) as ", ", 5) + 0.0 as ")
        return q

    return put


def r(c: str | Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def out(df: DataFrame, *cols: str | Column) -> DataFrame:
    """Columns, whole numbers as long and other numbers rounded."""
    picked = df.select(*cols)
    kinds = {"int": "bigint", "smallint": "bigint", "bigint": "bigint"}
    return picked.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c).cast(kinds[t]).alias(c) if t in kinds else F.col(c) for c, t in picked.dtypes])


# --- cleaning -------------------------------------------------------------------------------------


@add("b1_time_index", f"with {ETYPE} select signal_id, cast(idx as bigint) as idx, round(value, 6) as value from etype")
def b1(spark: SparkSession, d: str) -> DataFrame:
    return out(V.sig_etype(spark, d), "signal_id", "idx", "value")


B2_SQL = f"""
with {ETYPE},
holes as (select signal_id, idx, case when idx % 17 in (0, 1, 5) then null else value end as v from etype),
known as (select * from holes where v is not null),
p as (select h.signal_id, h.idx, k.idx as i0, k.v as v0 from holes h asof left join known k on h.signal_id = k.signal_id and h.idx >= k.idx),
n as (select h.signal_id, h.idx, k.idx as i1, k.v as v1 from holes h asof left join known k on h.signal_id = k.signal_id and h.idx <= k.idx)
select signal_id, cast(idx as bigint) as idx,
       round(case when v0 is null then v1 when v1 is null or i0 = i1 then v0 else v0 + (v1 - v0) * (idx - i0) / (i1 - i0) end, 6) as value
from p join n using (signal_id, idx)
"""


@add("b2_interpolate", B2_SQL)
def b2(spark: SparkSession, d: str) -> DataFrame:
    s = V.sig_etype(spark, d).withColumn("value", F.when(~(F.col("idx") % 17).isin(0, 1, 5), F.col("value").cast("string")).otherwise("n/a"))
    return out(clean.interpolate(s.withColumn("value", clean.to_number(F.col("value")))), "signal_id", "idx", "value")


@add("b3_label_clip", f"""
with {ETYPE}
select signal_id, cast(idx as bigint) as idx, cast(case idx % 6 when 0 then 1 when 1 then 0 when 2 then 1 when 3 then 0 when 4 then 0 else 0 end as bigint) as label from etype
""")  # fmt: skip
def b3(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(x) for x in ("1", "0", "2.7", "-3", "x", "0.9")]), (F.col("idx") % 6 + 1).cast("int"))
    return out(V.sig_etype(spark, d), "signal_id", "idx", clean.clip_label(raw).alias("label"))


@add("b4_missing_time", "select cast(rn as bigint) as idx, cast(rn as bigint) as ts, round(value, 6) as value from (select row_number() over (order by event_id) - 1 as rn, value from events)")
def b4(spark: SparkSession, d: str) -> DataFrame:
    from seriescope.sources.signals import normalise

    raw = V.table(spark, d, "events").select(F.lit("events").alias("dataset"), F.lit("all").alias("signal_id"), "event_id", "value")
    return out(normalise(raw, "event_id"), "idx", "ts", "value")


@add("b5_detrend", f"""
with {ETYPE}, fit as (select signal_id, regr_slope(value, idx) as a, regr_intercept(value, idx) as b from etype group by signal_id)
select signal_id, cast(idx as bigint) as idx, round(value - (a * idx + b), 6) as value from etype join fit using (signal_id)
""")  # fmt: skip
def b5(spark: SparkSession, d: str) -> DataFrame:
    return out(clean.detrend(V.sig_etype(spark, d)), "signal_id", "idx", "value")


@add("b6_minmax", f"""
with {ETYPE}
select signal_id, cast(idx as bigint) as idx, round(coalesce((value - min(value) over w) / nullif(max(value) over w - min(value) over w, 0), 0), 6) as value
from etype window w as (partition by signal_id)
""")  # fmt: skip
def b6(spark: SparkSession, d: str) -> DataFrame:
    return out(clean.minmax(V.sig_etype(spark, d)), "signal_id", "idx", "value")


@add("b7_area_resample", f"""
with {SHIP}, n as (select count(*) as n from ship),
bins as (select b as bin, b * n / 224.0 as lo, (b + 1) * n / 224.0 as hi from n, range(224) as t(b))
select cast(bin as bigint) as bin, round(sum(value * (least(idx + 1, hi) - greatest(idx, lo))) / min(hi - lo), 6) as value
from bins join ship on idx < hi and idx + 1 > lo group by bin
""")  # fmt: skip
def b7(spark: SparkSession, d: str) -> DataFrame:
    return out(clean.area_resample(V.sig_ship(spark, d)), "bin", "value")


@add("b8_nonfinite_zero", f"with {ETYPE} select signal_id, cast(idx as bigint) as idx, round(case when idx % 13 in (2, 5, 7) then 0 else value end, 6) as value from etype")
def b8(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("idx") % 13
    bad = F.when(k == 2, F.lit(float("nan"))).when(k == 5, F.lit(float("inf"))).when(k == 7, F.lit(float("-inf"))).otherwise(F.col("value"))
    return out(V.sig_etype(spark, d), "signal_id", "idx", finite_or(bad, 0.0).alias("value"))


@add("b15_nonfinite_null", f"with {ETYPE} select signal_id, cast(count(*) as bigint) as n, cast(count(*) filter (idx % 13 in (2, 5, 7)) as bigint) as nulls from etype group by signal_id")
def b15(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("idx") % 13
    bad = F.when(k == 2, F.lit(float("nan"))).when(k == 5, F.lit(float("inf"))).when(k == 7, F.lit(float("-inf"))).otherwise(F.col("value"))
    s = V.sig_etype(spark, d).withColumn("v", finite_or(bad, None))
    return out(s.groupBy("signal_id").agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("nulls")), "signal_id", "n", "nulls")


@add("b11_roster_semi", f"with {USERS} select signal_id, cast(count(*) as bigint) as n from users where cast(signal_id as bigint) % 3 = 0 group by signal_id")
def b11(spark: SparkSession, d: str) -> DataFrame:
    s = V.sig_user(spark, d)
    roster = s.select("dataset", "signal_id").distinct().where(F.col("signal_id").cast("long") % 3 == 0)
    return out(s.join(roster, ["dataset", "signal_id"], "left_semi").groupBy("signal_id").agg(F.count("*").alias("n")), "signal_id", "n")


@add("b11_done_anti", f"with {USERS} select signal_id, cast(count(*) as bigint) as n from users where cast(signal_id as bigint) % 4 <> 0 group by signal_id")
def b11b(spark: SparkSession, d: str) -> DataFrame:
    s = V.sig_user(spark, d)
    done = s.select("dataset", "signal_id").distinct().where(F.col("signal_id").cast("long") % 4 == 0)
    return out(s.join(done, ["dataset", "signal_id"], "left_anti").groupBy("signal_id").agg(F.count("*").alias("n")), "signal_id", "n")


# --- windows --------------------------------------------------------------------------------------

WINDOWS_SQL = f"""
with {SHIP}, n as (select count(*) as n from ship),
w as (select s as scale, k as window_id, k * (s // 4) as start_idx from n, (values (224), (448), (672)) as t(s), range(0, 100000) as g(k) where k * (s // 4) <= n - s and n >= s)
"""


@add("c1_sliding_windows", WINDOWS_SQL + """
select cast(scale as bigint) as scale, cast(window_id as bigint) as window_id, cast(start_idx as bigint) as start_idx,
       round(avg(value), 6) as mean, round(min(value), 6) as lo, round(max(value), 6) as hi
from w join ship on idx >= start_idx and idx < start_idx + scale group by all
""")  # fmt: skip
def c1(spark: SparkSession, d: str) -> DataFrame:
    w = windows.sliding_windows(V.sig_ship(spark, d))
    mean = F.aggregate("vals", F.lit(0.0), lambda s, x: s + x) / F.size("vals")
    return out(w, "scale", "window_id", "start_idx", mean.alias("mean"), F.array_min("vals").alias("lo"), F.array_max("vals").alias("hi"))


@add("c2_window_sample", WINDOWS_SQL + """
, c as (select scale, max(window_id) as last from w group by scale),
k as (select scale, cast(floor(j * last / 7.0) as bigint) as window_id from c, range(8) as t(j) where last >= 8 union select scale, j from c, range(8) as t(j) where last < 8 and j <= last)
select distinct cast(w.scale as bigint) as scale, cast(w.window_id as bigint) as window_id, cast(start_idx as bigint) as start_idx from w join k on w.scale = k.scale and w.window_id = k.window_id
""")  # fmt: skip
def c2(spark: SparkSession, d: str) -> DataFrame:
    w = windows.window_starts(V.lengths(V.sig_ship(spark, d)))
    return out(windows.sample_windows(w, 8), "scale", "window_id", "start_idx")


def cand_sql(alpha: float = 0.1, view: str = "etype", cte: str = ETYPE) -> str:
    return f"""
with {cte},
thr as (select signal_id, avg(value) + {Z[alpha]} * stddev_pop(value) as thr from {view} group by signal_id),
hits as (select signal_id, idx, value, idx - row_number() over (partition by signal_id order by idx) as grp from {view} join thr using (signal_id) where value > thr),
iv as (select signal_id, min(idx) as start_idx, max(idx) as end_idx, avg(value) as severity from hits group by signal_id, grp),
cand as (select *, row_number() over (partition by signal_id order by start_idx) as seq from iv),
len as (select signal_id, count(*) as n from {view} group by signal_id)
"""


#: Where a cut at ``at`` goes if a run of candidates covers it: before the run, else behind it.
def _free_sql(at: str, low: str, high: str) -> str:
    return f"case when c.start_idx - 1 >= {low} then c.start_idx - 1 when c.end_idx + 1 <= {high} then c.end_idx + 1 else {at} end"


@add("c3_assessment_plan", "with recursive " + cand_sql(0.01, "ev", EVENTS).lstrip().removeprefix("with ") + f"""
, w as (
  select cast(1 as bigint) as k, cast(0 as bigint) as s, least(n - 1, 3999) as e, n - 1 as top from len where n <= 4000
  union all select 1, 0, greatest(3999, {_free_sql("3999", "0", "least(n - 1, 4399)")}), n - 1 from len left join cand c on 3999 between c.start_idx and c.end_idx where n > 4000
  union all select k + 1, e - 399, case when e + 3600 >= top then top else greatest(e + 3600, {_free_sql("e + 3600", "e - 399", "least(top, e + 4000)")}) end, top
    from w left join cand c on e + 3600 between c.start_idx and c.end_idx where e < top),
m as (select *, lead(s) over (order by k) as nx from w), q as (select *, (e + nx) // 2 as mid from m),
f as (select k, s, e, coalesce({_free_sql("mid", "nx", "e")}, e) as core_end from q left join cand c on mid between c.start_idx and c.end_idx)
select k as "window", s as start_idx, e as end_idx, coalesce(lag(core_end) over (order by k), 0) as core_start, core_end from f
""")  # fmt: skip
def c3(spark: SparkSession, d: str) -> DataFrame:
    s = V.sig_events(spark, d)
    return out(windows.assessment_windows(V.lengths(s), V.candidates(s, 0.01), 4000, 400), "window", "start_idx", "end_idx", "core_start", "core_end")


@add("c4_home_window", cand_sql() + """
, w as (select signal_id, k + 1 as win, k * 300 as core_start, case when (k + 1) * 300 >= n then n - 1 else (k + 1) * 300 - 1 end as core_end from len, range(0, 100000) as t(k) where k * 300 < n)
select c.signal_id, cast(c.seq as bigint) as seq, cast(coalesce(min(w.win), 1) as bigint) as home
from cand c left join w on c.signal_id = w.signal_id and (c.start_idx + c.end_idx) // 2 between core_start and core_end group by c.signal_id, c.seq
""")  # fmt: skip
def c4(spark: SparkSession, d: str) -> DataFrame:
    s = V.sig_etype(spark, d)
    n = V.lengths(s).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 300).cast("int"))))
    w = n.select("dataset", "signal_id", (F.col("k") + 1).alias("window"), (F.col("k") * 300).alias("core_start"), F.least((F.col("k") + 1) * 300 - 1, F.col("n") - 1).alias("core_end"))
    return out(windows.home_windows(V.candidates(s), w), "signal_id", "seq", F.col("window").alias("home"))


@add("c5_render_profile", f"""
with {USERS}, len as (select signal_id, count(*) * 100 as n from users group by signal_id)
select signal_id, case when n < 4000 then 'short' when n < 10000 then 'medium' when n < 15000 then 'long_medium' when n <= 20000 then 'long' else 'ultra_long' end as kind,
       cast(case when n < 4000 then 3072 when n < 10000 then 4096 when n < 15000 then 5120 when n <= 20000 then 6000 else 4096 end as bigint) as cols from len
""")  # fmt: skip
def c5(spark: SparkSession, d: str) -> DataFrame:
    n = V.lengths(V.sig_user(spark, d)).withColumn("p", windows.render_profile(F.col("n") * 100))
    return out(n, "signal_id", F.col("p.kind").alias("kind"), F.col("p.columns").alias("cols"))


@add("c6_centered_range", cand_sql() + """
, q as (select signal_id, seq, n, least(101, n) as span, (start_idx + end_idx) / 2.0 as mid from cand join len using (signal_id)),
f as (select *, mid - (span - 1) / 2.0 as raw from q),
g as (select *, case when raw - floor(raw) = 0.5 then 2 * round(raw / 2.0) else round(raw) end as lo0 from f)
select signal_id, cast(seq as bigint) as seq, cast(greatest(0, least(lo0, n - span)) as bigint) as lo, cast(greatest(0, least(lo0, n - span)) + span - 1 as bigint) as hi from g
""")  # fmt: skip
def c6(spark: SparkSession, d: str) -> DataFrame:
    s = V.sig_etype(spark, d)
    c = V.candidates(s).join(V.lengths(s), ["dataset", "signal_id"]).withColumn("x", windows.centred_range((F.col("start_idx") + F.col("end_idx")) / 2.0, F.lit(101), F.col("n")))
    return out(c, "signal_id", "seq", F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi"))


# --- decisions ------------------------------------------------------------------------------------


def z_sql(view: str, by: str = "signal_id") -> str:
    return f"""
m as (select {by}, median(value) as med, stddev_pop(value) as sd from {view} group by {by}),
a as (select {by}, median(abs(value - med)) as mad from {view} join m using ({by}) group by {by}),
zed as (select {view}.*, greatest(0, case when mad >= 1e-12 then (value - med) / (1.4826 * mad + 1e-12) when sd >= 1e-12 then (value - med) / (sd + 1e-12) else 0 end) as z
        from {view} join m using ({by}) join a using ({by}))
"""


@add("n1_robust_positive_z", f"with {ETYPE}, {z_sql('etype')} select signal_id, cast(idx as bigint) as idx, round(z, 6) as score from zed")
def n1(spark: SparkSession, d: str) -> DataFrame:
    return out(decision.robust_positive_z(V.sig_etype(spark, d), "value"), "signal_id", "idx", F.col("value").alias("score"))


@add("n2_fuse", f"""
with {ETYPE}, s3 as (select signal_id || '/' || s as sid, signal_id, idx, s, case s when 224 then value when 448 then value * value else abs(value - 10) end as value from etype, (values (224), (448), (672)) t(s)),
{z_sql('s3', 'sid')}
select signal_id, cast(idx as bigint) as idx, round(sum(z * case s when 224 then 0.5 when 448 then 0.25 else 0.25 end), 6) as score from zed group by signal_id, idx
""")  # fmt: skip
def n2(spark: SparkSession, d: str) -> DataFrame:
    s = V.sig_etype(spark, d).withColumn("scale", F.explode(F.array(F.lit(224), F.lit(448), F.lit(672))))
    v = F.col("value")
    s = s.withColumn("score", F.when(F.col("scale") == 224, v).when(F.col("scale") == 448, v * v).otherwise(F.abs(v - 10)))
    return out(decision.fuse_scales(s, {224: 2, 448: 1, 672: 1}), "signal_id", "idx", "score")


def ewma_sql(view: str) -> str:
    """Smoothed scores by the recursive definition in closed sums; a series shorter than 200 isn't smoothed."""
    return f"""
sp as (select signal_id, count(*) as n, 2.0 / (greatest(1, floor(count(*) * 0.01)) + 1) as al from {view} group by signal_id),
sm as (select signal_id, idx, ts, value as raw, case when al >= 1 then value else
  sum(case when al < 1 then value * pow(1 - al, -idx) end) over w / sum(case when al < 1 then pow(1 - al, -idx) end) over w end as value
  from {view} join sp using (signal_id) window w as (partition by signal_id order by idx rows between unbounded preceding and current row))
"""


@add("n3_ewma", f"with {ETYPE}, {ewma_sql('etype')} select signal_id, cast(idx as bigint) as idx, round(value, 6) as score from sm")
def n3(spark: SparkSession, d: str) -> DataFrame:
    return out(decision.ewma(V.sig_etype(spark, d), "value"), "signal_id", "idx", F.col("value").alias("score"))


@add("n4_threshold_mean", f"""
with {ETYPE}, t as (select signal_id, avg(value) + {Z[0.01]} * stddev_pop(value) as thr from etype group by signal_id)
select signal_id, round(min(thr), 6) as threshold, cast(count(*) filter (value > thr) as bigint) as n_flagged from etype join t using (signal_id) group by signal_id
""")  # fmt: skip
def n4(spark: SparkSession, d: str) -> DataFrame:
    p = decision.threshold_flags(V.sig_etype(spark, d), 0.01, score="value")
    return out(p.groupBy("signal_id").agg(F.min("threshold").alias("threshold"), F.count_if("flag").alias("n_flagged")), "signal_id", "threshold", "n_flagged")


@add("n4_threshold_median", f"""
with {ETYPE}, m as (select signal_id, median(value) as med from etype group by signal_id),
t as (select signal_id, min(med) + {Z[0.01]} * median(abs(value - med)) as thr from etype join m using (signal_id) group by signal_id)
select signal_id, round(min(thr), 6) as threshold, cast(count(*) filter (value > thr) as bigint) as n_flagged from etype join t using (signal_id) group by signal_id
""")  # fmt: skip
def n4b(spark: SparkSession, d: str) -> DataFrame:
    p = decision.threshold_flags(V.sig_etype(spark, d), 0.01, "median", "value")
    return out(p.groupBy("signal_id").agg(F.min("threshold").alias("threshold"), F.count_if("flag").alias("n_flagged")), "signal_id", "threshold", "n_flagged")


@add("n5_sliding_threshold", f"""
with {ETYPE}, n as (select signal_id, count(*) as n, greatest(1, count(*) // 3) as win, greatest(1, count(*) // 10) as step from etype group by signal_id),
w as (select signal_id, k * step as a, least(k * step + win, n) as b from n, range(0, 40) t(k) where k * step < n),
s as (select w.signal_id, w.a, w.b, avg(value) + {Z[0.01]} * stddev_pop(value) as thr from w join etype e on e.signal_id = w.signal_id and idx >= a and idx < b group by w.signal_id, w.a, w.b)
select e.signal_id, cast(e.idx as bigint) as idx, bool_or(value > thr) as flag from etype e join s on e.signal_id = s.signal_id and idx >= a and idx < b group by e.signal_id, e.idx
""")  # fmt: skip
def n5(spark: SparkSession, d: str) -> DataFrame:
    return out(decision.sliding_flags(V.sig_etype(spark, d), 0.01, score="value"), "signal_id", "idx", "flag")


@add("n6_intervals", cand_sql() + "select signal_id, cast(start_idx as bigint) as start_idx, cast(end_idx as bigint) as end_idx from iv")
def n6(spark: SparkSession, d: str) -> DataFrame:
    return out(V.candidates(V.sig_etype(spark, d)), "signal_id", "start_idx", "end_idx")


@add("n7_pad_merge", cand_sql() + """
, marks as (select distinct iv.signal_id, g as idx from iv join len using (signal_id), unnest(range(greatest(0, start_idx - 3), least(n - 1, end_idx + 3) + 1)) t(g)),
runs as (select signal_id, idx, idx - row_number() over (partition by signal_id order by idx) as grp from marks)
select signal_id, cast(min(idx) as bigint) as start_idx, cast(max(idx) as bigint) as end_idx from runs group by signal_id, grp
""")  # fmt: skip
def n7(spark: SparkSession, d: str) -> DataFrame:
    s = V.sig_etype(spark, d)
    return out(intervals.pad_intervals(V.candidates(s).drop("seq", "candidate_id"), V.lengths(s), 3), "signal_id", "start_idx", "end_idx")


DECIDE_SQL = """
t as (select signal_id, avg(value) + {z} * stddev_pop(value) as thr from sm group by signal_id),
h as (select signal_id, idx, value, ts, idx - row_number() over (partition by signal_id order by idx) as grp from sm join t using (signal_id) where value > thr)
select signal_id, cast(min(idx) as bigint) as start_idx, cast(max(idx) as bigint) as end_idx, round(avg(value), 6) as severity from h group by signal_id, grp
"""


@add("n8_decide", f"with {ETYPE}, {ewma_sql('etype')}, {DECIDE_SQL.format(z=Z[0.01])}")
def n8(spark: SparkSession, d: str) -> DataFrame:
    points, found = decision.decide(V.sig_etype(spark, d), 0.01, score="value")
    return out(intervals.interval_bounds(points, found, score="value"), "signal_id", "start_idx", "end_idx", "severity")


@add("n9_percentile_intervals", f"""
with {ETYPE}, t as (select signal_id, quantile_cont(value, 0.99) as thr from etype group by signal_id),
h as (select signal_id, idx, value, ts, idx - row_number() over (partition by signal_id order by idx) as grp from etype join t using (signal_id) where value > thr)
select signal_id, cast(min(idx) as bigint) as start_idx, cast(max(idx) as bigint) as end_idx, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as end_ts, round(avg(value), 6) as severity
from h group by signal_id, grp
""")  # fmt: skip
def n9(spark: SparkSession, d: str) -> DataFrame:
    p = intervals.percentile_intervals(V.sig_etype(spark, d), "value")
    when = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start_ts", "end_ts")]
    return out(p, "signal_id", "start_idx", "end_idx", *when, "severity")


@add("n10_merge_intervals", cand_sql() + """
, wide as (select signal_id, start_idx, end_idx + seq % 4 as end_idx, severity from cand),
o as (select *, max(end_idx) over (partition by signal_id order by start_idx rows between unbounded preceding and 1 preceding) as seen from wide),
g as (select *, sum(case when seen is null or start_idx > seen + 1 then 1 else 0 end) over (partition by signal_id order by start_idx) as grp from o)
select signal_id, cast(min(start_idx) as bigint) as start_idx, cast(max(end_idx) as bigint) as end_idx, round(avg(severity), 6) as severity from g group by signal_id, grp
""")  # fmt: skip
def n10(spark: SparkSession, d: str) -> DataFrame:
    s = V.sig_etype(spark, d)
    sev = intervals.interval_bounds(s, V.candidates(s), score="value").withColumn("end_idx", F.col("end_idx") + F.col("seq") % 4)
    return out(intervals.merge_intervals(sev, None, F.avg("severity").alias("severity")), "signal_id", "start_idx", "end_idx", "severity")


@add("n11_interval_bounds", cand_sql() + """
, clipped as (select signal_id, seq, least(n - 1, end_idx + 4) as b, greatest(0, start_idx - 4) as a from cand join len using (signal_id))
select signal_id, cast(seq as bigint) as seq, cast(a as bigint) as start_idx, cast(b as bigint) as end_idx, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as end_ts, round(avg(value), 6) as severity
from clipped c join etype e using (signal_id) where idx between a and b group by signal_id, seq, a, b
""")  # fmt: skip
def n11(spark: SparkSession, d: str) -> DataFrame:
    s = V.sig_etype(spark, d)
    swapped = V.candidates(s).withColumns({"end_idx": F.col("start_idx") - 4, "start_idx": F.col("end_idx") + 4})
    when = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start_ts", "end_ts")]
    return out(intervals.interval_bounds(s, swapped, score="value"), "signal_id", "seq", "start_idx", "end_idx", *when, "severity")


@add("n12_time_to_index", cand_sql() + """
, spans as (select c.signal_id, c.seq, a.ts - interval 1 second as start_ts, b.ts + interval 1 second as end_ts from cand c
  join etype a on a.signal_id = c.signal_id and a.idx = c.start_idx join etype b on b.signal_id = c.signal_id and b.idx = c.end_idx)
select s.signal_id, cast(seq as bigint) as seq, cast(count(*) filter (ts < start_ts) as bigint) as start_idx, cast(count(*) filter (ts <= end_ts) - 1 as bigint) as end_idx
from spans s join etype e on e.signal_id = s.signal_id group by s.signal_id, seq
""")  # fmt: skip
def n12(spark: SparkSession, d: str) -> DataFrame:
    s = V.sig_etype(spark, d)
    b = intervals.interval_bounds(s, V.candidates(s), score="value")
    second = F.expr("interval 1 second")
    spans = b.select("dataset", "signal_id", "seq", (F.col("start_ts") - second).alias("start_ts"), (F.col("end_ts") + second).alias("end_ts"))
    return out(intervals.to_index_space(s, spans, part=lambda c: F.date_trunc("day", c)), "signal_id", "seq", "start_idx", "end_idx")


@add("n13_binary", cand_sql() + "select signal_id, cast(idx as bigint) as idx, cast(exists (select 1 from iv where iv.signal_id = e.signal_id and e.idx between start_idx - 1 and end_idx) as bigint) as flag from etype e")
def n13(spark: SparkSession, d: str) -> DataFrame:
    s = V.sig_etype(spark, d)
    wide = V.candidates(s).withColumn("start_idx", F.col("start_idx") - 1)
    return out(intervals.flags_of(s, wide), "signal_id", "idx", "flag")


@add("n14_ground_truth", f"""
with {EVENTS}, h as (select idx, idx - row_number() over (order by idx) as grp from ev where label = 1)
select 'all' as signal_id, cast(min(idx) as bigint) as start_idx, cast(max(idx) as bigint) as end_idx, 'label' as source from h group by grp
union all select 'noted', 5, 9, 'annotation'
""")  # fmt: skip
def n14(spark: SparkSession, d: str) -> DataFrame:
    s = V.sig_events(spark, d)
    plain = s.withColumns({"signal_id": F.lit("noted"), "label": F.lit(None).cast("int")})
    noted = spark.createDataFrame([("events", "noted", 5, 9), ("events", "all", 1, 2)], "dataset string, signal_id string, start_idx long, end_idx long")
    return out(intervals.ground_truth(s.unionByName(plain), noted), "signal_id", "start_idx", "end_idx", "source")


@add("n16_detector", f"""
with {SHIP}, fit as (select regr_slope(value, idx) as a, regr_intercept(value, idx) as b from ship),
dt as (select signal_id, idx, ts, value - (a * idx + b) as v from ship, fit),
mm as (select signal_id, idx, ts, (v - min(v) over ()) / (max(v) over () - min(v) over ()) as value from dt),
{z_sql('mm')}, zz as (select signal_id, idx, ts, z as value from zed), {ewma_sql('zz')}, {DECIDE_SQL.format(z=Z[0.01])}
""")  # fmt: skip
def n16(spark: SparkSession, d: str) -> DataFrame:
    return flagship(spark, d)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Detrend, scale, robust z, smooth, threshold: intervals of the daily shipments with severities."""
    scaled = materialise(clean.minmax(clean.detrend(V.sig_ship(spark, d))))
    z = decision.robust_positive_z(scaled, "value")
    points, found = decision.decide(z, 0.01, score="value")
    return out(intervals.interval_bounds(points, found, score="value"), "signal_id", "start_idx", "end_idx", "severity")
