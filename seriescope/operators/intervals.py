"""Closed index intervals: from flags, padding, merging, bounds and membership."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriescope.operators.common import STRETCH, keys_in, materialise, running, running_sums, stretch_of
from seriescope.operators.quantiles import order_statistics
from seriescope.operators.ranges import mean_of, range_aggregates

#: Width of the index buckets that range joins share.
BUCKET = 4096


def intervals_of(df: DataFrame, flag: Column, by: list[str] | None = None, *aggregates: Column) -> DataFrame:
    """(keys, start_idx, end_idx, aggregates) of each run of successive rows with ``flag``."""
    keys = by if by is not None else keys_in(df)
    # Flagged rows of one run have the same distance between their place and their count so far.
    counted = running_sums(df.where(flag), {"__seen": F.lit(1)}, keys)
    return counted.withColumn("__run", F.col("idx") - F.col("__seen")).drop("__seen").groupBy(*keys, "__run").agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), *aggregates).drop("__run")


def merge_intervals(df: DataFrame, by: list[str] | None = None, *aggregates: Column, gap: int = 1, stretch: int = STRETCH) -> DataFrame:
    """Join intervals that overlap or begin at most ``gap`` after the end so far.

    The largest end so far is carried over stretches of the signal, and so is the count of breaks, so
    the intervals of a long signal are dealt over many tasks."""
    keys = by if by is not None else keys_in(df)
    order = F.struct("start_idx", "end_idx")
    placed = df.withColumns({"__signal": F.struct(*keys) if keys else F.struct(F.lit(0)), "__order": order})
    ends = running(placed, {"__before": ("max", F.col("end_idx"))}, ["__signal"], stretch, "__order", stretch_of(stretch, "start_idx"), earlier=True)
    before = F.col("__before")
    marked = ends.withColumn("__new", F.when(before.isNull() | (F.col("start_idx") > before + gap), 1).otherwise(0)).drop("__before")
    grouped = running(marked, {"__group": ("sum", F.col("__new"))}, ["__signal"], stretch, "__order", stretch_of(stretch, "start_idx"))
    return grouped.groupBy(*keys, "__group").agg(F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"), *aggregates).drop("__group")


def pad_intervals(df: DataFrame, lengths: DataFrame, pad: int, by: list[str] | None = None) -> DataFrame:
    """Widen by ``pad`` on both sides within the signal (``lengths``: keys, n), then merge."""
    keys = by if by is not None else keys_in(df)
    wide = df.join(lengths, [k for k in keys if k in lengths.columns])
    wide = wide.withColumns({"start_idx": F.greatest(F.lit(0), F.col("start_idx") - pad), "end_idx": F.least(F.col("n") - 1, F.col("end_idx") + pad)})
    return merge_intervals(wide.drop("n"), keys)


def overlap_pairs(a: DataFrame, b: DataFrame, by: list[str], bucket: int = BUCKET) -> DataFrame:
    """Rows of ``a`` with (other_start, other_end) of each interval of ``b`` of the same group that
    shares a point with them; ends that touch do. Null groups are equal.

    Both sides are listed under the buckets that they touch; a pair counts in the bucket in which
    the later of them starts, so it is found once.
    """

    def listed(df: DataFrame) -> DataFrame:
        cells = F.sequence(F.floor(F.col("start_idx") / bucket), F.floor(F.col("end_idx") / bucket))
        return df.where("end_idx >= start_idx").withColumn("__cell", F.explode(cells))

    right = listed(b).select(*[F.col(k).alias(f"__{k}") for k in by], F.col("__cell").alias("__other"), F.col("start_idx").alias("other_start"), F.col("end_idx").alias("other_end"))
    on = (F.col("__cell") == F.col("__other")) & (F.col("start_idx") <= F.col("other_end")) & (F.col("other_start") <= F.col("end_idx"))
    on = on & (F.floor(F.greatest("start_idx", "other_start") / bucket) == F.col("__cell"))
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return listed(a).join(right, on).drop("__cell", "__other", *[f"__{k}" for k in by])


def points_in(points: DataFrame, intervals: DataFrame, by: list[str], how: str = "inner", bucket: int = BUCKET) -> DataFrame:
    """Rows of ``points`` (idx) with the intervals of their signal that hold them. Intervals are
    listed under each bucket of indices that they touch, so rows meet their bucket's only."""
    cells = F.sequence(F.floor(F.col("start_idx") / bucket), F.floor(F.col("end_idx") / bucket))
    listed = intervals.where("end_idx >= start_idx").withColumn("__cell", F.explode(cells))
    right = listed.select(*[F.col(k).alias(f"__{k}") for k in by], "__cell", *[c for c in intervals.columns if c not in by])
    same = F.floor(F.col("idx") / bucket) == F.col("__cell")
    for k in by:
        same = same & (F.col(k) == F.col(f"__{k}"))
    joined = points.join(right, same & F.col("idx").between(F.col("start_idx"), F.col("end_idx")), how)
    return joined.drop("__cell", *[f"__{k}" for k in by])


def flags_of(points: DataFrame, intervals: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``points`` with ``flag``: 1 inside an interval of the signal, else 0."""
    keys = by if by is not None else keys_in(points)
    # A point once for each disjoint interval: merge first, so that no point is found twice.
    apart = merge_intervals(intervals.select(*keys, "start_idx", "end_idx"), keys).withColumn("flag", F.lit(1))
    return points_in(points, apart, keys, "left").withColumn("flag", F.coalesce("flag", F.lit(0))).drop("start_idx", "end_idx")


def percentile_intervals(df: DataFrame, score: str = "score", share: float = 0.99, ts: str = "ts") -> DataFrame:
    """Runs of scores above the percentile of their signal: (keys, start_idx, end_idx, start_ts,
    end_ts, severity), the severity being the mean score."""
    df, keys = materialise(df), keys_in(df)
    found = order_statistics(df, F.col(score), [share], keys, "__cut").withColumn("__cut", F.col("__cut")[0])
    cut = df.join(found, keys) if keys else df.crossJoin(F.broadcast(found))
    return intervals_of(cut, F.col(score) > F.col("__cut"), None, F.min_by(ts, "idx").alias("start_ts"), F.max_by(ts, "idx").alias("end_ts"), F.avg(score).alias("severity"))


def interval_bounds(points: DataFrame, intervals: DataFrame, by: list[str] | None = None, score: str = "score", ts: str = "ts") -> DataFrame:
    """Intervals with their times and mean score. Ends are put in order and into the signal; without
    a score the severity is 1."""
    keys = by if by is not None else keys_in(points)
    sizes = points.groupBy(*keys).agg(F.max("idx").alias("__top"))
    low, high = F.least("start_idx", "end_idx"), F.greatest("start_idx", "end_idx")
    inside = intervals.join(sizes, keys).withColumns({"__s": F.greatest(F.lit(0), F.least(low, F.col("__top"))), "__e": F.greatest(F.lit(0), F.least(high, F.col("__top")))})
    inside = inside.select(*[c for c in intervals.columns if c not in ("start_idx", "end_idx")], F.col("__s").alias("start_idx"), F.col("__e").alias("end_idx"))
    asked = inside.select(*[c for c in inside.columns if c != score])
    found = range_aggregates(points, asked, {"__first": ("first", F.col(ts)), "__last": ("last", F.col(ts)), "__m": ("moments", F.col(score))}, keys)
    severity = F.coalesce(mean_of(F.col("__m")), F.lit(1.0))
    return found.select(*asked.columns, F.col("__first.value").alias("start_ts"), F.col("__last.value").alias("end_ts"), severity.alias("severity"))


def to_index_space(points: DataFrame, spans: DataFrame, by: list[str] | None = None, ts: str = "ts", part: Callable[[Column], Column] | None = None) -> DataFrame:
    """Time intervals (keys, start_ts, end_ts) -> index intervals: the first index not before the
    start to the last not after the end; those without a row in them are dropped.

    ``part``: what of a time numbers stretches of a signal that are counted apart, such as its day;
    it never falls as time goes on. Without it a signal is counted in one task.
    """
    keys = by if by is not None else keys_in(points)
    # Points and ends in one order: an index is the number of points before an end.
    nothing = F.lit(None).cast(spans.select(F.struct(*spans.columns).alias("s")).schema["s"].dataType)
    row = F.struct(*spans.columns)
    ends = [spans.select(*keys, F.col(c).alias("__ts"), F.lit(kind).alias("__kind"), row.alias("__s")) for c, kind in (("start_ts", 0), ("end_ts", 2))]
    line = points.select(*keys, F.col(ts).alias("__ts"), F.lit(1).alias("__kind"), nothing.alias("__s")).unionByName(ends[0]).unionByName(ends[1])
    # In a row, so that points without a time, which come first, are a stretch that joins, too.
    stretch = F.struct(F.lit(0) if part is None else part(F.col("__ts")))
    placed = line.withColumn("__order", F.struct("__ts", "__kind"))
    counted = running_sums(placed, {"__n": (F.col("__kind") == 1).cast("long")}, keys, order="__order", part=stretch).where("__kind <> 1")
    found = counted.groupBy("__s").agg(F.min(F.when(F.col("__kind") == 0, F.col("__n"))).alias("start_idx"), (F.max(F.when(F.col("__kind") == 2, F.col("__n"))) - 1).alias("end_idx"))
    return found.where("start_idx <= end_idx").select("__s.*", "start_idx", "end_idx")


def ground_truth(points: DataFrame, annotated: DataFrame, label: str = "label") -> DataFrame:
    """(keys, start_idx, end_idx, source): runs of labels where a signal has any, else its annotated
    intervals, else nothing."""
    keys = keys_in(points)
    labelled = intervals_of(points, F.col(label) == 1).withColumn("source", F.lit("label"))
    have = points.where(F.col(label).isNotNull()).select(*keys).distinct()
    noted = annotated.select(*keys, "start_idx", "end_idx").join(have, keys, "left_anti").withColumn("source", F.lit("annotation"))
    return labelled.unionByName(noted)
