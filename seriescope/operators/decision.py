"""From scores to decisions: robust scaling, fusion over scales, smoothing and thresholds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriescope.functions.numeric import EPS, finite_or
from seriescope.operators.common import keys_in, materialise, per_signal, running_sums
from seriescope.operators.intervals import intervals_of, pad_intervals
from seriescope.operators.quantiles import order_statistics

#: Scale of a median absolute deviation to a standard deviation.
MAD_SCALE = 1.4826


def beside(df: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the statistics of each signal."""
    return df.join(stats, by) if by else df.crossJoin(F.broadcast(stats))


def medians(rows: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """(by, __med, __mad): the median of a column of each signal and that of the distances from it. They
    have a row a signal, so points are joined with both at once. ``rows`` is written by the caller."""
    mid = materialise(order_statistics(rows, value, [0.5], by, "__med").withColumn("__med", F.col("__med")[0]))
    off = materialise(beside(rows.select(*by, value.alias("__x")), mid, by).select(*by, F.abs(F.col("__x") - F.col("__med")).alias("__off")))
    return beside(mid, order_statistics(off, F.col("__off"), [0.5], by, "__mad").withColumn("__mad", F.col("__mad")[0]), by)


def robust_positive_z(df: DataFrame, score: str = "score", by: list[str] | None = None) -> DataFrame:
    """How many robust deviations a score lies above its median, zero below it.

    Where the median absolute deviation vanishes the standard deviation serves; where that vanishes
    too, all are zero. Values that aren't finite count as zero.
    """
    keys = by if by is not None else keys_in(df)
    clean = materialise(df.withColumn(score, finite_or(F.col(score), 0.0)))
    spread = beside(clean, beside(clean.groupBy(*keys).agg(F.stddev_pop(score).alias("__std")), medians(clean, F.col(score), keys), keys), keys)
    off = F.col(score) - F.col("__med")
    z = F.when(F.col("__mad") >= EPS, off / (MAD_SCALE * F.col("__mad") + EPS)).when(F.col("__std") >= EPS, off / (F.col("__std") + EPS)).otherwise(F.lit(0.0))
    return spread.withColumn(score, F.greatest(z, F.lit(0.0))).drop("__med", "__std", "__mad")


def fuse_scales(df: DataFrame, weights: Mapping[int, float] | Sequence[float] | None = None, scales: Sequence[int] = (224, 448, 672), normalise: bool = True, score: str = "score") -> DataFrame:
    """(keys, idx, score): weighted mean over ``scale`` of each scale's robust z, or raw score.

    Weights are equal by default and are brought to a sum of 1. Every point must have every scale.
    """
    if weights is None:
        w = dict.fromkeys(scales, 1.0)
    elif isinstance(weights, Mapping):
        w = {s: float(weights[s]) for s in scales}
    else:
        w = dict(zip(scales, map(float, weights), strict=True))
    total = sum(w.values())
    if not total > 0 or any(x < 0 for x in w.values()):
        raise ValueError("weights must be non-negative with a positive sum")
    keys = keys_in(df)
    used = df.where(F.col("scale").isin(*scales))
    used = robust_positive_z(used, score, [*keys, "scale"]) if normalise else used
    weight = F.create_map(*[F.lit(x) for s in scales for x in (s, w[s] / total)])
    bit = F.create_map(*[F.lit(x) for i, s in enumerate(scales) for x in (s, 1 << i)])
    # Points are dealt out before they are summed up: partial sums would hold every point of a task's
    # rows and spare none, and a shuffle's tasks stay of one size as the input grows.
    dealt = used.select(*keys, "idx", (F.col(score) * F.element_at(weight, F.col("scale"))).alias("__s"), F.element_at(bit, F.col("scale")).cast("long").alias("__b")).repartition(*keys, "idx")
    fused = dealt.groupBy(*keys, "idx").agg(F.sum("__s").alias("score"), F.bit_or("__b").alias("__n"))
    whole = F.when(F.col("__n") == (1 << len(scales)) - 1, F.col("score")).otherwise(F.raise_error(F.lit("a point lacks a scale")).cast("double"))
    return fused.select(*keys, "idx", whole.alias("score"))


def ewma(df: DataFrame, score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Exponentially weighted mean with adjusted weights, the span being one percent of the signal.

    Weights grow as (1 - a)^-i; with this span they stay far below overflow whatever the length.
    """
    keys = by if by is not None else keys_in(df)
    sized = per_signal(df, F.count("*").alias("__n"), by=keys)
    a = 2.0 / (F.greatest(F.lit(1), F.floor(F.col("__n") * 0.01)) + 1.0)
    sized = sized.withColumn("__a", a).withColumn("__w", F.when(F.col("__a") < 1, F.pow(1 - F.col("__a"), -F.col("idx"))))
    summed = running_sums(sized, {"__top": F.col(score) * F.col("__w"), "__all": F.col("__w")}, keys)
    return summed.withColumn(score, F.when(F.col("__a") < 1, F.col("__top") / F.col("__all")).otherwise(F.col(score))).drop("__n", "__a", "__w", "__top", "__all")


def gaussian_factor(alpha: float) -> float:
    """How many deviations above the mean the share ``alpha`` of a normal distribution lies."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    return NormalDist().inv_cdf(1 - alpha)


def threshold_flags(df: DataFrame, alpha: float, method: str = "mean", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Add ``threshold`` (centre + factor * spread over the signal) and ``flag`` (strictly above)."""
    if method not in ("mean", "median"):
        raise ValueError("method must be 'mean' or 'median'")
    keys, z = by if by is not None else keys_in(df), gaussian_factor(alpha)
    if method == "mean":
        s = per_signal(df, F.avg(score).alias("__c"), F.stddev_pop(score).alias("__s"), by=keys)
    else:
        df = materialise(df)
        s = beside(df, medians(df, F.col(score), keys).withColumnsRenamed({"__med": "__c", "__mad": "__s"}), keys)
    s = s.withColumn("threshold", F.col("__c") + z * F.col("__s"))
    return s.withColumn("flag", F.col(score) > F.col("threshold")).drop("__c", "__s")


def alpha_intervals(df: DataFrame, alphas: Sequence[float], score: str = "score", by: list[str] | None = None) -> DataFrame:
    """(keys, alpha, start_idx, end_idx): runs above the mean threshold of each alpha. Centre and spread
    are taken once, and only points above the least threshold are looked at for each alpha."""
    keys = by if by is not None else keys_in(df)
    s = per_signal(df.select(*keys, "idx", score), F.avg(score).alias("__c"), F.stddev_pop(score).alias("__s"), by=keys)
    cuts = F.array(*[F.struct(F.lit(a).alias("alpha"), (F.col("__c") + gaussian_factor(a) * F.col("__s")).alias("cut")) for a in alphas])
    passed = F.filter(cuts, lambda c: F.col(score) > c["cut"])
    return intervals_of(s.select(*keys, "idx", F.explode(F.transform(passed, lambda c: c["alpha"])).alias("alpha")), F.lit(True), [*keys, "alpha"])


def sliding_flags(df: DataFrame, alpha: float, method: str = "mean", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Add ``flag``: above the threshold of any window of a third of the signal, at steps of a tenth."""
    keys, z = by if by is not None else keys_in(df), gaussian_factor(alpha)
    sized = per_signal(df, F.count("*").alias("__n"), by=keys)
    win, step = F.greatest(F.lit(1), F.floor(F.col("__n") / 3)), F.greatest(F.lit(1), F.floor(F.col("__n") / 10))
    # Windows whose start is at most idx and at least idx - win + 1.
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - win + 1) / step))
    spread = sized.withColumn("__k", F.explode(F.sequence(first.cast("long"), F.floor(F.col("idx") / step).cast("long"))))
    flagged = threshold_flags(spread, alpha, method, score, [*keys, "__k"])
    return flagged.groupBy(*keys, "idx").agg(F.first(score).alias(score), F.bool_or("flag").alias("flag"))


def decide(df: DataFrame, alpha: float, method: str = "mean", smoothing: bool = True, sliding: bool = False, padding: int = 0, score: str = "score") -> tuple[DataFrame, DataFrame]:
    """(points with score, threshold and flag; intervals): smoothing, threshold, runs and padding."""
    scores = materialise(ewma(df, score)) if smoothing else df
    if sliding:
        points = sliding_flags(scores, alpha, method, score).withColumn("threshold", F.lit(0.0))
    else:
        points = threshold_flags(scores, alpha, method, score)
    found = intervals_of(points, F.col("flag"))
    if padding > 0:
        found = pad_intervals(found, df.groupBy(*keys_in(df)).agg(F.count("*").alias("n")), padding)
    return points, found
