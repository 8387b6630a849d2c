"""Evaluation of intervals and points."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriescope.functions.numeric import EPS, ratio
from seriescope.operators.common import STRETCH, keys_in, materialise, running_sums, stretch_of

NAN = float("nan")


def overlap_counts(groups: DataFrame, truth: DataFrame, detected: DataFrame, by: list[str] | None = None, stretch: int = STRETCH) -> DataFrame:
    """(by, n_gt, n_detected, tp, fp, fn) of every row of ``groups``: tp counts overlapping pairs,
    fp detections and fn truths that overlap nothing.

    An interval overlaps those of the other side that start by its end, less those that end before its
    start. Both follow from running counts of ends along stretches, so no pair is made. An interval
    whose end is before its start, or null, overlaps nothing.
    """
    keys = by if by is not None else keys_in(groups)
    sides = [df.select(*keys, F.lit(i).alias("__side"), F.col("start_idx").cast("long").alias("__s"), F.col("end_idx").cast("long").alias("__e")) for i, df in enumerate((truth, detected))]
    both = materialise(sides[0].unionByName(sides[1]))
    sound = F.coalesce(F.col("__s") <= F.col("__e"), F.lit(False))
    # At one index starts come before ends.
    ends = F.array(F.struct(F.col("__s").alias("at"), F.lit(0).alias("last")), F.struct(F.col("__e").alias("at"), F.lit(1).alias("last")))
    line = both.where(sound).withColumn("__order", F.explode(ends)).withColumn("__group", F.struct(*keys) if keys else F.struct(F.lit(0)))
    last = F.col("__order.last") == 1
    flags = {f"__n{side}{kind}": ((F.col("__side") == side) & (last if kind else ~last)).cast("long") for side in (0, 1) for kind in (0, 1)}
    counted = running_sums(line, flags, ["__group"], order="__order", part=stretch_of(stretch, "__order.at"))
    mine = F.col("__side") == 0
    begun, over = F.when(mine, F.col("__n10")).otherwise(F.col("__n00")), F.when(mine, F.col("__n11")).otherwise(F.col("__n01"))
    met = counted.groupBy(*keys, "__side", "__s", "__e").agg(F.sum(F.when(last, begun).otherwise(-over)).alias("__met"), F.count_if(last).alias("__n"))
    nothing = F.lit(0).cast("long")
    none = groups.select(*keys).distinct().withColumns({"__side": F.lit(None).cast("int"), "__met": nothing, "__n": nothing})
    bad = both.where(~sound).select(*keys, "__side", nothing.alias("__met"), F.lit(1).cast("long").alias("__n"))
    rows = none.unionByName(met.drop("__s", "__e")).unionByName(bad)

    def total(side: int, value: Column, which: Column | None = None) -> Column:
        chosen = F.col("__side") == side
        return F.sum(F.when(chosen if which is None else chosen & which, value).otherwise(0))

    alone = F.col("__met") == 0
    sums = rows.groupBy(*keys).agg(
        total(0, F.col("__n")).alias("n_gt"), total(1, F.col("__n")).alias("n_detected"), total(1, F.col("__met")).alias("tp"),
        total(1, F.col("__n"), alone).alias("fp"), total(0, F.col("__n"), alone).alias("fn"), F.count_if(F.col("__side").isNull()).alias("__asked"),
    )
    return sums.where("__asked > 0").drop("__asked")


def precision_recall_f1(counts: DataFrame) -> DataFrame:
    """Add precision, recall and f1; each is 0 where its denominator is."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    both = counts.withColumns({"precision": p, "recall": r})
    return both.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def evaluate_intervals(groups: DataFrame, truth: DataFrame, detected: DataFrame, by: list[str] | None = None, nan_without_truth: bool = False) -> DataFrame:
    """Counts, precision, recall and F1 of each group; all three NaN without truth if so asked."""
    out = precision_recall_f1(overlap_counts(groups, truth, detected, by))
    if nan_without_truth:
        out = out.withColumns({c: F.when(F.col("n_gt") > 0, F.col(c)).otherwise(F.lit(NAN)) for c in ("precision", "recall", "f1")})
    return out


#: Metrics of an interval evaluation that a caller may supply.
HOOKS = ("affiliation_f1", "vus_pr", "vus_roc")
#: (groups, truth, detected, keys) -> rows of the keys with a column ``value``.
Hook = Callable[[DataFrame, DataFrame, DataFrame, list[str]], DataFrame]


def per_alpha(signals: DataFrame, truth: DataFrame, detected: DataFrame, alphas: Sequence[float], hooks: Mapping[str, Hook] | None = None) -> DataFrame:
    """A row for each signal and alpha, in the order of ``alphas`` (column ``alpha_order``), with
    ``best``: the first with the strictly largest F1.

    ``hooks`` supplies metrics by name, of HOOKS or others; each takes the groups, truth and
    detections of all signals and alphas at once. Those of HOOKS without one, and groups that a hook
    leaves out, are null."""
    keys = keys_in(signals)
    listed = F.posexplode(F.array(*[F.lit(a) for a in alphas])).alias("alpha_order", "alpha")
    grid = signals.select(*keys).distinct().select(*keys, listed)
    same = truth.join(grid.select(*keys, "alpha"), keys)
    rows = evaluate_intervals(grid, same, detected, [*keys, "alpha"], nan_without_truth=True).join(grid, [*keys, "alpha"])
    worth = F.coalesce(F.nanvl("f1", F.lit(-1.0)), F.lit(-1.0))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(worth.desc(), "alpha_order"))
    rows = rows.withColumn("best", first == 1).withColumns({c: F.lit(None).cast("double") for c in HOOKS if c not in (hooks or {})})
    for name, hook in (hooks or {}).items():
        found = hook(grid, same, detected, [*keys, "alpha"])
        rows = rows.join(found.select(*keys, "alpha", F.col("value").cast("double").alias(name)), [*keys, "alpha"], "left")
    return rows


#: Parts of a signal's scores, each of which one task sums up, and the accuracy of their bounds.
PARTS, BOUNDS_ACCURACY = 256, 10_000


def _curve(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """(by, score, p, tp, all, positives): positives at each distinct score, counts at or above it.

    Scores are counted in parts and parts by their sums, so a signal with many distinct scores is
    dealt over many tasks. Bounds of parts come from a sketch of the distinct scores, so parts are
    about equal whatever the scores' distribution, and a score is in one part."""
    at = df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    ends = at.groupBy(*by).agg(F.percentile_approx("score", F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)]), BOUNDS_ACCURACY).alias("__bounds"), F.sum("p").alias("positives"))
    ranged = (at.join(ends, by) if by else at.crossJoin(F.broadcast(ends))).withColumn("__down", -F.col("score"))
    part = F.coalesce(F.size(F.filter("__bounds", lambda b: b > F.col("score"))), F.lit(0))
    summed = running_sums(ranged, {"tp": F.col("p"), "all": F.col("n")}, by, order="__down", part=part)
    return summed.select(*by, "score", "p", "tp", "all", "positives")


def point_f1max(df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """(by, f1max, precision, recall, threshold) at the first maximum by rising threshold; NaN
    without positives."""
    keys = by if by is not None else keys_in(df)
    c = _curve(df, label, score, keys).withColumns({"precision": F.col("tp") / F.col("all"), "recall": ratio(F.col("tp"), F.col("positives"))})
    c = c.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + EPS))
    best = c.groupBy(*keys).agg(F.max("positives").alias("positives"), F.max_by(F.struct("f1", "precision", "recall", "score"), F.struct("f1", -F.col("score"))).alias("b"))

    def some(name: str) -> Column:
        return F.when(F.col("positives") > 0, F.col(f"b.{name}")).otherwise(F.lit(NAN))

    return best.select(*keys, some("f1").alias("f1max"), some("precision").alias("precision"), some("recall").alias("recall"), some("score").alias("threshold"))


def average_precision(df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """(by, auprc): precision summed over the steps of recall; NaN without positives."""
    keys = by if by is not None else keys_in(df)
    c = _curve(df, label, score, keys)
    gain = F.col("p") / F.nullif(F.col("positives"), F.lit(0))
    c = c.withColumn("part", gain * F.col("tp") / F.col("all"))
    return c.groupBy(*keys).agg(F.coalesce(F.sum("part"), F.lit(NAN)).alias("auprc"))


def experiment_summary(roster: DataFrame, runs: DataFrame, n_alphas: int = 3, stages: tuple[str, str] = ("screening", "final")) -> DataFrame:
    """(dataset, n_signals, n_complete, f1max of both stages, net_gain) of each dataset of ``roster``.

    ``runs``: dataset, signal_id, alpha, stage, f1, complete. A signal counts if all its alphas are
    complete in both stages; its value is the largest F1 of a stage, a dataset's their mean.
    """
    done = runs.where("complete").groupBy("dataset", "signal_id", "stage").agg(F.max("f1").alias("f1"), F.count_distinct("alpha").alias("n")).where(F.col("n") == n_alphas)
    wide = done.groupBy("dataset", "signal_id").agg(*[F.max(F.when(F.col("stage") == s, F.col("f1"))).alias(s) for s in stages])
    whole = wide.where(F.col(stages[0]).isNotNull() & F.col(stages[1]).isNotNull())
    means = whole.groupBy("dataset").agg(F.count("*").alias("n_complete"), *[F.avg(s).alias(f"{s}_f1max") for s in stages])
    sizes = roster.groupBy("dataset").agg(F.count_distinct("signal_id").alias("n_signals"))
    out = sizes.join(means, "dataset", "left").withColumn("n_complete", F.coalesce("n_complete", F.lit(0)))
    return out.withColumn("net_gain", F.col(f"{stages[1]}_f1max") - F.col(f"{stages[0]}_f1max"))


def aggregate_results(results: DataFrame) -> DataFrame:
    """(dataset, model, mean_f1, std_f1, n_signals): the best F1 of each signal, then mean and sample
    deviation over the signals of a dataset and model."""
    best = results.groupBy("dataset", "model", "signal").agg(F.max("f1").alias("f1"))
    return best.groupBy("dataset", "model").agg(F.avg("f1").alias("mean_f1"), F.stddev_samp("f1").alias("std_f1"), F.count("*").alias("n_signals"))


def usage_totals(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Tokens, attempts, failures and tool calls: events have kind (response, attempt, tool), ok,
    input_tokens, output_tokens."""
    keys = by if by is not None else keys_in(events)
    return events.groupBy(*keys).agg(
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.count_if(F.col("kind") == "attempt").alias("attempts"), F.count_if((F.col("kind") == "attempt") & ~F.col("ok")).alias("failed_attempts"),
        F.count_if(F.col("kind") == "tool").alias("tool_calls"),
    )


def tensor_stats(df: DataFrame, value: str = "value", by: list[str] | None = None) -> DataFrame:
    """(by, n, lo, hi, mean, std, has_nan, has_inf): over the finite values."""
    keys = by if by is not None else keys_in(df)
    x, inf = F.col(value), float("inf")
    fine = F.when(~F.isnan(x) & (F.abs(x) != inf), x)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(fine).alias("lo"), F.max(fine).alias("hi"), F.avg(fine).alias("mean"), F.stddev_pop(fine).alias("std"),
        F.coalesce(F.bool_or(F.isnan(x)), F.lit(False)).alias("has_nan"), F.coalesce(F.bool_or(F.abs(x) == inf), F.lit(False)).alias("has_inf"),
    )
