"""Sliding windows over signals and the plan of long assessment windows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriescope.operators.common import keys_in, materialise

SCALES = (224, 448, 672)


def window_starts(lengths: DataFrame, sizes: Sequence[int] = SCALES, steps: int = 4) -> DataFrame:
    """(keys, scale, window_id, start_idx) of each whole window of each scale in signals of ``n``
    points, a step being a fraction of the size; the tail that fills no window is dropped."""
    keys = keys_in(lengths)
    scaled = lengths.select(*keys, "n", F.explode(F.array(*[F.lit(int(s)) for s in sizes])).alias("scale"))
    step = F.greatest(F.lit(1), F.floor(F.col("scale") / steps).cast("int"))
    held = scaled.where(F.col("n") >= F.col("scale"))
    starts = F.sequence(F.lit(0).cast("long"), (F.col("n") - F.col("scale")).cast("long"), step.cast("long"))
    return held.select(*keys, "scale", F.posexplode(starts).alias("window_id", "start_idx"))


def sliding_windows(points: DataFrame, sizes: Sequence[int] = SCALES, steps: int = 4, value: str = "value") -> DataFrame:
    """(keys, scale, window_id, start_idx, vals): a row of values for each window.

    Points are put into blocks once, as long as the steps of all scales allow; blocks, not points, are
    then sent to the ``steps`` windows of each scale that hold them."""
    keys = keys_in(points)
    strides = [max(1, int(s) // steps) for s in sizes]
    width = math.gcd(*strides)
    n = points.groupBy(*keys).agg(F.max("idx").alias("__top"))
    blocks = points.groupBy(*keys, F.floor(F.col("idx") / width).alias("__b")).agg(F.array_sort(F.collect_list(F.struct("idx", F.col(value).alias("v"))), _by("idx")).alias("__p"))
    scales = F.array(*[F.struct(F.lit(int(s)).alias("scale"), F.lit(k).cast("long").alias("step")) for s, k in zip(sizes, strides, strict=True)])
    scaled = blocks.join(n, keys).select(*keys, "__top", "__b", "__p", F.inline(scales))
    at, step = F.col("__b") * width, F.col("step")
    first = F.greatest(F.lit(0), F.floor((at - F.col("scale")) / step) + 1).cast("long")
    last = F.least(F.floor(at / step), F.floor((F.col("__top") + 1 - F.col("scale")) / step)).cast("long")
    placed = scaled.where((F.col("__top") + 1 >= F.col("scale")) & (last >= first)).withColumn("window_id", F.explode(F.sequence(first, last)))
    placed = placed.withColumn("start_idx", F.col("window_id") * step)
    # A size that isn't a multiple of the width ends within a block.
    past = F.col("start_idx") + F.col("scale")
    held = F.when(past < at + width, F.filter("__p", lambda p: p["idx"] < past)).otherwise(F.col("__p"))
    parts = placed.select(*keys, "scale", "window_id", "start_idx", "__b", held["v"].alias("__v")).where(F.size("__v") > 0)
    rows = parts.groupBy(*keys, "scale", "window_id", "start_idx").agg(F.array_sort(F.collect_list(F.struct("__b", "__v")), _by("__b")).alias("__p"))
    return rows.select(*keys, "scale", "window_id", "start_idx", F.flatten(F.col("__p")["__v"]).alias("vals"))


def _by(name: str) -> Callable[[Column, Column], Column]:
    """An order of structs by one of their fields."""
    return lambda a, b: F.when(a[name] < b[name], -1).when(a[name] > b[name], 1).otherwise(0)


def sample_windows(windows: DataFrame, most: int, by: list[str] | None = None) -> DataFrame:
    """At most ``most`` windows of each signal and scale, evenly spaced from the first to the last."""
    keys = by if by is not None else keys_in(windows, "scale")
    if most <= 0:
        return windows
    counts = windows.groupBy(*keys).agg(F.max("window_id").alias("__last"))
    k = F.explode(F.sequence(F.lit(0), F.lit(max(most - 1, 0))))
    picked = counts.select(*keys, "__last", k.alias("__k"))
    picked = picked.select(*keys, F.when(F.col("__last") < most, F.least(F.col("__k"), F.col("__last"))).otherwise(F.floor(F.col("__k") * F.col("__last") / max(most - 1, 1))).alias("window_id")).distinct()
    return windows.join(picked, [*keys, "window_id"], "left_semi")


def draw_windows(windows: DataFrame, most: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """``most`` windows of each signal and scale that hash lowest under a seed. Up to a thousand are
    chosen in each partition first, and these few are merged."""
    keys = by if by is not None else keys_in(windows, "scale")
    order = Window.partitionBy(*keys).orderBy(F.xxhash64("window_id", F.lit(seed)), "window_id")
    return windows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= most).drop("__r")


# Lengths below which a kind of plot is drawn, its kind and its columns of pixels.
PROFILES = ((4_000, "short", 3072), (10_000, "medium", 4096), (15_000, "long_medium", 5120), (20_001, "long", 6000))
LONGEST = ("ultra_long", 4096)


def render_profile(length: Column) -> Column:
    """(kind, columns) by the length of a signal."""

    def made(kind: str, columns: int) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(columns).alias("columns"))

    out = made(*LONGEST)
    for below, kind, columns in reversed(PROFILES):
        out = F.when(length < below, made(kind, columns)).otherwise(out)
    return out


def centred_range(center: Column, span: Column, length: Column) -> Column:
    """(lo, hi): a range of ``span`` points around a centre, moved into the signal; halves round to even."""
    s = F.greatest(F.lit(1), F.least(span, length)).cast("long")
    lo = F.bround(center.cast("double") - (s - 1) / 2.0, 0).cast("long")
    lo = F.greatest(F.lit(0), F.least(lo, length - s)).cast("long")
    return F.struct(lo.alias("lo"), (lo + s - 1).alias("hi"))


def home_windows(candidates: DataFrame, windows: DataFrame) -> DataFrame:
    """``candidates`` (keys, start_idx, end_idx) with ``window``: the number of the first window whose
    core (core_start, core_end) holds their midpoint, else the last window's."""
    from seriescope.operators.intervals import points_in

    keys = keys_in(candidates)
    # Each candidate is a point, so that it meets the cores of its bucket of indices only.
    mid = F.floor((F.col("start_idx") + F.col("end_idx")) / 2).alias("idx")
    points = candidates.select(*keys, mid, F.monotonically_increasing_id().alias("__row"), F.struct(*candidates.columns).alias("__c"))
    cores = windows.select(*keys, F.col("window").alias("__w"), F.col("core_start").alias("start_idx"), F.col("core_end").alias("end_idx"))
    first = points_in(points, cores, keys, "left").groupBy(*keys, "__row").agg(F.min("__w").alias("__w"), F.any_value("__c").alias("__c"))
    last = windows.groupBy(*keys).agg(F.max("window").alias("__last"))
    return first.join(last, keys).select("__c.*", F.coalesce("__w", "__last").alias("window"))


def _free_near(at: int, taken: list[tuple[int, int]], low: int, high: int) -> int:
    """The last place up to ``at`` that no candidate covers, else the first one after it; ``at``
    itself, moved into low..high, if there is neither."""
    at = max(low, min(at, high))
    back, on = at, at
    for a, b in sorted(taken, key=lambda x: -x[1]):
        if a <= back <= b:
            back = a - 1
    for a, b in sorted(taken):
        if a <= on <= b:
            on = b + 1
    return back if back >= low else on if on <= high else at


def plan_windows(length: int, candidates: Iterable[Sequence[int]] = (), size: int = 20_000, overlap: int = 2_000) -> list[dict]:
    """Long overlapping windows of a signal whose cuts avoid candidates, with cores that divide it.

    One signal's plan follows from its length and few candidates, so it is made on the driver or in
    a task for one signal. Cuts only ever lengthen a window. Candidates are listed by the order of
    their places; a plan of one window lists none.
    """
    top = max(0, length - 1)
    if length <= size:
        return [{"window": 1, "start": 0, "end": top, "core_start": 0, "core_end": top, "candidates": []}]
    if not 0 < overlap < size:
        raise ValueError("overlap must be positive and smaller than the window")
    taken = sorted((max(0, int(c[0])), min(top, int(c[1]))) for c in candidates)
    starts, ends = [0], []
    while len(ends) < len(starts):
        nominal = min(top, starts[-1] + size - 1)
        ends.append(nominal if nominal == top else max(nominal, _free_near(nominal, taken, starts[-1], min(top, nominal + overlap))))
        if ends[-1] < top:
            starts.append(ends[-1] - overlap + 1)
    middles = [_free_near((e + s) // 2, taken, s, e) for e, s in zip(ends, starts[1:], strict=False)]
    plan = zip(starts, ends, [0, *middles], [*middles, top], strict=True)
    return [
        {"window": i, "start": s, "end": e, "core_start": a, "core_end": b, "candidates": [j for j, (x, y) in enumerate(taken, 1) if a <= (x + y) // 2 <= b]}
        for i, (s, e, a, b) in enumerate(plan, 1)
    ]


def assessment_windows(lengths: DataFrame, candidates: DataFrame, size: int = 20_000, overlap: int = 2_000) -> DataFrame:
    """(keys, window, start_idx, end_idx, core_start, core_end): the plan of each signal (``lengths``:
    keys, n) around its candidates.

    Only runs of candidates as long as a window can lengthen one, and a signal has no more of those
    than windows, so a task gets them in one row; each cut between cores then meets the run that
    covers it by buckets of indices.
    """
    from seriescope.operators.intervals import merge_intervals, points_in

    keys = keys_in(lengths)
    known = lengths.select(*keys, "n")
    inside = candidates.where("start_idx is not null and end_idx is not null").join(known, keys)
    taken = inside.select(*keys, F.greatest(F.lit(0), "start_idx").cast("long").alias("start_idx"), F.least(F.col("n") - 1, F.col("end_idx")).cast("long").alias("end_idx"))
    apart = materialise(merge_intervals(taken.where("start_idx <= end_idx"), keys))
    long = apart.where(F.col("end_idx") - F.col("start_idx") + 1 >= size).groupBy(*keys).agg(F.sort_array(F.collect_list(F.array("start_idx", "end_idx"))).alias("c"))

    def plan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(*k, w["window"], w["start"], w["end"]) for *k, n, runs in f[[*keys, "n", "c"]].itertuples(index=False) for w in plan_windows(n, [] if runs is None else runs, size, overlap)]
            yield pd.DataFrame(rows, columns=[*keys, "window", "start_idx", "end_idx"])

    types = dict(lengths.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "window long, start_idx long, end_idx long"])
    made = known.join(long, keys, "left").mapInPandas(plan, schema)
    order = Window.partitionBy(*keys).orderBy("window")
    cuts = made.select(*keys, "window", F.col("start_idx").alias("__s"), F.col("end_idx").alias("__e"), F.lead("start_idx").over(order).alias("__next"))
    cuts = cuts.withColumn("idx", F.floor((F.col("__e") + F.col("__next")) / 2))
    met = points_in(cuts, apart, keys, "left")
    free = F.when(F.col("start_idx") - 1 >= F.col("__next"), F.col("start_idx") - 1).when(F.col("end_idx") + 1 <= F.col("__e"), F.col("end_idx") + 1).otherwise(F.col("idx"))
    ends = met.withColumn("core_end", F.coalesce(free, F.col("__e")))
    return ends.select(*keys, "window", F.col("__s").alias("start_idx"), F.col("__e").alias("end_idx"), F.coalesce(F.lag("core_end").over(order), F.lit(0)).alias("core_start"), "core_end")
