"""From patch scores to a score series: pooling back, resizing, stitching and aligning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriescope.functions.numeric import finite_or
from seriescope.operators.common import STRETCH, keys_in

SIZE, SIDE = 224, 14


def harmonic_cells(pools: DataFrame, masks: DataFrame, cells: int = SIDE * SIDE, shift: int = 1, by: list[str] | None = None) -> DataFrame:
    """(by, cell_id, score): the harmonic mean of the scores of the pools that hold a cell.

    ``pools``: by, group_id, score; ``masks``: group_id, cell_id. With ``shift`` 1, the default, cell
    i gets the pools that hold i + 1, and the last cell none; 0 aligns them. A pool of score zero makes
    its cells zero; a cell without a pool is NaN.
    """
    keys = by if by is not None else keys_in(pools, "scale", "window_id")
    held = masks.select("group_id", (F.col("cell_id") - shift).alias("cell_id")).where(f"cell_id between 0 and {cells - 1}")
    # Cells and pools are summed up together: no side of a join grows with the windows, so none is taken for small and broadcast.
    board = pools.select(*keys).distinct().withColumn("cell_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
    inverse = F.when(F.col("score") != 0, 1 / F.nullif(F.col("score"), F.lit(0.0)))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    joined = pools.join(F.broadcast(held), "group_id")  # masks depend on the board only
    held_by = joined.select(*keys, F.col("cell_id").cast("long").alias("cell_id"), one.alias("n"), (F.col("score") == 0).alias("zero"), inverse.alias("i"))
    rows = held_by.unionByName(board.select(*keys, "cell_id", none.alias("n"), F.lit(False).alias("zero"), F.lit(None).cast("double").alias("i")))
    sums = rows.groupBy(*keys, "cell_id").agg(F.sum("n").alias("n"), F.bool_or("zero").alias("zero"), F.sum("i").alias("s"))
    score = F.when(F.col("n") == 0, F.lit(float("nan"))).when(F.col("zero"), F.lit(0.0)).otherwise(F.col("n") / F.col("s"))
    return sums.select(*keys, "cell_id", score.alias("score"))


def mean_of_maps(*maps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, cell_id, score): the mean of maps of the same cells; 0 where one of them isn't finite."""
    keys = by if by is not None else keys_in(maps[0], "scale", "window_id")
    rows = maps[0].select(*keys, "cell_id", "score")
    for m in maps[1:]:
        rows = rows.unionByName(m.select(*keys, "cell_id", "score"))
    mean = rows.groupBy(*keys, "cell_id").agg(F.sum("score").alias("s"), F.count("score").alias("n"))
    return mean.select(*keys, "cell_id", F.when(F.col("n") == len(maps), finite_or(F.col("s") / len(maps), 0.0)).otherwise(F.lit(0.0)).alias("score"))


def resize_weights(size: int = SIZE, side: int = SIDE) -> np.ndarray:
    """[size, side]: bilinear weights with half-pixel centres, edges repeated."""
    at = np.maximum((np.arange(size) + 0.5) * side / size - 0.5, 0)
    low = np.minimum(np.floor(at).astype(int), side - 1)
    high = np.minimum(low + 1, side - 1)
    out = np.zeros((size, side))
    out[np.arange(size), low] += 1 - (at - low)
    out[np.arange(size), high] += at - low
    return out


def top_rows_mean(values: np.ndarray, share: float = 0.25) -> np.ndarray:
    """Of each column, the mean of the largest ``share`` of its values, one at least."""
    k = max(1, int(np.ceil(values.shape[0] * share)))
    return np.sort(values, axis=0)[::-1][:k].mean(axis=0)


def column_scores(cells: DataFrame, share: float = 0.25, size: int = SIZE, side: int = SIDE, by: list[str] | None = None) -> DataFrame:
    """(by, vals): the map of a window (``cell_id``, ``score``) enlarged to ``size`` x ``size`` and
    reduced to a value for each column. The large map never leaves the task."""
    keys = by if by is not None else keys_in(cells, "scale", "window_id")
    grids = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cell_id", "score"))).alias("__g"))
    grids = grids.select(*keys, F.col("__g.score").alias("grid"))
    weights = resize_weights(size, side)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["vals"] = [top_rows_mean(weights @ np.asarray(g, float).reshape(side, side) @ weights.T, share) for g in f["grid"]]
            yield f.drop(columns="grid")

    types = dict(grids.dtypes)
    return grids.mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", vals array<double>")


def top_share_mean(values: Column, share: float = 0.25) -> Column:
    """Mean of the largest ``share`` of an array, one value at least."""
    k = F.greatest(F.lit(1), F.ceil(F.size(values) * share)).cast("int")
    return F.aggregate(F.slice(F.sort_array(values, asc=False), F.lit(1), k), F.lit(0.0), lambda s, x: s + x) / k


def stitch(windows: DataFrame, step: int = SIZE // 4, by: list[str] | None = None) -> DataFrame:
    """(by, pos, score): windows of ``vals`` laid ``step`` apart by window_id, means where they overlap."""
    keys = by if by is not None else keys_in(windows, "scale")
    laid = windows.select(*keys, "window_id", F.posexplode("vals").alias("j", "v"))
    return laid.groupBy(*keys, (F.col("window_id") * step + F.col("j")).cast("long").alias("pos")).agg(F.avg("v").alias("score"))


def align(stitched: DataFrame, shape: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, idx, score): the stitched vector stretched to the span of its windows and to the signal.

    ``shape``: by, n (points of the signal), size, step, windows. The span of size + (windows - 1) *
    step points is interpolated; what the signal has beyond goes on along the last slope, what it
    lacks is cut off.
    """
    keys = by if by is not None else keys_in(stitched, "scale")
    following = stitched.select(*keys, (F.col("pos") - 1).alias("pos"), F.col("score").alias("__next"))
    pairs = stitched.withColumnRenamed("score", "__this").join(following, [*keys, "pos"], "left").withColumn("__next", F.coalesce("__next", "__this"))
    length = stitched.groupBy(*keys).agg((F.max("pos") + 1).alias("__l"))
    s = shape.join(length, keys).withColumn("__c", F.col("size") + (F.col("windows") - 1) * F.col("step"))
    # The last two interpolated points also give the slope beyond.
    # Indices are listed by stretches, which are dealt out, so no row holds those of a whole signal.
    last = F.greatest(F.col("n"), F.lit(1)).cast("long") - 1
    dealt = s.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / STRETCH)))).repartition(*keys, "__k")
    grid = dealt.withColumn("idx", F.explode(F.sequence(F.col("__k") * STRETCH, F.least(last, F.col("__k") * STRETCH + STRETCH - 1))))
    k = F.least(F.col("idx"), F.col("__c") - 1)
    x = k * (F.col("__l") - 1) / F.greatest(F.col("__c") - 1, F.lit(1))
    grid = grid.withColumns({"__x": x, "pos": F.least(F.floor(x), F.col("__l") - 1).cast("long")}).where(F.col("idx") < F.col("n"))
    at = grid.join(pairs, [*keys, "pos"]).withColumn("v", F.col("__this") + (F.col("__next") - F.col("__this")) * (F.col("__x") - F.col("pos")))
    beyond = at.where(F.col("__c") < F.col("n"))
    tail = beyond.where((F.col("idx") >= F.col("__c") - 2) & (F.col("idx") < F.col("__c")))
    slope = tail.groupBy(*keys).agg((F.max_by("v", "idx") - F.min_by("v", "idx")).alias("__slope"))
    out = at.join(slope, keys, "left")
    v = F.when(F.col("idx") >= F.col("__c"), F.col("v") + F.coalesce("__slope", F.lit(0.0)) * (F.col("idx") - F.col("__c") + 1)).otherwise(F.col("v"))
    return out.select(*keys, "idx", v.alias("score"))


def trace_summary(windows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, mean, max) of each window's ``vals``."""
    keys = by if by is not None else keys_in(windows, "scale", "window_id")
    return windows.select(*keys, (F.aggregate("vals", F.lit(0.0), lambda s, x: s + x) / F.size("vals")).alias("mean"), F.array_max("vals").alias("max"))


def smallest_and_largest(lists: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """(by, fewest, most): sizes of the arrays in a column."""
    keys = by if by is not None else keys_in(lists, "scale")
    return lists.groupBy(*keys).agg(F.min(F.size(column)).alias("fewest"), F.max(F.size(column)).alias("most"))

