"""The whole screening: windows, tokens, references, score maps, fusion and decisions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriescope.functions.numeric import EPS
from seriescope.operators import clean, decision, maps, retrieval, tokens, windows
from seriescope.operators.common import keys_in, materialise
from seriescope.operators.intervals import interval_bounds
from seriescope.operators.quantiles import order_statistics
from seriescope.sources.config import ScreeningConfig

LEVELS = ("patch", "mid", "large")
ALPHAS = (0.1, 0.01, 0.001)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), EPS)


def keep_central(refs: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` of the references [k, patches, dims] that lie nearest to their lower
    median; ties in order."""
    flat = refs.reshape(len(refs), -1)
    centre = np.sort(flat, axis=0)[(len(flat) - 1) // 2]
    far = np.round(1 - _unit(flat) @ _unit(centre), 12)
    return np.argsort(far, kind="stable")[: max(1, keep)]


#: Tokens of a query [patches, dims] and of its kept references [k, patches, dims], one at least, to a
#: score for each patch. It runs in tasks, so it must be picklable.
SimilarityPolicy = Callable[[np.ndarray, np.ndarray], np.ndarray]


def nearest_patch(query: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Half of 1 - the largest cosine of each patch with any patch of the references."""
    bank = _unit(kept.reshape(-1, kept.shape[-1]))
    return 0.5 * (1 - (_unit(query) @ bank.T).max(axis=1))


def level_scores(query: np.ndarray, refs: np.ndarray, keep: int, similarity: SimilarityPolicy = nearest_patch) -> np.ndarray:
    """Scores of a query's patches against its kept references; zeros where it has none."""
    if not len(refs):
        return np.zeros(len(query))
    scores = np.asarray(similarity(query, refs[keep_central(refs, keep)]), float)
    if scores.shape != (len(query),):
        raise ValueError(f"a similarity policy gives one score a patch, not {scores.shape}")
    return scores


def spread_pools(scores: np.ndarray, side: int, k: int, shift: int = 1) -> np.ndarray:
    """Scores of pools -> cells: the harmonic mean of the pools that hold cell i + ``shift``; 0 where
    that isn't a number."""
    n = side - k + 1
    with np.errstate(divide="ignore", invalid="ignore"):
        inverse = 1 / scores.reshape(n, n)
        total, count = np.zeros((side, side)), np.zeros((side, side))
        for i in range(k):
            for j in range(k):
                total[i : i + n, j : j + n] += inverse
                count[i : i + n, j : j + n] += 1
        cells = np.append((count / total).ravel(), np.full(shift, np.nan))[shift:]
    return cells


def board_vector(levels: dict[str, np.ndarray], resize: np.ndarray, side: int, shift: int) -> np.ndarray:
    """Scores of patches and pools -> a score for each column of the image."""
    cells = [levels["patch"], *(spread_pools(levels[name], side, k, shift) for name, k in tokens.LEVELS.items())]
    board = np.sum(cells, axis=0) / len(cells)
    board = np.where(np.isfinite(board), board, 0.0).reshape(side, side)
    return maps.top_rows_mean(resize @ board @ resize.T)


def _pools(side: int) -> dict[str, int]:
    """Number of patches or pools of each level."""
    return {"patch": side * side, **{name: (side - k + 1) ** 2 for name, k in tokens.LEVELS.items()}}


def window_vectors(encoded: DataFrame, refs: DataFrame, keep: int = 4, side: int = tokens.SIDE, size: int = tokens.SIZE, shift: int = 1, similarity: SimilarityPolicy = nearest_patch) -> DataFrame:
    """(keys, scale, window_id, vals): a score for each column of each window's image.

    Each window meets the tokens of its references, a bounded number, in one row of the task that
    retains, scores, spreads and resizes; nothing larger than the tokens is shuffled.
    """
    keys = keys_in(encoded, "scale")
    theirs = encoded.select(*keys, F.col("window_id").alias("ref_id"), F.struct(*LEVELS).alias("tokens"))
    sent = refs.select(*keys, F.col("query_id").alias("window_id"), "rank", "ref_id").join(theirs, [*keys, "ref_id"])
    listed = sent.groupBy(*keys, "window_id").agg(F.array_sort(F.collect_list(F.struct("rank", "tokens"))).alias("refs"))
    both = encoded.select(*keys, "window_id", *LEVELS).join(listed, [*keys, "window_id"], "left")
    both = both.select(*keys, "window_id", *LEVELS, *[F.coalesce(F.col(f"refs.tokens.{c}"), F.array()).alias(f"ref_{c}") for c in LEVELS])
    resize, pools = maps.resize_weights(size, side), _pools(side)

    def scored(row: dict, level: str) -> np.ndarray:
        query = np.asarray(row[level], float).reshape(pools[level], -1)
        bank = np.array([np.asarray(x, float) for x in row[f"ref_{level}"]]).reshape(-1, *query.shape)
        return level_scores(query, bank, keep, similarity)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vals = [board_vector({level: scored(row, level) for level in LEVELS}, resize, side, shift) for row in f.to_dict("records")]
            yield f[[*keys, "window_id"]].assign(vals=vals)

    types = dict(both.dtypes)
    return both.mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in (*keys, "window_id")) + ", vals array<double>")


def memory_distances(query: np.ndarray, memory: np.ndarray, row_wise: bool) -> np.ndarray:
    """Half the least 1 - cosine of each patch with the memory's, of its own row only if so asked."""
    far = 1 - _unit(query) @ _unit(memory).T
    if row_wise:
        side = int(round(len(query) ** 0.5))
        row = np.arange(len(query)) // side
        far = np.where(row[:, None] == row[None, :], far, np.inf)
    return 0.5 * far.min(axis=1)


def detect(
    points: DataFrame, alpha: float = 0.01, size: int = 224, steps: int = 4, row_wise: bool = False, encoder: tokens.Encoder = tokens.mean_pool_encoder, shift: int = 1, **options: object
) -> tuple[DataFrame, DataFrame]:
    """(scores, intervals with severity) of a single scale: patches are compared with a memory, the
    lower median of each token over all windows of the signal, which is one row a level."""
    keys, side = keys_in(points), tokens.SIDE
    scaled = materialise(clean.minmax(clean.detrend(points)))
    encoded = materialise(tokens.encode_windows(windows.sliding_windows(scaled, [size], steps), encoder))
    each = [encoded.select(*keys, F.lit(level).alias("level"), F.posexplode(level).alias("at", "value")) for level in LEVELS]
    long = each[0].unionByName(each[1]).unionByName(each[2])
    middle = order_statistics(long, F.col("value"), [0.5], [*keys, "level", "at"], "value", discrete=True).withColumn("value", F.col("value")[0])
    rows = middle.groupBy(*keys, "level").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("m"))
    memory = rows.groupBy(*keys).agg(*[F.max(F.when(F.col("level") == level, F.col("m.value"))).alias(f"m_{level}") for level in LEVELS])
    both = encoded.select(*keys, "scale", "window_id", *LEVELS).join(memory, keys)
    resize, pools = maps.resize_weights(tokens.SIZE, side), _pools(side)

    def scored(row: dict, level: str) -> np.ndarray:
        query, known = (np.asarray(row[c], float).reshape(pools[level], -1) for c in (level, f"m_{level}"))
        return memory_distances(query, known, row_wise)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vals = [board_vector({level: scored(row, level) for level in LEVELS}, resize, side, shift) for row in f.to_dict("records")]
            yield f[[*keys, "scale", "window_id"]].assign(vals=vals)

    types = dict(both.dtypes)
    vectors = both.mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in (*keys, "scale", "window_id")) + ", vals array<double>")
    n = points.groupBy(*keys).agg(F.count("*").alias("n"))
    count = windows.window_starts(n, [size], steps).groupBy(*keys, "scale").agg(F.count("*").alias("windows"))
    shape = count.join(n, keys).withColumns({"size": F.lit(size), "step": F.lit(max(1, size // steps))})
    scores = materialise(maps.align(materialise(maps.stitch(vectors, tokens.SIZE // steps)), shape).drop("scale"))
    found = decision.decide(scores, alpha, **options)[1]
    timed = scores.join(points.select(*keys, "idx", "ts"), [*keys, "idx"]) if "ts" in points.columns else scores.withColumn("ts", F.col("idx"))
    return scores, interval_bounds(timed, found)


def scale_scores(
    points: DataFrame, scales: Sequence[int] = windows.SCALES, encoder: tokens.Encoder = tokens.mean_pool_encoder, k: int = 16, keep: int = 4,
    policy: str = "non_overlap", gap: int = 0, steps: int = 4, similarity: SimilarityPolicy = nearest_patch,
) -> DataFrame:
    """(keys, scale, idx, score) of each scale for signals (idx, value) that are long enough."""
    scaled = materialise(clean.minmax(clean.detrend(points)))
    n = points.groupBy(*keys_in(points)).agg(F.count("*").alias("n"))
    out = None
    for size in scales:
        step = max(1, size // steps)
        encoded = materialise(tokens.encode_windows(windows.sliding_windows(scaled, [size], steps), encoder))
        refs = retrieval.top_references(encoded.withColumn("vec", F.col("cls").cast("array<double>")), size, k, policy, gap)
        stitched = materialise(maps.stitch(window_vectors(encoded, refs, keep, similarity=similarity), tokens.SIZE // steps))
        count = windows.window_starts(n, [size], steps).groupBy(*keys_in(n), "scale").agg(F.count("*").alias("windows"))
        shape = count.join(n, keys_in(n)).withColumns({"size": F.lit(size), "step": F.lit(step)})
        aligned = maps.align(stitched, shape).withColumn("scale", F.lit(size))
        out = aligned if out is None else out.unionByName(aligned)
    return materialise(out)


FusionPolicy = Callable[[DataFrame], DataFrame]
DecisionPolicy = Callable[[DataFrame, float], tuple[DataFrame, DataFrame]]


def decide_all(scores: DataFrame, fuse: FusionPolicy = decision.fuse_scales, decide: DecisionPolicy = decision.decide, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """(keys, alpha, start_idx, end_idx) from scores of all scales; both policies can be replaced."""
    fused, out = materialise(fuse(scores)), None
    for a in alphas:
        found = decide(fused, a)[1].withColumn("alpha", F.lit(a))
        out = found if out is None else out.unionByName(found)
    return out


def screen(points: DataFrame, config: ScreeningConfig | None = None, encoder: tokens.Encoder = tokens.mean_pool_encoder, similarity: SimilarityPolicy = nearest_patch) -> DataFrame:
    """(keys, alpha, start_idx, end_idx) of signals by a configuration."""
    c = config or ScreeningConfig()
    scores = scale_scores(points, c.scales, encoder, c.top_k, c.retained, c.policy, c.gap, c.steps, similarity)

    def fuse(df: DataFrame) -> DataFrame:
        return decision.fuse_scales(df, c.weights or None, c.scales)

    def decide(df: DataFrame, alpha: float) -> tuple[DataFrame, DataFrame]:
        return decision.decide(df, alpha, c.method, c.smoothing, c.sliding, c.padding)

    return decide_all(scores, fuse, decide, c.alphas)


def replay(rows: DataFrame, alpha: float) -> DataFrame:
    """The rows of one alpha, equal within 1e-12."""
    return rows.where(F.abs(F.col("alpha") - F.lit(alpha)) < 1e-12)
