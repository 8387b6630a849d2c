"""Images of windows, their patch tokens and pooled levels.

The encoder is an interface: a function from a batch of images to patch tokens. The one given here
is a deterministic stand-in without learned weights, for offline use and tests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriescope.operators.common import keys_in

SIZE, SIDE = 224, 14
#: Pooling levels: side of a pool in patches.
LEVELS = {"mid": 2, "large": 3}

Encoder = Callable[[np.ndarray], np.ndarray]
#: What an encoder gets of a batch of images.
Adapter = Callable[[np.ndarray], np.ndarray]


def pool_masks(spark: SparkSession, side: int = SIDE, levels: dict[str, int] | None = None) -> DataFrame:
    """(level, group_id, cell_id): which patches of a ``side`` x ``side`` board each pool covers, pools
    standing one patch apart."""
    parts = []
    for level, k in (levels or LEVELS).items():
        n = side - k + 1
        corner = spark.range(n * n).select(F.lit(level).alias("level"), F.col("id").alias("group_id"))
        offsets = F.explode(F.array(*[F.lit(r * side + c) for r in range(k) for c in range(k)])).alias("__o")
        cell = F.floor(F.col("group_id") / n) * side + F.col("group_id") % n
        parts.append(corner.select("level", "group_id", cell.alias("__c"), offsets).select("level", "group_id", (F.col("__c") + F.col("__o")).cast("long").alias("cell_id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pool_tokens(tokens: DataFrame, masks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, level, group_id, dim, value): mean of the member patches of each pool. ``tokens``: by,
    patch_id, dim, value."""
    keys = by if by is not None else keys_in(tokens, "scale", "window_id")
    joined = tokens.join(F.broadcast(masks), F.col("patch_id") == F.col("cell_id"))  # masks depend on the board only
    return joined.groupBy(*keys, "level", "group_id", "dim").agg(F.avg("value").alias("value"))


def class_token(tokens: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, dim, value): the mean of a window's patch tokens."""
    keys = by if by is not None else keys_in(tokens, "scale", "window_id")
    return tokens.groupBy(*keys, "dim").agg(F.avg("value").alias("value"))


def draw_line(vals: np.ndarray, size: int = SIZE) -> np.ndarray:
    """A white square image, values 0 to 1, with the series as a black line from 0 at the bottom to 1
    at the top; its pixels follow from the vertical extent that the line has in each column."""
    y = (1 - np.clip(np.nan_to_num(np.asarray(vals, float)), 0, 1)) * (size - 1)
    x = np.linspace(0, size - 1, len(y)) if len(y) > 1 else np.zeros(1)
    edges = np.arange(size + 1) - 0.5
    at = np.interp(np.clip(edges, 0, size - 1), x, y)
    low, high = np.minimum(at[:-1], at[1:]), np.maximum(at[:-1], at[1:])
    cols = np.clip(np.rint(x).astype(int), 0, size - 1)
    np.minimum.at(low, cols, y)
    np.maximum.at(high, cols, y)
    rows = np.arange(size)[:, None]
    return np.where((rows >= np.floor(low)[None, :]) & (rows <= np.ceil(high)[None, :]), 0.0, 1.0)


def mean_pool_encoder(images: np.ndarray, side: int = SIDE, dims: int = 8) -> np.ndarray:
    """[n, h, w] -> [n, side * side, dims]: mean brightness of each patch along a fixed direction, and
    its place, so that patches differ."""
    n, h, w = images.shape
    pooled = images.reshape(n, side, h // side, side, w // side).mean(axis=(2, 4)).reshape(n, side * side, 1)
    return pooled * np.linspace(0.1, 1.0, dims) + (np.arange(side * side) / (side * side))[None, :, None]


def input_adapter(mode: str = "legacy", preprocess: Callable[[np.ndarray], np.ndarray] | None = None) -> Adapter:
    """Images as an encoder wants them: ``legacy`` passes them on as floats, ``official`` gives each to
    the encoder's own ``preprocess``, as bytes with three channels last."""
    if mode not in ("legacy", "official"):
        raise ValueError(f"unknown input mode: {mode}")
    if mode == "legacy":
        return lambda images: np.asarray(images, np.float32)
    if preprocess is None:
        raise ValueError("official input needs the encoder's preprocessing")

    def official(images: np.ndarray) -> np.ndarray:
        levels = np.rint(np.clip(images, 0, 1) * 255).astype(np.uint8)
        return np.stack([preprocess(np.repeat(x[..., None], 3, axis=-1)) for x in levels])

    return official


def encode_windows(windows: DataFrame, encoder: Encoder = mean_pool_encoder, batch: int = 20, side: int = SIDE, adapter: Adapter | None = None) -> DataFrame:
    """(keys, scale, window_id, start_idx, cls, patch, mid, large): the mean token and the flattened
    token matrices of each window (``vals``), encoded in batches; the levels are means over pools.
    ``adapter``: what makes the encoder's input of drawn images; None gives them as they are."""
    keys = keys_in(windows, "scale", "window_id", "start_idx")
    pools = {}
    for level, k in LEVELS.items():
        n = side - k + 1
        pools[level] = np.array([[(r + i) * side + c + j for i in range(k) for j in range(k)] for r in range(n) for c in range(n)])
    names = ["cls", "patch", "mid", "large"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vals = b.column(len(keys)).to_pylist()
            flat: dict[str, list] = {name: [] for name in names}
            for i in range(0, len(vals), batch):
                images = np.stack([draw_line(np.array(v)) for v in vals[i : i + batch]])
                tokens = encoder(images if adapter is None else adapter(images))
                flat["cls"] += [t.mean(axis=0).astype(np.float32) for t in tokens]
                flat["patch"] += [t.ravel().astype(np.float32) for t in tokens]
                for level, members in pools.items():
                    flat[level] += [t[members].mean(axis=1).ravel().astype(np.float32) for t in tokens]
            cols = [b.column(i) for i in range(len(keys))] + [pa.array(flat[c], pa.list_(pa.float32())) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, *names])

    types = dict(windows.dtypes)
    return windows.select(*keys, "vals").mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keys) + "".join(f", {n} array<float>" for n in names))
