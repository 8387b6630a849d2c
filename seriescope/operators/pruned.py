"""The nearest references of a signal's windows without comparing all pairs of its blocks.

Windows are dealt into blocks around pivots. Angles obey the triangle inequality, so two blocks whose
pivots lie further apart than both radii and the angle of the worst k-th find hold no better pair.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriescope.functions.numeric import dot, unit
from seriescope.operators.common import keys_in, materialise
from seriescope.operators.retrieval import BLOCK, POLICIES, WIDE, _nearest_in, packed

#: Most pivots of a signal and those for each block of it, parts that each part meets first, and what
#: rounding may do to an angle.
PIVOTS, PER_BLOCK, FIRST, SLACK = 64, 8, 3, 1e-6


def _to_pivots(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Rows of side 0 with the pivot (side 1) that they lie nearest to and the angle between; a row
    without a direction gets no pivot (-1) and half a turn."""
    rows, pivots = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1].sort_values("window_id")
    x = np.stack(rows["vec"].to_numpy())
    cos = x @ np.stack(pivots["vec"].to_numpy()).T
    best = cos.argmax(axis=1)
    flat = np.linalg.norm(x, axis=1) < 0.5
    angle = np.where(flat, math.pi, np.arccos(np.clip(cos[np.arange(len(x)), best], -1, 1)))
    out = rows[[*keys, "window_id", "start_idx", "vec"]].copy()
    return out.assign(pivot=np.where(flat, -1, best), angle=angle)


def pivot_blocks(base: DataFrame, keys: list[str], pivots: int = PIVOTS, block: int = BLOCK // 2) -> tuple[DataFrame, DataFrame]:
    """(rows with ``part``; a row a part with its centre, radius and number of rows).

    Pivots are windows drawn by a hash, PER_BLOCK for each block of the signal and ``pivots`` at most. Rows meet them in tasks of ``block`` windows; a pivot with more
    rows than a block has several parts, over which a hash deals them."""
    order = Window.partitionBy(*keys).orderBy(F.xxhash64("window_id"), "window_id")
    drawn = base.where(F.exists("vec", lambda x: x != 0)).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= pivots)
    enough = base.groupBy(*keys).agg(F.ceil(F.count("*") * PER_BLOCK / block).alias("__enough"))
    drawn = drawn.join(enough, keys).where("__r <= __enough").select(*base.columns)
    # A signal of zero vectors alone has one of these as its pivot.
    bare = base.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in base.columns if c not in keys]), "window_id").alias("p"))
    drawn = materialise(drawn.unionByName(bare.join(drawn, keys, "left_anti").select(*keys, "p.*")))
    dealt = base.withColumn("deal", F.floor(F.col("window_id") / block))
    deals = dealt.select(*keys, "deal").distinct()
    both = dealt.withColumn("side", F.lit(0)).unionByName(drawn.join(deals, keys).withColumn("side", F.lit(1)))
    types = dict(base.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in (*keys, "window_id", "start_idx", "vec")) + ", pivot long, angle double"
    near = materialise(both.groupBy(*keys, "deal").applyInPandas(lambda pdf: _to_pivots(pdf, keys), schema))
    sizes = near.groupBy(*keys, "pivot").agg(F.ceil(F.count("*") / block).alias("__parts"))
    part = F.col("pivot") * (1 << 32) + F.pmod(F.xxhash64("window_id"), F.col("__parts"))
    rows = materialise(near.join(sizes, [*keys, "pivot"]).withColumn("part", part).drop("__parts"))
    centres = drawn.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("window_id", "vec"))), lambda x: x["vec"]).alias("__pivots"))
    parts = rows.groupBy(*keys, "part", "pivot").agg(F.max("angle").alias("radius"), F.count("*").alias("size")).join(centres, keys)
    centre = F.when(F.col("pivot") >= 0, F.get("__pivots", F.col("pivot").cast("int")))
    return rows, materialise(parts.select(*keys, "part", "radius", "size", centre.alias("centre")))


def part_pairs(parts: DataFrame, keys: list[str], first: int = FIRST) -> DataFrame:
    """(keys, qp, rp, bound, early) of all pairs of a signal's parts: the largest cosine that rows of
    both may have, and whether the pair is among the ``first`` of its queries."""
    q = parts.select(*keys, F.col("part").alias("qp"), F.col("radius").alias("__qr"), F.col("centre").alias("__qc"))
    r = parts.select(*keys, F.col("part").alias("rp"), F.col("radius").alias("__rr"), F.col("centre").alias("__rc"))
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("__qc"), F.col("__rc")))))
    least = F.greatest(F.lit(0.0), F.coalesce(apart - F.col("__qr") - F.col("__rr"), F.lit(0.0)) - SLACK)
    pairs = q.join(r, keys).select(*keys, "qp", "rp", F.coalesce(apart, F.lit(0.0)).alias("__apart"), F.cos(least).alias("bound"))
    order = Window.partitionBy(*keys, "qp").orderBy("__apart", "rp")
    return pairs.withColumn("early", F.row_number().over(order) <= first).drop("__apart")


def late_pairs(pairs: DataFrame, parts: DataFrame, rows: DataFrame, found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Pairs that weren't among the first and may hold a better reference than the ``k``-th that a query
    of the part has ``found`` (keys, query_id, rank, sim); a query with fewer keeps all pairs of its part."""
    kth = found.where(F.col("rank") == k).select(*keys, F.col("query_id").alias("window_id"), "sim")
    floors = rows.select(*keys, "part", "window_id").join(kth, [*keys, "window_id"]).groupBy(*keys, "part").agg(F.min("sim").alias("__least"), F.count("*").alias("__n"))
    floor = F.when(F.col("__n") == F.col("size"), F.col("__least"))
    known = parts.join(floors, [*keys, "part"], "left").select(*keys, F.col("part").alias("qp"), floor.alias("floor"))
    return pairs.where("not early").join(known, [*keys, "qp"]).where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK)).select(*keys, "qp", "rp")


def nearest_references(windows: DataFrame, length: int, k: int = 16, policy: str = "non_overlap", gap: int = 0, vec: str = "vec", by: list[str] | None = None, pivots: int = PIVOTS, block: int = BLOCK // 2, first: int = FIRST) -> DataFrame:
    """(by, query_id, rank, ref_id, sim): what ``top_references`` gives, exactly.

    Each part first meets its own and the parts beside it; then only those that can hold a better
    reference than the worst ``k``-th found so far. Clustered vectors leave few pairs of parts;
    vectors in all directions leave all, and cost the pass over the pivots on top.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy: {policy}")
    keys = by if by is not None else keys_in(windows, "scale")
    if not keys:
        windows, keys = windows.withColumn("__all", F.lit(0)), ["__all"]
    k = max(1, k)
    base = materialise(windows.select(*keys, F.col("window_id").cast("long").alias("window_id"), F.col("start_idx").cast("long").alias("start_idx"), unit(F.col(vec)).alias("vec")))
    rows, parts = pivot_blocks(base, keys, pivots, block)
    pairs = materialise(part_pairs(parts, keys, first))
    types = dict(base.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", query_id long, ref_id long, sim double"
    sent = materialise(packed(rows, keys, "part"))
    sizes = parts.select(*keys, F.col("part").alias("rp"), "size")
    order = Window.partitionBy(*keys, "query_id").orderBy(F.desc("sim"), "ref_id")

    def best(some: DataFrame) -> DataFrame:
        return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def compared(asked: DataFrame) -> DataFrame:
        # A task meets a part with as many others as hold a block of references.
        placed = F.floor((F.sum("size").over(Window.partitionBy(*keys, "qp").orderBy("rp")) - 1) / (WIDE * BLOCK))
        dealt = asked.join(sizes, [*keys, "rp"]).withColumn("deal", placed)
        q = sent.join(dealt.select(*keys, F.col("qp").alias("part"), "qp", "deal").distinct(), [*keys, "part"]).withColumn("side", F.lit(0))
        r = sent.join(dealt.select(*keys, F.col("rp").alias("part"), "qp", "deal"), [*keys, "part"]).withColumn("side", F.lit(1))
        return q.unionByName(r).drop("part").groupBy(*keys, "qp", "deal").applyInArrow(_nearest_in(keys, length, k, policy, gap), schema)

    early = materialise(best(compared(pairs.where("early").select(*keys, "qp", "rp"))))
    late = compared(late_pairs(pairs, parts, rows, early, keys, k))
    return best(early.drop("rank").unionByName(late)).select(*[c for c in keys if c != "__all"], "query_id", "rank", "ref_id", "sim")
