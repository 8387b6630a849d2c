"""Exact order statistics of groups of any size by repeated narrowing.

A task never holds the distinct values of a group: brackets around the wanted ranks are cut by pivots
from a sketch of bounded size, values are counted between the pivots, and the part that holds a rank
is the next bracket. What is left of a bracket in the end is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriescope.operators.common import materialise

#: Values that a task may sort; pivots of a bracket, the accuracy of the sketch that they come from, and
#: brackets that are sent to all tasks.
LIMIT, PIVOTS, ACCURACY, FEW = 65_536, 64, 1000, 10_000


_BRACKET = ["__key", "__lo", "__hi"]


def _in_brackets(rows: DataFrame, brackets: DataFrame, few: bool) -> DataFrame:
    b = brackets.select("__key", "__lo", "__hi").distinct()
    b = F.broadcast(b) if few else b
    return rows.join(b, (rows["__key"] == b["__key"]) & (F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi"))).drop(b["__key"])


def _narrowed(rows: DataFrame, big: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Brackets (key, rank, below, inside, lo, hi) -> the parts that hold their ranks, between pivots at
    ``shares`` of a bracket.

    Only brackets of more values than a task may sort come here, so few that they go to all tasks: rows
    stay where they are, as the rows of a few groups would all meet in a few tasks."""
    met = _in_brackets(rows, big, few=True)
    cut = materialise(met.groupBy(*_BRACKET).agg(F.percentile_approx("__v", F.array(*map(F.lit, shares)), ACCURACY).alias("__p")))
    # A pivot is a part of its own, so a value that fills most of a bracket is set apart.
    part = 2 * F.size(F.filter("__p", lambda p: p < F.col("__v"))) + F.array_contains("__p", F.col("__v")).cast("int")
    counts = met.join(F.broadcast(cut), _BRACKET).groupBy(*_BRACKET, part.alias("__part")).agg(F.count("*").alias("__c"), F.min("__v").alias("__l"), F.max("__v").alias("__h"))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy(*_BRACKET).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = big.join(counts.withColumn("__before", before), _BRACKET).withColumn("__below", F.col("__below") + F.col("__before"))
    holds = (F.col("__below") <= F.col("__rank")) & (F.col("__rank") < F.col("__below") + F.col("__c"))
    return placed.where(holds).select("__key", "__rank", "__below", F.col("__c").alias("__inside"), F.col("__l").alias("__lo"), F.col("__h").alias("__hi"))


def _at_ranks(rows: DataFrame, ranks: DataFrame, near: Sequence[float], limit: int, pivots: int) -> DataFrame:
    """(key, rank, value) of the wanted ranks, which count from 0; ``ranks`` also has the groups' sizes.
    The first pivots are those at the shares ``near``."""
    state = ranks.select("__key", "__rank", F.lit(0).cast("long").alias("__below"), F.col("__n").alias("__inside"), F.lit(float("-inf")).alias("__lo"), F.lit(float("nan")).alias("__hi"))
    state = materialise(state)
    wide = (F.col("__inside") > limit) & (F.col("__lo") < F.col("__hi"))
    while not state.where(wide).isEmpty():
        state = materialise(state.where(~wide).unionByName(_narrowed(rows, state.where(wide), near)))
        near = [i / pivots for i in range(1, pivots)]
    open_ = state.where("__lo < __hi")
    listed = _in_brackets(rows, open_, open_.count() <= FEW).groupBy(*_BRACKET).agg(F.sort_array(F.collect_list("__v")).alias("__list"))
    picked = open_.join(listed, _BRACKET).select("__key", "__rank", F.get("__list", (F.col("__rank") - F.col("__below")).cast("int")).alias("__value"))
    return picked.unionByName(state.where("not __lo < __hi").select("__key", "__rank", F.col("__lo").alias("__value")))


def order_statistics(df: DataFrame, value: Column, shares: Sequence[float], by: list[str], name: str, discrete: bool = False, limit: int = LIMIT, pivots: int = PIVOTS) -> DataFrame:
    """(by, ``name``): an array with the percentile of each share, exactly as the built-in aggregates
    give it: between neighbours, or ``discrete`` the first value that the share reaches.

    Nulls don't count, NaN is the largest value, and a group of nulls only has no row. ``df`` is read
    several times, so a caller writes it first. Groups of up to ``limit`` values need no narrowing.
    """
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("__all"))
    rows = df.select(key.alias("__key"), value.cast("double").alias("__v")).where("__v is not null")
    sizes = materialise(rows.groupBy("__key").agg(F.count("*").alias("__n")))
    back = [F.col("__key")[c].alias(c) for c in by]
    if (sizes.agg(F.max("__n").alias("n")).first()["n"] or 0) <= limit:
        if discrete:
            found = F.array(*[F.expr(f"percentile_disc({s!r}) within group (order by __v)") for s in shares])
        else:
            found = F.percentile("__v", F.array(*map(F.lit, shares)))
        return rows.groupBy("__key").agg(found.alias(name)).select(*back, name)
    at = F.col("__at")
    places = F.array(*[F.greatest(F.ceil(F.lit(s) * F.col("__n")) - 1, F.lit(0)).cast("double") if discrete else F.lit(s) * (F.col("__n") - 1) for s in shares])
    wanted = sizes.select("__key", "__n", F.posexplode(places).alias("__i", "__at")).withColumns({"__low": F.floor(at), "__high": F.ceil(at)})
    ranks = wanted.select("__key", "__n", F.explode(F.array("__low", "__high")).alias("__rank")).distinct()
    # Pivots on both sides of each share, further off than the sketch errs, leave few values between them.
    near = sorted({min(max(s + e / ACCURACY, 0.0), 1.0) for s in shares for e in (-2, 2)})
    found = materialise(_at_ranks(rows, ranks, near, limit, pivots))
    low, high = (found.select("__key", F.col("__rank").alias(r), F.col("__value").alias(v)) for r, v in (("__low", "__x"), ("__high", "__y")))
    both = wanted.join(low, ["__key", "__low"]).join(high, ["__key", "__high"])
    between = F.when(F.col("__x") == F.col("__y"), F.col("__x")).otherwise((F.col("__high") - at) * F.col("__x") + (at - F.col("__low")) * F.col("__y"))
    each = both.groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("__i", between.alias("v")))).alias("__s"))
    return each.select(*back, F.col("__s.v").alias(name))
