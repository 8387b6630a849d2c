"""Aggregates over many index ranges of signals by a tree of blocks.

Points are read once, into blocks; sixteen neighbours at a time are summed up into nodes above them. A
range is made of a few whole nodes a level and of parts of the blocks at its two ends, so what it costs
grows with the logarithm of its length, however many ranges share the points.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriescope.operators.common import materialise

#: Indices of a block, and nodes that one node above them holds.
BLOCK, FAN = 256, 16


class Kind(NamedTuple):
    """What is kept of a point, of a group of rows, and of two neighbours, the left one first."""

    point: Callable[[Column], Column]
    rows: Callable[[Column], Column]
    merge: Callable[[Column, Column], Column]


def _moments(n: Column, total: Column, squares: Column) -> Column:
    return F.struct(n.cast("long").alias("n"), total.cast("double").alias("total"), squares.cast("double").alias("squares"))


def _merged_moments(a: Column, b: Column) -> Column:
    """Squares are about the mean, so a small spread far from zero isn't lost."""
    n, apart = a["n"] + b["n"], b["total"] / b["n"] - a["total"] / a["n"]
    between = F.when((a["n"] > 0) & (b["n"] > 0), apart * apart * a["n"] * b["n"] / n).otherwise(0.0)
    return _moments(n, a["total"] + b["total"], a["squares"] + b["squares"] + between)


def _moments_of_rows(v: Column) -> Column:
    n = F.count(v)
    return _moments(n, F.coalesce(F.sum(v), F.lit(0.0)), F.coalesce(F.var_pop(v) * n, F.lit(0.0)))


def _kept(v: Column) -> Column:
    return F.struct(v.alias("value"))


#: Nulls count in ``count``, ``first`` and ``last`` only; NaN is the largest value.
KINDS = {
    "count": Kind(lambda v: F.lit(1).cast("long"), lambda v: F.count(F.lit(1)), lambda a, b: a + b),
    "min": Kind(lambda v: v, F.min, F.least),
    "max": Kind(lambda v: v, F.max, F.greatest),
    "first": Kind(_kept, lambda v: F.min_by(_kept(v), "idx"), lambda a, b: a),
    "last": Kind(_kept, lambda v: F.max_by(_kept(v), "idx"), lambda a, b: b),
    "moments": Kind(lambda v: _moments(v.isNotNull().cast("long"), F.coalesce(v.cast("double"), F.lit(0.0)), F.coalesce(v.cast("double") - v.cast("double"), F.lit(0.0))), _moments_of_rows, _merged_moments),
}


def mean_of(moments: Column) -> Column:
    """The mean, null where no value counts."""
    return F.when(moments["n"] > 0, moments["total"] / moments["n"])


def deviation_of(moments: Column) -> Column:
    """The standard deviation of all values, null where none counts."""
    return F.when(moments["n"] > 0, F.sqrt(moments["squares"] / moments["n"]))


def _cover(first: Column, past: Column, levels: int, fan: int) -> Column:
    """(level, cell) of the nodes that make up the blocks from ``first`` to before ``past``; a node of
    level k holds fan^k blocks."""

    def held(level: int) -> tuple[Column, Column]:
        size = fan**level
        return F.ceil(first / size).cast("long"), F.floor(past / size).cast("long")

    def listed(level: int, a: Column, b: Column) -> Column:
        cells = F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(cells, lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell")))

    out = []
    for level in range(levels):
        a, b = held(level)
        if level + 1 == levels:
            out.append(listed(level, a, b))
            continue
        up, down = held(level + 1)
        some = up < down
        out += [listed(level, a, F.when(some, up * fan).otherwise(b)), listed(level, F.when(some, down * fan).otherwise(b), b)]
    return F.flatten(F.array(*out))


class Tree:
    """Blocks of the points (by, idx) of all signals and the nodes above them, written once, so every
    later question reads nodes and the blocks at its ends.

    ``values``: a name of KINDS and a column for each result; ``first`` and ``last`` go by idx and give
    a row with the ``value``, ``moments`` one for ``mean_of`` and ``deviation_of``."""

    def __init__(self, points: DataFrame, values: dict[str, tuple[str, Column]], by: list[str], block: int = BLOCK, fan: int = FAN) -> None:
        self.kinds, self.by, self.block, self.fan = {n: KINDS[k] for n, (k, _) in values.items()}, by, block, fan
        named = points.select(*by, "idx", *[c.alias(n) for n, (_, c) in values.items()])
        node = F.struct(*[k.rows(F.col(n)).alias(n) for n, k in self.kinds.items()])
        rows = F.array_sort(F.collect_list(F.struct("idx", *values)), lambda a, b: F.when(a["idx"] < b["idx"], -1).when(a["idx"] > b["idx"], 1).otherwise(0))
        made = named.groupBy(*by, F.floor(F.col("idx") / block).alias("__cell")).agg(rows.alias("__points"), node.alias("__node"))
        # Where a block's indices follow each other, a range of it is a slice and its other points aren't looked at.
        apart = F.array_distinct(F.transform("__points", lambda p, i: p["idx"] - i))
        self.blocks = materialise(made.withColumn("__from", F.when(F.size(apart) == 1, F.get(apart, F.lit(0)))))
        ends = self.blocks.agg(F.min("__cell").alias("low"), F.max("__cell").alias("high")).first()
        self.low, self.high = (0, -1) if ends["low"] is None else (ends["low"], ends["high"])
        level = self.blocks.select(*by, F.lit(0).alias("__level"), "__cell", "__node")
        self.nodes, self.levels = level, 1
        while (self.high - self.low + 1) > fan**self.levels:
            cells = F.array_sort(F.collect_list(F.struct("__cell", "__node")), lambda a, b: F.when(a["__cell"] < b["__cell"], -1).otherwise(1))
            up = level.groupBy(*by, F.floor(F.col("__cell") / fan).alias("__up")).agg(cells.alias("__c"))
            level = materialise(up.select(*by, F.lit(self.levels).alias("__level"), F.col("__up").alias("__cell"), self._merged(F.col("__c")["__node"]).alias("__node")))
            self.nodes, self.levels = self.nodes.unionByName(level), self.levels + 1

    def _merged(self, nodes: Column) -> Column:
        """One node from a list of nodes in order."""

        def two(a: Column, b: Column) -> Column:
            return F.struct(*[k.merge(a[n], b[n]).alias(n) for n, k in self.kinds.items()])

        return F.aggregate(F.slice(nodes, 2, F.greatest(F.size(nodes) - 1, F.lit(0))), F.get(nodes, F.lit(0)), two)

    def ask(self, requests: DataFrame) -> DataFrame:
        """(request columns, results): aggregates of the points from ``start_idx`` to ``end_idx`` of each
        request (by, start_idx, end_idx, other columns).

        Requests without a point, with an end before their start or with a null key or end have no row;
        equal requests have one. A request meets fewer than 2 ``fan`` nodes a level and two blocks.
        """
        by, block, fan = self.by, self.block, self.fan
        inside = {"__s": F.greatest(F.col("start_idx"), F.lit(self.low * block)).cast("long"), "__e": F.least(F.col("end_idx"), F.lit((self.high + 1) * block - 1)).cast("long")}
        known = requests.where("start_idx is not null and end_idx is not null").distinct()
        asked = known.select(*by, F.struct(*requests.columns).alias("__row"), *[c.alias(n) for n, c in inside.items()]).where("__s <= __e")
        asked = asked.withColumns({"__a": F.floor(F.col("__s") / block), "__b": F.floor(F.col("__e") / block)})

        whole = asked.select(*by, "__row", F.explode(_cover(F.col("__a") + 1, F.col("__b"), self.levels, fan)).alias("__n"))
        whole = whole.select(*by, "__row", F.col("__n.level").alias("__level"), F.col("__n.cell").alias("__cell")).join(self.nodes, [*by, "__level", "__cell"])
        place = (F.col("__cell") * F.pow(F.lit(float(fan)), F.col("__level"))).cast("long")
        pieces = whole.select("__row", place.alias("__at"), "__node")

        cut = asked.select(*by, "__row", "__s", "__e", F.explode(F.array_distinct(F.array("__a", "__b"))).alias("__cell")).join(self.blocks.drop("__node"), [*by, "__cell"])
        low, high = F.greatest(F.col("__s") - F.col("__from"), F.lit(0)), F.least(F.col("__e") - F.col("__from") + 1, F.size("__points"))
        sliced = F.slice("__points", (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
        held = F.when(F.col("__from").isNotNull(), sliced).otherwise(F.filter("__points", lambda p: p["idx"].between(F.col("__s"), F.col("__e"))))
        cut = cut.withColumn("__held", F.transform(held, lambda p: F.struct(*[k.point(p[n]).alias(n) for n, k in self.kinds.items()]))).where(F.size("__held") > 0)
        pieces = pieces.unionByName(cut.select("__row", F.col("__cell").alias("__at"), self._merged(F.col("__held")).alias("__node")))

        each = pieces.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("__at", "__node")), lambda a, b: F.when(a["__at"] < b["__at"], -1).otherwise(1)).alias("__c"))
        return each.select("__row.*", self._merged(F.col("__c")["__node"]).alias("__n")).select(*requests.columns, *[F.col("__n")[n].alias(n) for n in self.kinds])


def range_aggregates(points: DataFrame, requests: DataFrame, values: dict[str, tuple[str, Column]], by: list[str], block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Aggregates of ``points`` in each of ``requests`` by a tree that serves this question only."""
    return Tree(points, values, by, block, fan).ask(requests)
