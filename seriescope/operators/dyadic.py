"""Overlaps of intervals by dyadic cells, without the pairs that overlap.

Two intervals overlap exactly if the first starts within the second or after its start, not both:
either the first one's start lies in the second, or the second one's start lies in the rest of the
first. A point lies in an interval exactly if one of the point's cells, one a level, is one of the
few cells that make up the interval. So both cases are joins on cells, and what an interval asks of
all that it overlaps (a least value, whether any exists) is summed up in each cell before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriescope.operators.common import materialise

_CELL = "struct<level:int,cell:bigint>"


def _levels(top: int) -> Column:
    return F.sequence(F.lit(0), F.lit(top))


def _struct(level: Column, cell: Column) -> Column:
    return F.struct(level.cast("int").alias("level"), cell.cast("long").alias("cell"))


def cover(start: Column, end: Column, top: int) -> Column:
    """The disjoint cells of levels 0 to ``top`` that make up the closed interval; a cell of level k
    holds 2^k indices. At each level one cell at most is cut off at either end."""

    def cut(level: Column) -> Column:
        first, past = -F.call_function("shiftright", -start, level), F.call_function("shiftright", end + 1, level)
        some = first < past
        odd = F.lit(1).cast("long")
        return F.array(F.when(some & (first.bitwiseAND(odd) == 1), _struct(level, first)), F.when(some & (past.bitwiseAND(odd) == 1), _struct(level, past - 1)))

    return F.filter(F.flatten(F.transform(_levels(top), cut)), lambda x: x.isNotNull())


def above(point: Column, top: int) -> Column:
    """The cells of levels 0 to ``top`` that hold a point."""
    return F.transform(_levels(top), lambda level: _struct(level, F.call_function("shiftright", point, level)))


def _holding_both(good: DataFrame, bank: DataFrame, by: list[str], values: dict[str, tuple[Column, Callable[[Column], Column]]], top: int) -> DataFrame:
    """The ``good`` intervals (by, __row, __a, __b) that hold both ends of an interval of ``bank`` whose
    end lies before its start, with its ``values``. Their ends meet in cells; within a cell both sides
    are put in order, and values are carried on from the starts that an interval reaches."""
    back = bank.where("end_idx < start_idx").select(*by, F.explode(above(F.col("end_idx").cast("long"), top)).alias("__cell"), F.col("start_idx").cast("long").alias("__at"), *[c.alias(n) for n, (c, _) in values.items()])
    # Summed up and written first, so that only cells with such ends are looked at.
    back = materialise(back.groupBy(*by, "__cell", "__at").agg(*[f(F.col(n)).alias(n) for n, (_, f) in values.items()]))
    cells = good.withColumn("__cell", F.explode(cover(F.col("__a"), F.col("__b"), top))).select(*by, "__cell", F.col("__b").alias("__at"), "__row")
    both = cells.join(back.select(*by, "__cell").distinct(), [*by, "__cell"], "left_semi").unionByName(back, allowMissingColumns=True)
    reached = Window.partitionBy(*by, "__cell").orderBy("__at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.select(*by, "__row", *[f(F.col(n)).over(reached).alias(n) for n, (_, f) in values.items()])
    # Every interval of the bank has a value, so a row without one has met none.
    return carried.where(F.col("__row").isNotNull() & F.coalesce(*[F.col(n).cast("string") for n in values]).isNotNull())


def overlapping(
    asked: DataFrame, bank: DataFrame, by: list[str], values: dict[str, tuple[Column, Callable[[Column], Column]]], start: str = "start_idx", end: str = "end_idx", crossed: bool = False,
) -> DataFrame:
    """``asked`` (by, other columns, ``start``, ``end``; distinct rows) with the ``values`` of the
    intervals of ``bank`` (by, start_idx, end_idx) of the same group that overlap it; null where none does.

    ``values``: for each name a column of ``bank`` and an aggregate that may be taken of aggregates
    (min, max, bool_or). Intervals whose end lies before their start, or without one, overlap nothing;
    with ``crossed`` such an interval of ``bank`` overlaps what holds both its ends, as it does where
    each start is compared with the other's end.
    Rows grow by the logarithm of the longest interval, whatever overlaps what.
    """
    fine = bank.where("end_idx >= start_idx").select(*by, F.col("start_idx").cast("long").alias("__s"), F.col("end_idx").cast("long").alias("__e"), *[c.alias(n) for n, (c, _) in values.items()])
    rest = [c for c in asked.columns if c not in by]
    q = asked.withColumns({"__a": F.col(start).cast("long"), "__b": F.col(end).cast("long")})
    good = q.where("__b >= __a").select(*by, F.struct(*rest).alias("__row"), "__a", "__b")

    def top(df: DataFrame, size: Column) -> int:
        longest = df.agg(F.max(size).alias("n")).first()["n"]
        return max(0, int(longest or 1).bit_length())

    held, wide = top(fine, F.col("__e") - F.col("__s") + 1), top(good, F.col("__b") - F.col("__a"))

    def joined(cells_of_bank: Column, cells_of_asked: Column) -> DataFrame:
        # Written first, so that the join with the cells of a long signal can be split.
        cells = materialise(fine.withColumn("__cell", F.explode(cells_of_bank)).groupBy(*by, "__cell").agg(*[f(F.col(n)).alias(n) for n, (_, f) in values.items()]))
        return good.withColumn("__cell", F.explode(cells_of_asked)).join(cells, [*by, "__cell"]).select(*by, "__row", *values)

    stabbed = joined(cover(F.col("__s"), F.col("__e"), held), above(F.col("__a"), held))
    started = joined(above(F.col("__s"), wide), cover(F.col("__a") + 1, F.col("__b"), wide))
    met = stabbed.unionByName(started)
    if crossed:
        met = met.unionByName(_holding_both(good, bank, by, values, wide + 1))
    found = met.groupBy(*by, "__row").agg(*[f(F.col(n)).alias(n) for n, (_, f) in values.items()])
    plain = found.select(*by, *[F.col("__row")[c].alias(c) for c in rest], *values)
    missing = asked.select(*by, *rest)
    named = plain.withColumnsRenamed({c: f"__{c}" for c in (*by, *rest)})
    on = F.lit(True)
    for c in (*by, *rest):
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return missing.join(named, on, "left").drop(*[f"__{c}" for c in (*by, *rest)])
