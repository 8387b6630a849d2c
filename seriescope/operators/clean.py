"""Cleaning and scaling of signals (rows dataset, signal_id, ts, value, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriescope.functions.numeric import finite_or
from seriescope.operators.common import STRETCH, along, keys_in, materialise, per_signal, stretch_of


def time_index(df: DataFrame, ts: str = "ts", *ties: str, spread: bool = False, part: Column | None = None) -> DataFrame:
    """Add ``idx``: the place of a row in its signal by time, from 0.

    Each signal is numbered by one task. For tables in which one signal may hold much of the rows,
    ``part`` is a column that never falls along ``ts``, such as its day: parts are numbered each and
    moved by the sizes of the parts before. With ``spread`` ranges of time are found by sampling; the
    dealt rows are written once, so that both passes see the same ranges.
    """
    keys = keys_in(df)
    if part is not None:
        parted = df.withColumn("__p", part)
        sizes = parted.groupBy(*keys, "__p").agg(F.count("*").alias("__n"))
        ahead = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
        before = sizes.select(*keys, F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
        own = F.row_number().over(Window.partitionBy(*keys, "__p").orderBy(ts, *ties))
        joined = parted.withColumn("__own", own).join(before.withColumnsRenamed({k: f"__{k}" for k in keys}), [F.col("__p").eqNullSafe(F.col("__q")), *[F.col(k) == F.col(f"__{k}") for k in keys]])
        return joined.withColumn("idx", (F.col("__before") + F.col("__own") - 1).cast("long")).drop("__p", "__q", "__own", "__before", *[f"__{k}" for k in keys])
    if not spread:
        return df.withColumn("idx", (F.row_number().over(along(df, ts, *ties)) - 1).cast("long"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(df.repartitionByRange(parts, *keys, ts, *ties).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "__p").agg(F.count("*").alias("__n"))
    ahead = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*keys, "__p", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(*keys, "__p").orderBy(ts, *ties))
    return ranged.withColumn("__own", own).join(before, [*keys, "__p"]).withColumn("idx", F.col("__before") + F.col("__own") - 1).drop("__p", "__own", "__before")


def to_number(x: Column) -> Column:
    """A double; what isn't a finite number is null."""
    return finite_or(x.try_cast("double"), None)


def interpolate(df: DataFrame, value: str = "value", stretch: int = STRETCH) -> DataFrame:
    """Fill nulls of ``value`` on a straight line between the known neighbours by place; before the
    first and after the last known value take that one. A signal without a value keeps nulls.

    Neighbours are sought within stretches of a signal, and then among the first and last known
    values of the other stretches, so that a long signal is dealt over many tasks."""
    keys = keys_in(df)
    known = F.when(F.col(value).isNotNull(), F.struct("idx", F.col(value).alias("v")))
    named = df.withColumns({"__k": stretch_of(stretch), "__v": known})
    ends = named.groupBy(*keys, "__k").agg(F.max("__v").alias("__last"), F.min("__v").alias("__first"))
    # What comes after is sought backwards: a frame that grows is scanned once, one that shrinks once a row.
    ahead = (Window.unboundedPreceding, -1)
    along_k, back_k = (Window.partitionBy(*keys).orderBy(k).rowsBetween(*ahead) for k in (F.col("__k"), F.desc("__k")))
    outer = ends.select(*keys, "__k", F.last("__last", ignorenulls=True).over(along_k).alias("__before"), F.last("__first", ignorenulls=True).over(back_k).alias("__after"))
    w, back = (Window.partitionBy(*keys, "__k").orderBy(i).rowsBetween(Window.unboundedPreceding, 0) for i in (F.col("idx"), F.desc("idx")))
    a, b = F.last("__v", ignorenulls=True).over(w), F.last("__v", ignorenulls=True).over(back)
    marked = named.withColumns({"__a": a, "__b": b}).join(outer, [*keys, "__k"])
    marked = marked.withColumns({"__a": F.coalesce("__a", "__before"), "__b": F.coalesce("__b", "__after")})
    line = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * (F.col("idx") - F.col("__a.idx")) / F.nullif(F.col("__b.idx") - F.col("__a.idx"), F.lit(0))
    return marked.withColumn(value, F.coalesce(F.col(value), line, F.col("__a.v"), F.col("__b.v"))).drop("__a", "__b", "__k", "__v", "__before", "__after")


def clip_label(x: Column) -> Column:
    """0 or 1: a number cut to an integer and into this range; else 0."""
    return F.greatest(F.lit(0), F.least(F.lit(1), F.coalesce(to_number(x).cast("int"), F.lit(0))))


def detrend(df: DataFrame, value: str = "value") -> DataFrame:
    """Take the least-squares line over ``idx`` off each signal."""
    y, x = F.col(value), F.col("idx")
    fit = per_signal(df, F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("__slope"), F.coalesce(F.regr_intercept(y, x), F.avg(y)).alias("__base"))
    return fit.withColumn(value, y - (F.col("__slope") * x + F.col("__base"))).drop("__slope", "__base")


def minmax(df: DataFrame, value: str = "value") -> DataFrame:
    """Scale each signal to 0..1; a constant one to 0."""
    s = per_signal(df, F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    scaled = F.coalesce(F.try_divide(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0))
    return s.withColumn(value, F.when(F.col(value).isNotNull(), scaled)).drop("__lo", "__hi")


def area_resample(df: DataFrame, target: int = 224, value: str = "value", mode: str = "explicit_area") -> DataFrame:
    """(keys, bin, value): each signal, idx from 0, shrunk or stretched to ``target`` means over equal
    shares of its length; samples on an edge count with the part that lies inside. With mode
    ``implicit_legacy``, and for signals of that length, values are kept.

    Values must be finite. Each sample meets only the bins that it overlaps.
    """
    if mode not in ("explicit_area", "implicit_legacy"):
        raise ValueError(f"unknown mode: {mode}")
    if target <= 0:
        raise ValueError("the target length must be positive")
    keys = keys_in(df)
    if mode == "implicit_legacy":
        return df.select(*keys, F.col("idx").alias("bin"), F.col(value).alias("value"))
    sized = per_signal(df, F.count("*").alias("__n"))
    width = F.col("__n") / F.lit(float(target))
    bad = ~F.coalesce(F.abs(F.col(value)) < float("inf"), F.lit(False))
    checked = sized.withColumn(value, F.when(bad, F.raise_error(F.lit("values must be finite"))).otherwise(F.col(value)))
    first, last = F.floor(F.col("idx") / width), F.least(F.ceil((F.col("idx") + 1) / width) - 1, F.lit(target - 1))
    bins = checked.withColumn("bin", F.explode(F.sequence(first, F.greatest(first, last))))
    overlap = F.least(F.col("idx") + 1.0, (F.col("bin") + 1) * width) - F.greatest(F.col("idx").cast("double"), F.col("bin") * width)
    parts = bins.withColumns({"__o": F.greatest(overlap, F.lit(0.0)), "__w": width})
    return parts.groupBy(*keys, "bin").agg((F.sum(F.col(value) * F.col("__o")) / F.first("__w")).alias("value"))
