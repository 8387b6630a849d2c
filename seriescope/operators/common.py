"""Keys of a signal and joins of small per-signal statistics."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: What identifies a signal.
KEYS = ("dataset", "signal_id")


def keys_in(df: DataFrame, *more: str) -> list[str]:
    """The signal keys that ``df`` has, and ``more`` of its columns."""
    return [c for c in (*KEYS, *more) if c in df.columns]


def per_signal(df: DataFrame, *aggregates: Column, by: list[str] | None = None) -> DataFrame:
    """``df`` with aggregates of each signal joined to its rows. Partial sums come first, so a long
    signal costs no more shuffle than its rows; a skewed join is split by adaptive execution."""
    keys = by if by is not None else keys_in(df)
    return df.join(df.groupBy(*keys).agg(*aggregates), keys)


def along(df: DataFrame, *order: str, by: list[str] | None = None) -> WindowSpec:
    """Rows of a signal in order."""
    return Window.partitionBy(*(by if by is not None else keys_in(df))).orderBy(*order)


#: Successive rows of a signal that one task sums up.
STRETCH = 65_536


def stretch_of(stretch: int = STRETCH, idx: str = "idx") -> Column:
    """The number of the stretch that an index is in."""
    return F.floor(F.col(idx) / stretch)


def running_sums(df: DataFrame, sums: dict[str, Column], by: list[str] | None = None, stretch: int = STRETCH, order: str = "idx", part: Column | None = None) -> DataFrame:
    """Add sums of columns over a signal's rows up to each by ``order``."""
    return running(df, {n: ("sum", c) for n, c in sums.items()}, by, stretch, order, part)


#: Functions that may be taken of stretches and then of what these give, and how two results combine.
SCANS = {"sum": (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def running(df: DataFrame, values: dict[str, tuple[str, Column]], by: list[str] | None = None, stretch: int = STRETCH, order: str = "idx", part: Column | None = None, earlier: bool = False) -> DataFrame:
    """Add scans of columns (a name of SCANS and a column) over a signal's rows up to each by
    ``order``; with ``earlier`` the row itself isn't among them (of max and min only).

    Results of stretches of a signal come first, then those of all stretches before, then each
    stretch's own scan: a signal with a third of all rows is still dealt over many tasks. ``part``: a
    column that never falls along ``order`` and numbers the stretches.
    """
    keys = by if by is not None else keys_in(df)
    named = df.withColumns({"__k": stretch_of(stretch, order) if part is None else part, **{f"__{n}": c for n, (_, c) in values.items()}})
    total = {n: SCANS[kind][0] for n, (kind, _) in values.items()}
    totals = named.groupBy(*keys, "__k").agg(*[total[n](f"__{n}").alias(f"__{n}_t") for n in values])
    ahead = Window.partitionBy(*keys).orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "__k", *[total[n](f"__{n}_t").over(ahead).alias(f"__{n}_b") for n in values])
    own = Window.partitionBy(*keys, "__k").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if earlier else 0)
    joined = named.withColumns({f"__{n}": total[n](f"__{n}").over(own) for n in values}).join(before, [*keys, "__k"])
    done = joined.withColumns({n: SCANS[kind][1](F.col(f"__{n}"), F.col(f"__{n}_b")) for n, (kind, _) in values.items()})
    return done.drop("__k", *[f"__{n}" for n in values], *[f"__{n}_b" for n in values])


def with_next(df: DataFrame, column: str, name: str, by: list[str] | None = None, stretch: int = STRETCH) -> DataFrame:
    """Add the value of ``column`` in the signal's next row by ``idx``, null in its last one.

    Rows look ahead within their stretch; the last one takes the first value of the next stretch."""
    keys = by if by is not None else keys_in(df)
    named = df.withColumn("__k", stretch_of(stretch))
    firsts = named.groupBy(*keys, "__k").agg(F.min_by(F.struct(column), "idx").alias("__f"))
    after = firsts.select(*keys, "__k", F.lead("__f").over(Window.partitionBy(*keys).orderBy("__k")).alias("__f"))
    own = F.lead(F.struct(column)).over(Window.partitionBy(*keys, "__k").orderBy("idx"))
    joined = named.withColumn("__own", own).join(after, [*keys, "__k"])
    return joined.withColumn(name, F.coalesce("__own", "__f")[column]).drop("__k", "__own", "__f")


def materialise(df: DataFrame) -> DataFrame:
    """End a stage: its rows go to the folder that ``spark.checkpoint.dir`` names, so later stages
    neither plan nor run it again. Where it names none, a local session, as in tests, gets a folder of
    its own; on a cluster that is an error, as no folder of one machine would do."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()
