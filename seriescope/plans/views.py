"""Signals made from the provided tables, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriescope.operators.clean import time_index
from seriescope.operators.decision import threshold_flags
from seriescope.operators.intervals import intervals_of



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sig_ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity shipped each day: one signal."""
    days = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("ts")).agg(F.sum("l_quantity").alias("value"))
    return time_index(days.select(F.lit("tpch").alias("dataset"), F.lit("ship").alias("signal_id"), "ts", "value"))


def sig_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value of each day: one signal."""
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("ts")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return time_index(days.select(F.lit("tpch").alias("dataset"), F.lit("order").alias("signal_id"), "ts", "value"))


def _events(spark: SparkSession, sf_dir: str, signal: Column) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(F.lit("events").alias("dataset"), signal.alias("signal_id"), "ts", "event_id", "value", (F.col("event_type") == "error").cast("int").alias("label"))
    # One signal may hold all events: days are numbered each, then moved by the days before.
    return time_index(rows, "ts", "event_id", part=F.date_trunc("day", "ts"))


def sig_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one signal, errors labelled."""
    return _events(spark, sf_dir, F.lit("all"))


def sig_etype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal for each type of event."""
    return _events(spark, sf_dir, F.col("event_type"))


def sig_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal for each user."""
    return _events(spark, sf_dir, F.col("user_id").cast("string"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as windows of 224 points at steps of 56."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("window_id"), (F.col("vec_id") * 56).alias("start_idx"), F.col("embedding").cast("array<double>").alias("vec"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as 8 patches of 8 dimensions."""
    v = vectors(spark, sf_dir)
    return v.select("window_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("vec"), i * 8 + 1, F.lit(8)))).alias("patch_id", "vec"))


def long_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings, a row a dimension."""
    return vectors(spark, sf_dir).select("window_id", F.posexplode("vec").alias("dim", "value"))


def candidates(points: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Intervals of raw values above their threshold, numbered by place."""
    found = intervals_of(threshold_flags(points, alpha, score="value"), F.col("flag"))
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("dataset", "signal_id").orderBy("start_idx"))
    return found.withColumns({"seq": n.cast("long"), "candidate_id": F.format_string("C%04d", n)})


def lengths(points: DataFrame) -> DataFrame:
    return points.groupBy("dataset", "signal_id").agg(F.count("*").alias("n"))


def records(cands: DataFrame) -> DataFrame:
    """Decision records that follow from the numbers of candidates; some break a rule."""
    i, s, e = F.col("seq"), F.col("start_idx"), F.col("end_idx")
    action = F.when(i % 5 == 1, "remove").when(i % 5 == 2, "refine").when(i % 11 == 0, "drop").otherwise("keep")
    level = (i % 3 + 1).cast("int")
    q = F.when(level == 1, 0.6).when(level == 2, 0.9).otherwise(0.97) + F.when(i % 13 == 0, F.lit(0.2)).otherwise(F.lit(0.0))
    gone = F.col("action") == "remove"
    out = cands.withColumn("action", action)
    return out.select(
        "dataset", "signal_id", "seq", "candidate_id", s.alias("reviewed_start"), e.alias("reviewed_end"), "action",
        F.when(gone & (i % 4 != 0), F.lit(None)).when(F.col("action") == "refine", F.greatest(s - 2, F.lit(0))).otherwise(s).cast("long").alias("final_start"),
        F.when(gone & (i % 4 != 0), F.lit(None)).when(F.col("action") == "refine", e + 2).otherwise(e).cast("long").alias("final_end"),
        level.alias("confidence_level"), q.alias("confidence"), F.when(i % 17 != 0, F.lit("because")).alias("rationale"), (i % 4 != 1).alias("evidence_sufficient"),
    )


