"""Stage tables: Parquet, partitioned by dataset, with a manifest of complete signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriescope.operators.common import stretch_of
from seriescope.operators.retrieval import validity_audit

#: Versions of the stage tables that can be read.
SCHEMAS = (1,)
#: Successive indices of a signal in a file.
ROWS = 1 << 20
MANIFEST = "dataset string, signal_id string, complete boolean, schema int, n long, error string"


def list_complete(manifest: DataFrame) -> DataFrame:
    """(dataset, signal_id) of complete signals of a known version, in order of names."""
    return manifest.where(F.col("complete") & F.col("schema").isin(*SCHEMAS)).select("dataset", "signal_id").distinct().orderBy("dataset", "signal_id")


def load_stage(spark: SparkSession, root: str, stage: str, dataset: str | None = None, signal_id: str | None = None, scales: Sequence[int] | None = None) -> DataFrame:
    """A stage table, of one dataset, signal or some scales: partition filters and pushed ones."""
    df = spark.read.parquet(f"{root}/{stage}")
    if dataset is not None:
        df = df.where(F.col("dataset") == dataset)
    if signal_id is not None:
        df = df.where(F.col("signal_id") == signal_id)
    if scales is not None:
        df = df.where(F.col("scale").isin(*scales))
    return df


def write_stage(df: DataFrame, root: str, stage: str, mode: str = "overwrite") -> None:
    """Write a stage table a folder a dataset; the files of a dataset are sorted by signal, so that a
    signal's rows are found by their statistics. Rows with an index are dealt out by stretches of
    it, so a long signal has several files, each of a range of indices."""
    order = [c for c in ("dataset", "signal_id", "idx") if c in df.columns]
    parts = [stretch_of(ROWS)] if "idx" in df.columns else []
    df.repartition("dataset", "signal_id", *parts).sortWithinPartitions(*order).write.mode(mode).partitionBy("dataset").parquet(f"{root}/{stage}")


def pending(roster: DataFrame, done: DataFrame) -> DataFrame:
    """Signals of the roster that aren't done."""
    return roster.join(done.select("dataset", "signal_id"), ["dataset", "signal_id"], "left_anti")


def upsert_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` rows, and ``old`` rows of other signals."""
    return new.unionByName(old.join(new, ["dataset", "signal_id"], "left_anti"))


def manifest_counts(manifest: DataFrame) -> DataFrame:
    """(dataset, n_complete, n_failed)."""
    return manifest.groupBy("dataset").agg(F.count_if("complete").alias("n_complete"), F.count_if(~F.col("complete")).alias("n_failed"))


def dry_run_plan(roster: DataFrame, manifest: DataFrame, alphas: int = 3) -> DataFrame:
    """(dataset, n_signals, n_cached, n_to_build, n_sessions): what a run would do, without doing it."""
    done = list_complete(manifest).withColumn("__done", F.lit(1))
    joined = roster.distinct().join(done, ["dataset", "signal_id"], "left")
    n = F.count("*")
    return joined.groupBy("dataset").agg(n.alias("n_signals"), F.count("__done").alias("n_cached"), (n - F.count("__done")).alias("n_to_build"), (n * alphas).alias("n_sessions"))


def stage_summary(stage: DataFrame) -> DataFrame:
    """(dataset, n_signals, n_rows, shortest, longest) of a stage table."""
    each = stage.groupBy("dataset", "signal_id").agg(F.count("*").alias("n"))
    return each.groupBy("dataset").agg(F.count("*").alias("n_signals"), F.sum("n").alias("n_rows"), F.min("n").alias("shortest"), F.max("n").alias("longest"))


def query_trace(refs: DataFrame, windows: DataFrame, length: int, policy: str = "non_overlap", patch_scores: DataFrame | None = None, window_scores: DataFrame | None = None) -> DataFrame:
    """A row a window for a trace file: its span, its references and scores as JSON, mean and largest
    of its patch scores (query_id, patch_id, score) and of its map's columns (query_id, col, score).

    ``refs``: rank, ref_id, sim, and for those retained retained_rank and, if there, distance. Windows
    are numbered from 0 in order of starts, so the valid references of one are two ranges of numbers
    at most: their list would have a number for each pair of windows.
    """
    keys = ["dataset", "signal_id", "scale"]
    far = F.col("distance") if "distance" in refs.columns else F.lit(None).cast("double").alias("distance")
    r = refs.groupBy(*keys, "query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "ref_id", "sim", "retained_rank", far))).alias("r"))
    w = windows.withColumnRenamed("window_id", "query_id")
    audit = validity_audit(windows, length, "past_only_non_overlap", keys).select(*keys, "query_id", "raw", F.col("valid").alias("past"), F.col("past_excluded").alias("later"))
    both = w.join(r, [*keys, "query_id"], "left").join(audit, [*keys, "query_id"]).withColumn("r", F.coalesce("r", F.array()))
    for name, scores in (("patch", patch_scores), ("window", window_scores)):
        if scores is None:
            both = both.withColumns({f"{name}_score_{f}": F.lit(None).cast("double") for f in ("mean", "max")})
        else:
            means = scores.groupBy(*keys, "query_id").agg(F.avg("score").alias(f"{name}_score_mean"), F.max("score").alias(f"{name}_score_max"))
            both = both.join(means, [*keys, "query_id"], "left")
    last, q = F.col("raw") - 1, F.col("query_id").cast("long")
    low, high = (q - 1, q + 1) if policy == "self_only" else (F.col("past") - 1, F.col("raw") - F.col("later"))
    ranges = [F.array(F.lit(0).cast("long"), low), *([] if policy == "past_only_non_overlap" else [F.array(high, last)])]
    kept = F.array_sort(F.transform(F.filter("r", lambda x: x["retained_rank"].isNotNull()), lambda x: F.struct(x["retained_rank"].alias("k"), x["ref_id"].alias("ref_id"), x["rank"].alias("rank"), x["distance"].alias("distance"))))
    both = both.withColumn("k", kept)
    return both.select(
        *keys, F.col("query_id").alias("query_window_id"), F.col("start_idx").alias("query_start"), (F.col("start_idx") + length).alias("query_end"),
        F.when(F.size("r") > 0, "ok").otherwise("no_non_overlap_reference").alias("reference_status"), F.to_json(F.filter(F.array(*ranges), lambda x: x[0] <= x[1])).alias("valid_reference_ranges"),
        F.to_json(F.col("r.ref_id")).alias("topk_indices"), F.to_json(F.col("r.sim")).alias("topk_similarities"), F.to_json(F.col("k.rank")).alias("retained_ranks"),
        F.to_json(F.col("k.ref_id")).alias("retained_window_ids"), F.to_json(F.col("k.distance")).alias("retained_distances"),
        "patch_score_mean", "patch_score_max", "window_score_mean", "window_score_max",
    )


def without_nan(rows: DataFrame) -> DataFrame:
    """``rows``; a job that meets a double which JSON can't say fails and names the column."""

    def checked(c: str) -> Column:
        bad = F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
        return F.when(bad, F.raise_error(F.lit(f"{c} is not a finite number")).cast("double")).otherwise(F.col(c)).alias(c)

    return rows.select(*[checked(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes])


def write_per_alpha(rows: DataFrame, root: str, name: str, mode: str = "overwrite", form: str = "json", allow_nan: bool = True) -> None:
    """Rows with dataset, signal_id and alpha (metrics, decisions) as JSON or CSV, in a folder a signal
    and alpha. Writing ends in one commit; NaN is written as text or, if not allowed, an error."""
    if form not in ("json", "csv"):
        raise ValueError(f"unknown form: {form}")
    parts = (rows if allow_nan else without_nan(rows)).withColumn("alpha_dir", F.col("alpha").cast("string"))
    writer = parts.repartition("dataset", "signal_id", "alpha_dir").write.mode(mode).partitionBy("dataset", "signal_id", "alpha_dir")
    (writer if form == "json" else writer.option("header", True)).format(form).save(f"{root}/{name}")


def write_report(summary: DataFrame, root: str, digits: int = 4) -> None:
    """A summary as CSV and JSON, doubles rounded."""
    rounded = summary.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in summary.dtypes])
    rounded.write.mode("overwrite").option("header", True).csv(f"{root}/summary_csv")
    rounded.write.mode("overwrite").json(f"{root}/summary_json")
