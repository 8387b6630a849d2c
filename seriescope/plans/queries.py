"""All queries of the signal operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriescope.plans import pipeline, report_queries, session, signal_queries, views, window_queries  # noqa: F401  registers their queries
from seriescope.plans.signal_queries import QUERIES, SQL, add, flagship, out

__all__ = ["QUERIES", "SQL", "flagship"]


@add("n17_three_scale_pipeline")
def n17(spark: SparkSession, d: str) -> DataFrame:
    """Three scales with the stand-in encoder, fused and decided at three alphas."""
    found = pipeline.screen(views.sig_ship(spark, d))
    return out(found, "signal_id", F.round("alpha", 6).alias("alpha"), "start_idx", "end_idx")


@add("n16_visual_detector")
def n16(spark: SparkSession, d: str) -> DataFrame:
    """One scale against the median memory, with the stand-in encoder."""
    found = pipeline.detect(views.sig_ship(spark, d))[1]
    return out(found, "signal_id", "start_idx", "end_idx", "severity")


@add("s3_session")
def s3(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of every type of event, reviewed by the rule reviewer."""
    from seriescope.operators.common import materialise
    from seriescope.operators.decision import robust_positive_z
    from seriescope.operators.intervals import interval_bounds

    s = materialise(views.sig_etype(spark, d).select("dataset", "signal_id", "idx", "ts", "value"))
    z = robust_positive_z(s, "value")
    c = interval_bounds(z, views.candidates(s), score="value").select("dataset", "signal_id", "candidate_id", "start_idx", "end_idx", "severity")
    return out(session.run_session(s, c, session.RuleReviewer())[1], "signal_id", "start_idx", "end_idx")
