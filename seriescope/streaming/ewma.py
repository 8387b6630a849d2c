"""An extension: running smoothed scores and counts over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "signal_id string, ts timestamp_ntz, value double, smooth double"


def running_ewma(stream: DataFrame, span: float = 10.0) -> DataFrame:
    """(signal_id, ts, value, smooth) of a stream of (signal_id, ts, value): the exponentially weighted
    mean with adjusted weights and a fixed span. Rows of a micro-batch are taken by time; the state
    of a signal is two numbers. Thresholds over whole signals need the batch operators."""
    keep = 1 - 2.0 / (span + 1)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top, weight = state.get if state.exists else (0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values("ts")
        smooth = []
        for v in rows["value"]:
            top, weight = top * keep + v, weight * keep + 1
            smooth.append(top / weight)
        state.update((float(top), float(weight)))
        yield pd.DataFrame({"signal_id": key[0], "ts": rows["ts"].to_numpy(), "value": rows["value"].to_numpy(), "smooth": smooth})

    return stream.groupBy("signal_id").applyInPandasWithState(run, OUT, "top double, weight double", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(window_start, signal_id, n, mean) of tumbling windows; rows later than ``late`` are dropped."""
    marked = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = marked.groupBy(F.window("ts", window).alias("w"), "signal_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return counted.select(F.col("w.start").alias("window_start"), "signal_id", "n", "mean")
