"""Trials from a stream of samples: event time zero joined to samples within its window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_epochs(samples: DataFrame, codes: list[int], before: str = "500 milliseconds", after: str = "1 second", delay: str = "5 seconds", key: str = "participant", ts: str = "ts", column: str = "triggers") -> DataFrame:
    """Stream-stream interval join: every sample around every listed code, with its offset in seconds.

    Both sides have watermarks, so state is dropped once no window can still match.
    """
    left = samples.withWatermark(ts, delay)
    zeros = samples.filter(F.col(column).isin(codes)).select(F.col(key).alias("_key"), F.col(ts).alias("zero"), F.col(column).alias("code")).withWatermark("zero", delay)
    on = (F.col(key) == F.col("_key")) & (F.col(ts) >= F.col("zero") - F.expr(f"interval {before}")) & (F.col(ts) <= F.col("zero") + F.expr(f"interval {after}"))
    return left.join(zeros, on).withColumn("time", (F.unix_micros(ts) - F.unix_micros("zero")) / 1e6).drop("_key")


def stream_trigger_counts(samples: DataFrame, window: str = "1 minute", delay: str = "5 seconds", ts: str = "ts", column: str = "triggers") -> DataFrame:
    """Codes per tumbling window; late samples beyond the delay are dropped."""
    rows = samples.filter(F.col(column) != 0).withWatermark(ts, delay)
    return rows.groupBy(F.window(ts, window).alias("window"), F.col(column).alias("trigger")).agg(F.count(F.lit(1)).alias("count"))
