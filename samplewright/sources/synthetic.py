"""Deterministic test signals as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def continuous(spark: SparkSession, n: int = 2000, rate: float = 1000.0, n_channels: int = 3, noise: float = 0.0, seed: int = 1) -> DataFrame:
    """participant, sample, time, triggers (0) and channels of 5, 6, ... Hz sines around 0.5."""
    t = F.col("id") / F.lit(rate)
    chans = [(0.5 + F.sin(2 * F.pi() * (5 + k) * t) + (F.randn(seed + k) * noise if noise else F.lit(0.0))).alias(f"Ch{k + 1}") for k in range(n_channels)]
    return spark.range(n).select(F.lit(1).alias("participant"), (F.col("id") + 1).alias("sample"), t.alias("time"), F.lit(0).cast("long").alias("triggers"), *chans)


def with_triggers(spark: SparkSession, triggers: dict[int, int], n: int = 1000, rate: float = 1000.0) -> DataFrame:
    """A recording with the given codes at 1-based samples."""
    code = F.lit(0)
    for s, v in triggers.items():
        code = F.when(F.col("sample") == s, v).otherwise(code)
    rows = spark.range(n).select(F.lit(1).alias("participant"), (F.col("id") + 1).alias("sample"), (F.col("id") / F.lit(rate)).alias("time"))
    return rows.withColumn("triggers", code.cast("long")).withColumn("A", F.sin(2 * F.pi() * F.col("time")))


def trials(spark: SparkSession, n_epochs: int = 10, n: int = 2000, rate: float = 1000.0, start: float = -0.5, n_channels: int = 3, conditions: Sequence[int] = (1,), hertz: float = 10.0, participants: int = 1) -> DataFrame:
    """Trials whose amplitude is half the condition's number."""
    grid = spark.range(participants * len(conditions) * n_epochs * n)
    pos = F.col("id") % n
    k = F.floor(F.col("id") / n)
    cond = F.element_at(F.array(*[F.lit(c) for c in conditions]), (k % len(conditions) + 1).cast("int"))
    rows = grid.select(
        (F.floor(k / (len(conditions) * n_epochs)) + 1).alias("participant"), cond.alias("condition"), (F.floor(k / len(conditions)) % n_epochs + 1).alias("epoch"), (pos + 1).alias("pos"), (F.lit(start) + pos / F.lit(rate)).alias("time")
    )
    return rows.select("*", *[(0.5 * F.col("condition") * F.sin(2 * F.pi() * hertz * F.col("time"))).alias(f"Ch{c + 1}") for c in range(n_channels)])


def windowed_sines(spark: SparkSession, n_trials: int, window: tuple[float, float], rate: float, freqs: Sequence[float], amps: Sequence[float], times: Sequence[tuple[float, float]], noise: float = 0.0, seed: int = 1) -> DataFrame:
    """Sum of sines, each on its own interval, per trial."""
    n = round((window[1] - window[0]) * rate) + 1
    t = F.lit(window[0]) + (F.col("id") % n) / F.lit(rate)
    value = F.randn(seed) * noise if noise else F.lit(0.0)
    for f, a, (lo, hi) in zip(freqs, amps, times, strict=True):
        value = value + F.when((t >= lo) & (t < hi), a * F.sin(2 * F.pi() * f * t)).otherwise(0.0)
    return spark.range(n_trials * n).select(F.lit(1).alias("condition"), (F.floor(F.col("id") / n) + 1).alias("epoch"), (F.col("id") % n + 1).alias("pos"), t.alias("time"), value.alias("value"))
