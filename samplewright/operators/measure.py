"""Window measures of long series: amplitudes, areas, peaks and fractional latencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEASURES = (
    "mean_amplitude", "integral", "rectified_area", "positive_area", "negative_area",
    "max_peak_amplitude", "max_peak_latency", "min_peak_amplitude", "min_peak_latency",
    "peak_to_peak_amplitude", "peak_to_peak_latency", "fractional_area_latency", "fractional_peak_latency",
)


def areas(df: DataFrame, keys: Sequence[str], time: str = "time", value: str = "value") -> DataFrame:
    """Mean amplitude and the four areas per key; areas are 0 for one sample or no time step."""
    v, n = F.col(value), F.count(F.lit(1))
    dt = F.when(n > 1, (F.max(time) - F.min(time)) / F.nullif(n - 1, F.lit(0))).otherwise(0.0)
    return df.groupBy(*keys).agg(
        F.avg(v).alias("mean_amplitude"),
        (F.sum(v) * dt).alias("integral"),
        (F.sum(F.abs(v)) * dt).alias("rectified_area"),
        (F.sum(F.greatest(v, F.lit(0.0))) * dt).alias("positive_area"),
        (F.sum(F.abs(F.least(v, F.lit(0.0)))) * dt).alias("negative_area"),
    )


def _robust(df: DataFrame, keys: Sequence[str], k: int, time: str, value: str) -> DataFrame:
    """Adds _up and _down: whether a sample is a robust maximum or minimum."""
    w = Window.partitionBy(*keys).orderBy(time)
    v, whole = F.col(value), Window.partitionBy(*keys)
    rows = df.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(whole))
    inside = (F.col("_i") > k) & (F.col("_i") <= F.col("_n") - k)
    left, right = F.avg(value).over(w.rowsBetween(-k, -1)), F.avg(value).over(w.rowsBetween(1, k))
    a, b = F.lag(value).over(w), F.lead(value).over(w)
    rows = rows.withColumns({"_left": left, "_right": right, "_a": a, "_b": b})
    up = inside & (v > F.col("_a")) & (v > F.col("_b")) & (v > F.col("_left")) & (v > F.col("_right"))
    down = inside & (v < F.col("_a")) & (v < F.col("_b")) & (v < F.col("_left")) & (v < F.col("_right"))
    return rows.withColumns({"_up": F.coalesce(up, F.lit(False)), "_down": F.coalesce(down, F.lit(False))}).drop("_left", "_right", "_a", "_b")


def peaks(df: DataFrame, keys: Sequence[str], local_window: int = 3, time: str = "time", value: str = "value") -> DataFrame:
    """Robust maximum and minimum with their times, else the plain ones; the earliest on ties."""
    rows = _robust(df, keys, local_window, time, value)
    v, t = F.col(value), F.col(time)
    pick = lambda test, sign: F.max(F.when(test, F.struct((v * sign).alias("v"), (-t).alias("t"))))
    agg = rows.groupBy(*keys).agg(
        F.coalesce(pick(F.col("_up"), 1.0), pick(F.lit(True), 1.0)).alias("_hi"), F.coalesce(pick(F.col("_down"), -1.0), pick(F.lit(True), -1.0)).alias("_lo")
    )
    hi, hi_t, lo, lo_t = F.col("_hi.v"), -F.col("_hi.t"), -F.col("_lo.v"), -F.col("_lo.t")
    return agg.select(
        *keys,
        hi.alias("max_peak_amplitude"),
        hi_t.alias("max_peak_latency"),
        lo.alias("min_peak_amplitude"),
        lo_t.alias("min_peak_latency"),
        (hi - lo).alias("peak_to_peak_amplitude"),
        F.abs(hi_t - lo_t).alias("peak_to_peak_latency"),
    )


def fractional_area(df: DataFrame, keys: Sequence[str], fraction: float = 0.5, time: str = "time", value: str = "value") -> DataFrame:
    """Time at which the running signed area first reaches a fraction of the total, linearly interpolated."""
    w, whole = Window.partitionBy(*keys).orderBy(time), Window.partitionBy(*keys)
    rows = df.withColumn("_run", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum(value).over(whole))
    rows = rows.withColumn("_goal", F.col("_all") * fraction)
    rows = rows.withColumns({"_before": F.lag("_run").over(w), "_t": F.lag(time).over(w)})
    hit = F.when(F.col("_all") >= 0, F.col("_run") >= F.col("_goal")).otherwise(F.col("_run") <= F.col("_goal"))
    part = (F.col("_goal") - F.col("_before")) / F.nullif(F.col("_run") - F.col("_before"), F.lit(0.0))
    at = F.when(F.col("_before").isNull() | part.isNull(), F.col(time)).otherwise(F.col("_t") + part * (F.col(time) - F.col("_t")))
    return rows.filter(hit).groupBy(*keys).agg(F.min_by(at, F.col(time)).alias("fractional_area_latency"))


def fractional_peak(df: DataFrame, keys: Sequence[str], fraction: float = 0.5, direction: str = "onset", local_window: int = 3, time: str = "time", value: str = "value") -> DataFrame:
    """From the larger of the two robust peaks, the time at which the series last was (onset) or
    first is (offset) at the fraction of the peak, interpolated; the edge's time if it never is."""
    top = peaks(df, keys, local_window, time, value)
    larger = F.abs("max_peak_amplitude") >= F.abs("min_peak_amplitude")
    top = top.select(
        *keys, F.when(larger, F.col("max_peak_amplitude")).otherwise(F.col("min_peak_amplitude")).alias("_p"), F.when(larger, F.col("max_peak_latency")).otherwise(F.col("min_peak_latency")).alias("_at")
    )
    w = Window.partitionBy(*keys).orderBy(time)
    step = F.lead if direction == "onset" else F.lag
    rows = df.withColumns({"_v2": step(value).over(w), "_t2": step(time).over(w)}).join(top, list(keys))
    sign = F.when(F.col("_p") >= 0, 1.0).otherwise(-1.0)
    goal = F.col("_p") * fraction
    side = F.col(time) < F.col("_at") if direction == "onset" else F.col(time) > F.col("_at")
    low = side & (F.col(value) * sign <= goal * sign)
    at = F.col(time) + (goal - F.col(value)) / F.nullif(F.col("_v2") - F.col(value), F.lit(0.0)) * (F.col("_t2") - F.col(time))
    at = F.coalesce(at, F.col(time))
    best = F.max_by(F.when(low, at), F.when(low, F.col(time))) if direction == "onset" else F.min_by(F.when(low, at), F.when(low, F.col(time)))
    edge = F.min(time) if direction == "onset" else F.max(time)
    return rows.groupBy(*keys).agg(F.coalesce(best, edge).alias("fractional_peak_latency"))


def measure(
    df: DataFrame,
    kind: str,
    keys: Sequence[str] = ("participant", "condition", "channel"),
    between: tuple[float, float] | None = None,
    baseline: tuple[float, float] | None = None,
    time: str = "time",
    value: str = "value",
    **options,
) -> DataFrame:
    """One measure per key over a closed interval, after an optional baseline: keys, analysis_type, interval ends, value."""
    if kind not in MEASURES:
        raise ValueError(f"unknown measure {kind}; one of {', '.join(MEASURES)}")
    if baseline is not None:
        mean = F.avg(F.when(F.col(time).between(*baseline), F.col(value))).over(Window.partitionBy(*keys))
        df = df.withColumn(value, F.col(value) - mean)
    if between is not None:
        df = df.filter(F.col(time).between(*between))
    if kind == "fractional_area_latency":
        out = fractional_area(df, keys, time=time, value=value, **options)
    elif kind == "fractional_peak_latency":
        out = fractional_peak(df, keys, time=time, value=value, **options)
    elif "peak" in kind:
        out = peaks(df, keys, time=time, value=value, **options)
    else:
        out = areas(df, keys, time, value)
    ends: list[Column] = []
    for name, pair in (("baseline", baseline), ("analysis", between)):
        for i, side in enumerate(("start", "end")):
            ends.append(F.lit(pair[i] if pair else None).cast("double").alias(f"{name}_interval_{side}"))
    return out.select(*keys, F.lit(kind).alias("analysis_type"), *ends, F.col(kind).alias("value"))


def measure_table(measured: DataFrame, channels: Sequence[str], keys: Sequence[str] = ("participant", "condition")) -> DataFrame:
    """The wide report: one row per key, one column per channel, sorted."""
    meta = [c for c in measured.columns if c not in (*keys, "channel", "value")]
    return measured.groupBy(*keys, *meta).pivot("channel", list(channels)).agg(F.first("value")).orderBy(*keys)
