"""Artifact detection, rejection and repair."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .channels import zscore
from .layout import spherical_weights
from .process import linear_map
from .select import melt


def eog_onsets(df: DataFrame, column: str, criterion: float, rate: float, keys: Sequence[str] = ("participant",), out: str = "is_onset", step_size: int = 20, by: str = "sample") -> DataFrame:
    """Flags jumps of at least `criterion` between samples rate // step_size apart.

    A hit two steps or less after the hit before it (dropped or not) is dropped.
    """
    step = max(1, int(rate) // step_size)
    w = Window.partitionBy(*keys).orderBy(by)
    coarse = df.select(*keys, by, column).withColumn("_i", F.row_number().over(w)).filter((F.col("_i") - 1) % step == 0).withColumn("_k", ((F.col("_i") - 1) / step + 1).cast("long"))
    coarse = coarse.withColumn("_d", F.abs(F.col(column) - F.lag(column).over(w))).filter(F.col("_d") >= criterion)
    hits = coarse.withColumn("_before", F.lag("_k").over(w)).filter(F.col("_before").isNull() | (F.col("_k") - F.col("_before") > 2))
    hits = hits.select(*keys, (F.col("_k") * step).alias("_i")).withColumn("_hit", F.lit(True))
    rows = df.withColumn("_i", F.row_number().over(w).cast("long"))
    return rows.join(hits, [*keys, "_i"], "left").withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_hit", "_i")


def _beyond(name: str, threshold: float) -> Column:
    return (F.abs(F.col(name)) > threshold) & ~F.isnan(F.col(name))


def extreme_values(df: DataFrame, names: Sequence[str], threshold: float, mode: str = "combined", out: str | None = None, where: Column | None = None) -> DataFrame:
    """Flags |x| > threshold, over all channels or per channel."""
    where = F.lit(True) if where is None else where
    if mode == "combined":
        return df.withColumn(out or f"is_extreme_value_{threshold:g}", where & reduce(lambda a, b: a | b, [_beyond(n, threshold) for n in names]))
    return df.withColumns({f"is_extreme_value_{n}_{threshold:g}": where & _beyond(n, threshold) for n in names})


def n_extreme(df: DataFrame, names: Sequence[str], threshold: float, keys: Sequence[str] = ()) -> DataFrame:
    return melt(df, keys, names).groupBy(*keys, "channel").agg(F.count_if(_beyond("value", threshold)).alias("n_extreme"))


def epoch_metrics(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ("condition",), epoch: str = "epoch") -> DataFrame:
    """Per channel and trial: variance, max, min, abs, range, kurtosis, and their z-scores over trials."""
    long = melt(df, [*keys, epoch], names)
    out = long.groupBy(*keys, "channel", epoch).agg(
        F.var_samp("value").alias("variance"),
        F.max("value").alias("max"),
        F.min("value").alias("min"),
        F.max(F.abs("value")).alias("abs"),
        (F.max("value") - F.min("value")).alias("range"),
        F.kurtosis("value").alias("kurtosis"),
    )
    return out.withColumns({f"z_{m}": zscore(m, [*keys, "channel"]) for m in ("variance", "max", "min", "abs", "range", "kurtosis")})


def bad_epochs(df: DataFrame, names: Sequence[str], z_criterion: float = 3, abs_criterion: float = 100, measures: Sequence[str] = ("variance", "max", "min", "abs", "range", "kurtosis"), keys: Sequence[str] = ("condition",)) -> DataFrame:
    """(keys, channel, epoch, reasons) of trials beyond either criterion; 0 turns one off."""
    m = epoch_metrics(df, names, keys)
    tests = [F.when((F.abs(f"z_{x}") > z_criterion) & ~F.isnan(f"z_{x}"), F.lit(f"z_{x}")) for x in measures] if z_criterion else []
    if abs_criterion:
        tests.append(F.when((F.col("abs") > abs_criterion) & ~F.isnan("abs"), F.lit("abs_threshold")))
    reasons = F.array_compact(F.array(*tests))
    return m.select(*keys, "channel", "epoch", reasons.alias("reasons")).filter(F.size("reasons") > 0)


def reject(df: DataFrame, bad: DataFrame, keys: Sequence[str] = ("condition", "epoch")) -> DataFrame:
    return df.join(bad.select(*keys).distinct(), list(keys), "left_anti")


def reject_flagged(df: DataFrame, flags: Sequence[str], keys: Sequence[str] = ("condition", "epoch")) -> DataFrame:
    """Drops trials with any true value in any flag column."""
    bad = df.filter(reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(False)) for c in flags]))
    return reject(df, bad, keys)


def unique_rejections(bad: DataFrame, by: Sequence[str] = ("channel", "epoch")) -> DataFrame:
    """The distinct channels, trials or pairs of a table of rejections."""
    return bad.select(*by).distinct()


def subset_bad_data(df: DataFrame, table: DataFrame, threshold: float, participant: str = "participant") -> DataFrame:
    """Drops participants with a condition whose kept percentage is below the threshold."""
    return df.join(table.filter(F.col("percentage") < threshold).select(participant).distinct(), participant, "left_anti")


def compare_rejections(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("condition",), epoch: str = "epoch") -> DataFrame:
    """Per key: trials rejected before and after, repaired, still bad, new, and the repaired percentage."""
    a = before.select(*keys, epoch).distinct().withColumn("_a", F.lit(1))
    b = after.select(*keys, epoch).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, [*keys, epoch], "full")
    n = lambda test: F.count_if(test)
    out = both.groupBy(*keys).agg(
        n(F.col("_a").isNotNull()).alias("before"),
        n(F.col("_b").isNotNull()).alias("after"),
        n(F.col("_a").isNotNull() & F.col("_b").isNull()).alias("repaired"),
        n(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("still_bad"),
        n(F.col("_a").isNull() & F.col("_b").isNotNull()).alias("new"),
    )
    return out.withColumn("repaired_percentage", F.when(F.col("before") > 0, F.bround(F.col("repaired") * 100.0 / F.nullif(F.col("before"), F.lit(0)), 1)).otherwise(0.0))


def bad_channels(summary: DataFrame, joint: DataFrame, criterion: float = 3.0) -> DataFrame:
    """Channels with |zvar| beyond the criterion, or rejected by joint probability."""
    return summary.filter(F.abs("zvar") > criterion).select("channel").union(joint.filter("rejected").select("channel")).distinct()


def by_eog_correlation(bad: DataFrame, correlations: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Adds eog_related: the largest |r| with an EOG channel (rows: channel, columns: EOG) beyond the threshold."""
    most = correlations.groupBy(F.col("row").alias("channel")).agg(F.max(F.abs("r")).alias("_r"))
    return bad.join(most, "channel", "left").withColumn("eog_related", F.coalesce(F.col("_r") > threshold, F.lit(False))).drop("_r")


def repairable(bad: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds repairable: the channel has two or more neighbours and all are good under the same keys."""
    worse = bad.select(*keys, F.col("channel").alias("neighbour")).distinct().withColumn("_bad", F.lit(1))
    near = bad.select(*keys, "channel").distinct().join(edges.select("channel", "neighbour"), "channel", "left").join(worse, [*keys, "neighbour"], "left")
    ok = near.groupBy(*keys, "channel").agg(((F.count("neighbour") >= 2) & (F.coalesce(F.sum("_bad"), F.lit(0)) == 0)).alias("repairable"))
    return bad.join(ok, [*keys, "channel"], "left")


def repair_neighbours(df: DataFrame, names: Sequence[str], broken: Sequence[str], weights: dict[str, dict[str, float]]) -> DataFrame:
    """Replaces channels, in order, by the weighted mean of their neighbours; later ones see earlier repairs."""
    at = {n: i for i, n in enumerate(names)}
    m = np.eye(len(names))
    for b in broken:
        near = {k: w for k, w in weights.get(b, {}).items() if k in at}
        if len(near) >= 2:
            m[at[b]] = sum(w * m[at[k]] for k, w in near.items())
    return linear_map(df, names, m)


def repair_spherical(df: DataFrame, names: Sequence[str], broken: Sequence[str], positions: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Replaces channels by spherical-spline interpolation from the good ones."""
    good = [n for n in names if n not in set(broken)]
    w = spherical_weights(np.array([positions[n] for n in good]), np.array([positions[n] for n in broken]))
    m = np.eye(len(names))
    for i, b in enumerate(broken):
        row = np.zeros(len(names))
        row[[names.index(g) for g in good]] = w[i]
        m[names.index(b)] = row
    return linear_map(df, names, m)


def repair_epochs(df: DataFrame, names: Sequence[str], bad: DataFrame, weights: dict[str, dict[str, float]], keys: Sequence[str] = ("condition", "epoch")) -> DataFrame:
    """Neighbour repair of the listed (keys, channel), trial by trial, in one projection."""
    lists = bad.groupBy(*keys).agg(F.collect_set("channel").alias("_broken"))
    out = df.join(lists, list(keys), "left")
    new = {}
    for n in names:
        near = {k: w for k, w in weights.get(n, {}).items() if k in names}
        if len(near) >= 2:
            value = reduce(lambda a, b: a + b, [F.col(k) * F.lit(float(w)) for k, w in near.items()])
            new[n] = F.when(F.coalesce(F.array_contains("_broken", n), F.lit(False)), value).otherwise(F.col(n))
    return out.withColumns(new).drop("_broken")


def repair_flagged_epochs(df: DataFrame, names: Sequence[str], flag: str, threshold: float, weights: dict[str, dict[str, float]], keys: Sequence[str] = ("condition", "epoch")) -> DataFrame:
    """In trials with a flagged sample, repairs the channels whose |x| exceeds the threshold."""
    flagged = df.groupBy(*keys).agg(F.max(F.col(flag)).alias("_any"), *[F.max(F.abs(n)).alias(n) for n in names]).filter("_any")
    bad = melt(flagged, keys, names).filter(F.col("value") > threshold).select(*keys, "channel")
    return repair_epochs(df, names, bad, weights, keys)


def electrode_repairs(repairs: DataFrame, participant: str = "participant") -> DataFrame:
    """Participants per repaired electrode, most first."""
    return repairs.groupBy("channel").agg(F.countDistinct(participant).alias("n_participants")).orderBy(F.col("n_participants").desc(), "channel")


def component_counts(components: DataFrame, participant: str = "participant") -> DataFrame:
    """Per class of component: total and mean per participant, to two decimals."""
    people = components.select(participant).distinct().agg(F.count(F.lit(1)).alias("_n"))
    totals = components.groupBy("class").agg(F.count("component").alias("total"))
    return totals.crossJoin(people).select("class", "total", F.bround(F.col("total") / F.col("_n"), 2).alias("mean"))
