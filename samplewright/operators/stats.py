"""Paired and independent tests, and cluster permutation tests.

Input is long: condition, participant, channel, time, value. Observed tests are
one aggregate. For permutations the block participants x channels x time of two
conditions is a small array; permutation numbers are spread over the cluster and
each task returns one row per permutation.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numeric as num
from .series import ship


def prepare(df: DataFrame, conditions: tuple, design: str = "paired", baseline: tuple[float, float] | None = None, analysis: tuple[float, float] | None = None) -> DataFrame:
    """Two conditions, baseline-corrected and cut to the analysis interval; paired keeps participants that have both."""
    rows = df.filter(F.col("condition").isin(*conditions))
    if baseline is not None:
        w = Window.partitionBy("condition", "participant", "channel")
        rows = rows.withColumn("value", F.col("value") - F.avg(F.when(F.col("time").between(*baseline), F.col("value"))).over(w))
    if analysis is not None:
        rows = rows.filter(F.col("time").between(*analysis))
    rows = rows.withColumn("side", F.when(F.col("condition") == conditions[0], "a").otherwise("b"))
    if design == "paired":
        both = rows.groupBy("participant").agg(F.countDistinct("side").alias("n")).filter("n = 2").select("participant")
        rows = rows.join(both, "participant", "left_semi")
    return rows


def t_table(prepared: DataFrame, design: str = "paired") -> DataFrame:
    """(channel, time, t, df): paired, or pooled-variance for independent samples. 0/0 is NaN, x/0 infinite."""
    is_a = F.col("side") == "a"
    if design == "paired":
        pairs = prepared.groupBy("participant", "channel", "time").agg((F.max(F.when(is_a, F.col("value"))) - F.max(F.when(~is_a, F.col("value")))).alias("d"))
        out = pairs.groupBy("channel", "time").agg(F.avg("d").alias("m"), F.stddev_samp("d").alias("s"), F.count("d").alias("n"))
        se, df = F.col("s") / F.sqrt("n"), (F.col("n") - 1).cast("double")
    else:
        a, b = F.when(is_a, F.col("value")), F.when(~is_a, F.col("value"))
        out = prepared.groupBy("channel", "time").agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.count(a).alias("na"), F.count(b).alias("nb"))
        df = (F.col("na") + F.col("nb") - 2).cast("double")
        pooled = ((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / df
        out = out.withColumn("m", F.col("ma") - F.col("mb"))
        se = F.sqrt(pooled * (F.try_divide(F.lit(1.0), F.col("na")) + F.try_divide(F.lit(1.0), F.col("nb"))))
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    t = F.when(se > 0, F.col("m") / F.nullif(se, F.lit(0.0))).when(F.col("m") > 0, inf).when(F.col("m") < 0, -inf).otherwise(nan)
    return out.select("channel", "time", t.alias("t"), df.alias("df"))


def add_p(table: DataFrame, tail: str = "both") -> DataFrame:
    """Adds p from the t distribution, in Arrow batches."""
    ship(table)
    schema = T.StructType([*table.schema.fields, T.StructField("p", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            t, df = b.column("t").to_numpy(zero_copy_only=False).astype(float), b.column("df").to_numpy(zero_copy_only=False).astype(float)
            p = np.full(len(t), np.nan)
            for d in np.unique(df[~np.isnan(df)]):
                p[df == d] = num.t_p(t[df == d], d, tail)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], schema.names)

    return table.mapInArrow(run, schema)


def analytic_test(prepared: DataFrame, design: str = "paired", alpha: float = 0.05, tail: str = "both", correction: str = "no") -> DataFrame:
    """(channel, time, t, df, p, significant); Bonferroni divides alpha by the number of defined p."""
    out = add_p(t_table(prepared, design), tail)
    level = F.lit(alpha)
    if correction == "bonferroni":
        level = level / F.count_if(~F.isnan("p")).over(Window.partitionBy())
    return out.withColumn("significant", ~F.isnan("p") & (F.col("p") <= level))


# ---- clusters -------------------------------------------------------------


def block(prepared: DataFrame) -> tuple[np.ndarray, np.ndarray, list, list]:
    """(a, b, channels, times): participants x channels x time arrays; bounded by the averages of one study."""
    pdf = prepared.select("side", "participant", "channel", "time", "value").toPandas()
    names, times = sorted(pdf["channel"].unique()), sorted(pdf["time"].unique())
    out = []
    for side in "ab":
        part = pdf[pdf["side"] == side].pivot_table(index="participant", columns=["channel", "time"], values="value")
        part = part.reindex(columns=[(c, t) for c in names for t in times])
        out.append(part.to_numpy().reshape(len(part), len(names), len(times)))
    return out[0], out[1], names, times


def t_map(a: np.ndarray, b: np.ndarray, design: str = "paired") -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        if design == "paired":
            d = a - b
            return d.mean(axis=0) / (d.std(axis=0, ddof=1) / np.sqrt(len(d)))
        n, m = len(a), len(b)
        pooled = ((n - 1) * a.var(axis=0, ddof=1) + (m - 1) * b.var(axis=0, ddof=1)) / (n + m - 2)
        return (a.mean(axis=0) - b.mean(axis=0)) / np.sqrt(pooled * (1 / n + 1 / m))


def shuffled(a: np.ndarray, b: np.ndarray, design: str, seed: int, perm: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, perm])
    if design == "paired":
        swap = rng.random(len(a)) < 0.5
        return np.where(swap[:, None, None], b, a), np.where(swap[:, None, None], a, b)
    both = np.concatenate([a, b])[rng.permutation(len(a) + len(b))]
    return both[: len(a)], both[len(a) :]


def prefilter(mask: np.ndarray, near: np.ndarray, least: int) -> np.ndarray:
    """Drops points with fewer than `least` significant neighbouring channels (itself counted) until none is left."""
    mask = mask.copy()
    while least > 0:
        count = near.astype(int) @ mask.astype(int)
        drop = mask & (count < least)
        if not drop.any():
            break
        mask[drop] = False
    return mask


def find_clusters(mask: np.ndarray, near: np.ndarray, kind: str = "spatiotemporal") -> list[np.ndarray]:
    """Connected sets of (channel, time) points, as boolean maps."""
    label = np.zeros(mask.shape, dtype=int)
    out = []
    for c, t in zip(*np.nonzero(mask), strict=True):
        if label[c, t]:
            continue
        label[c, t] = len(out) + 1
        stack, member = [(c, t)], np.zeros(mask.shape, dtype=bool)
        while stack:
            i, k = stack.pop()
            member[i, k] = True
            steps = []
            if kind in ("spatial", "spatiotemporal"):
                steps += [(j, k) for j in np.flatnonzero(near[i])]
            if kind in ("temporal", "spatiotemporal"):
                steps += [(i, k + d) for d in (-1, 1) if 0 <= k + d < mask.shape[1]]
            for j, m in steps:
                if mask[j, m] and not label[j, m]:
                    label[j, m] = len(out) + 1
                    stack.append((j, m))
        out.append(member)
    return out


def cluster_sum(member: np.ndarray, t: np.ndarray, members_only: bool = False) -> float:
    """Sum of t over the cluster's channels x times, or over its members only."""
    if members_only:
        return float(np.nansum(t[member]))
    return float(np.nansum(t[np.ix_(member.any(axis=1), member.any(axis=0))]))


def _extremes(t, high, low, near, kind, least, tail):
    clean = np.where(np.isfinite(t), t, 0)
    best = [0.0, 0.0]
    if tail in ("both", "right"):
        best[0] = max([cluster_sum(m, clean) for m in find_clusters(prefilter(clean > high, near, least), near, kind)], default=0.0)
    if tail in ("both", "left"):
        best[1] = min([cluster_sum(m, clean) for m in find_clusters(prefilter(clean < low, near, least), near, kind)], default=0.0)
    return best


def _null_maps(perms: DataFrame, shared, design: str, seed: int, tail: str):
    """Arrow batches of permutation numbers -> their t maps (absolute for both tails), one after another."""

    def maps(batches):
        x, y, _ = shared.value
        for batch in batches:
            for p in batch.column(0).to_pylist():
                t = t_map(*shuffled(x, y, design, seed, p), design).ravel()
                yield np.abs(t) if tail == "both" else t

    return maps


def _point_quantiles(perms: DataFrame, maps, q: float, shape: tuple[int, int]) -> np.ndarray:
    """The q quantile of each point's values over all permutations: exact, one aggregate."""

    def values(batches):
        import pyarrow as pa

        for t in maps(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(t))), pa.array(t)], ["point", "t"])

    rows = perms.mapInArrow(values, "point long, t double").filter(~F.isnan("t"))
    out = np.full(shape[0] * shape[1], np.nan)
    for r in rows.groupBy("point").agg(F.percentile("t", F.lit(q)).alias("t")).collect():  # one number per point
        out[r["point"]] = r["t"]
    return out.reshape(shape)


def _pooled_quantile(perms: DataFrame, maps, q: float, bins: int = 1 << 12, few: int = 1 << 14) -> float:
    """The q quantile of all values of all permutations' maps: exact (linear between two order statistics).

    Tasks return histograms of the range that holds the order statistic; it shrinks
    to a bin each time, until a few values are left in it, and these are returned.
    """

    def gathered(lo: float, hi: float, keep: bool):
        def task(batches):
            import pyarrow as pa

            hist, below, inside = np.zeros(bins, dtype=np.int64), 0, []
            for t in maps(batches):
                t = t[~np.isnan(t)]
                below += int((t < lo).sum())
                v = t[(t >= lo) & (t <= hi)]
                if keep:
                    inside += v.tolist()
                hist += np.bincount(np.searchsorted(edges(lo, hi), v, "right"), minlength=bins)
            yield pa.RecordBatch.from_arrays([pa.array([hist.tolist()]), pa.array([below]), pa.array([inside], pa.list_(pa.float64()))], ["hist", "below", "inside"])

        got = perms.mapInArrow(task, "hist array<long>, below long, inside array<double>").collect()
        return np.sum([r["hist"] for r in got], axis=0), sum(r["below"] for r in got), sorted(x for r in got for x in r["inside"])

    def edges(lo: float, hi: float) -> np.ndarray:
        """Inner edges of the bins: bin i holds edge i - 1 <= x < edge i."""
        if np.isfinite(lo) and np.isfinite(hi):
            return np.linspace(lo, hi, bins + 1)[1:-1]
        return np.concatenate([-np.geomspace(1e9, 1e-3, bins // 2), np.geomspace(1e-3, 1e9, bins - 1 - bins // 2)])

    def statistic(k: int) -> float:
        lo, hi = -np.inf, np.inf
        while True:
            hist, below, _ = gathered(lo, hi, False)
            total = below + np.cumsum(hist)
            b = int(np.searchsorted(total, k, "right"))
            inner = np.concatenate([[lo], edges(lo, hi), [hi]])
            narrow = (max(lo, inner[b]), min(hi, inner[b + 1]))
            if hist[b] <= few or narrow == (lo, hi) or narrow[0] == narrow[1]:
                _, below, inside = gathered(*narrow, True) if hist[b] <= few else (None, 0, None)
                return inside[k - below] if inside else narrow[0]
            lo, hi = narrow

    n = int(gathered(-np.inf, np.inf, False)[0].sum())
    if not n:
        return float("nan")
    at = q * (n - 1)
    a, b = (statistic(int(k)) for k in (np.floor(at), np.ceil(at)))
    return a + (b - a) * (at - np.floor(at)) if np.isfinite(b - a) else b


def permutation_test(
    prepared: DataFrame,
    edges: Sequence[tuple[str, str]] = (),
    design: str = "paired",
    n_permutations: int = 1000,
    threshold: float = 0.05,
    threshold_method: str = "parametric",
    cluster_type: str = "spatiotemporal",
    min_num_neighbors: int = 0,
    tail: str = "both",
    alpha: float = 0.05,
    seed: int = 0,
) -> DataFrame:
    """Clusters with p values: id, polarity, channels, times, stat, p, significant.

    Thresholds: parametric, nonparametric_common (one quantile of pooled |t|) or
    nonparametric_individual (a quantile per point), over the maps of all permutations.
    """
    spark = prepared.sparkSession
    a, b, names, times = block(prepared)
    df = len(a) - 1 if design == "paired" else len(a) + len(b) - 2
    near = np.eye(len(names), dtype=bool)
    at = {n: i for i, n in enumerate(names)}
    for x, y in edges:
        if x in at and y in at:
            near[at[x], at[y]] = near[at[y], at[x]] = True
    level = 1 - threshold / (2 if tail == "both" else 1)
    perms = spark.range(n_permutations)
    ship(perms)
    shared = spark.sparkContext.broadcast((a, b, near))
    if threshold_method == "parametric":
        high = num.t_quantile(level, df)
    else:
        q = 1 - threshold if tail == "both" else level
        maps = _null_maps(perms, shared, design, seed, tail)
        high = _pooled_quantile(perms, maps, q) if threshold_method == "nonparametric_common" else _point_quantiles(perms, maps, q, a.shape[1:])
    low = -high

    def run(batches):
        import pyarrow as pa

        x, y, close = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            got = [_extremes(t_map(*shuffled(x, y, design, seed, p), design), high, low, close, cluster_type, min_num_neighbors, tail) for p in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64())], ["perm", "most", "least"])

    null = perms.mapInArrow(run, "perm long, most double, least double").toPandas()
    t = np.where(np.isfinite(m := t_map(a, b, design)), m, 0)
    rows = []
    for sign, mask in ((1, t > high), (-1, t < low)):
        if (sign > 0 and tail == "left") or (sign < 0 and tail == "right"):
            continue
        for member in find_clusters(prefilter(mask, near, min_num_neighbors), near, cluster_type):
            s = cluster_sum(member, t)
            beyond = int((null["most"] >= s).sum() if sign > 0 else (null["least"] <= s).sum())
            p = (1 + beyond) / (n_permutations + 1)
            rows.append((sign, [names[i] for i in np.flatnonzero(member.any(axis=1))], [float(times[i]) for i in np.flatnonzero(member.any(axis=0))], s, p, p < alpha))
    rows.sort(key=lambda r: (not r[5], -abs(r[3])))
    rows = [(i, "positive" if r[0] > 0 else "negative", *r[1:]) for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(rows, "id int, polarity string, channels array<string>, times array<double>, stat double, p double, significant boolean")
