"""Representational similarity: dissimilarity matrices, model comparison, noise ceilings.

A matrix is long: keys (such as time), i, j with i < j, d. Patterns are arrays,
compared pair by pair with array functions, without Python.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as num
from .series import ship


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _centred(x: Column) -> Column:
    n = F.size(x).cast("double")
    mean = _sum(x) / n
    return F.transform(x, lambda v: v - mean)


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays; NaN if either is constant."""
    x, y = _centred(a), _centred(b)
    dot = _sum(F.zip_with(x, y, lambda p, q: p * q))
    norm = F.sqrt(_sum(F.transform(x, lambda p: p * p)) * _sum(F.transform(y, lambda p: p * p)))
    return F.when(norm > 0, dot / F.nullif(norm, F.lit(0.0))).otherwise(float("nan"))


def ranked(x: Column) -> Column:
    """Ranks of an array's values, ties averaged."""
    return F.transform(x, lambda v: _sum(F.transform(x, lambda u: F.when(u < v, 1.0).when(u == v, 0.5).otherwise(0.0))) + 0.5)


def dissimilarity(a: Column, b: Column, measure: str = "correlation") -> Column:
    if measure == "correlation":
        return 1 - pearson(a, b)
    if measure == "spearman":
        return 1 - pearson(ranked(a), ranked(b))
    if measure == "euclidean":
        return F.sqrt(_sum(F.zip_with(a, b, lambda p, q: (p - q) * (p - q))))
    raise ValueError(f"unknown measure {measure}")


def condition_patterns(long: DataFrame, keys: Sequence[str] = ("time",), condition: str = "condition", feature: str = "channel", value: str = "value") -> DataFrame:
    """Mean over trials of each feature, as one array per condition in feature order."""
    means = long.groupBy(*keys, condition, feature).agg(F.avg(value).alias("v"))
    packed = means.groupBy(*keys, condition).agg(F.array_sort(F.collect_list(F.struct(F.col(feature).alias("f"), F.col("v")))).alias("p"))
    return packed.select(*keys, F.col(condition).alias("condition"), F.transform("p", lambda s: s["v"]).alias("pattern"))


def mean_patterns(df: DataFrame, keys: Sequence[str] = (), condition: str = "condition", pattern: str = "pattern") -> DataFrame:
    """Element-wise mean of pattern arrays per condition."""
    long = df.select(*keys, F.col(condition).alias("condition"), F.posexplode(pattern).alias("channel", "value"))
    return condition_patterns(long, keys)


def pairs(patterns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Both patterns of every pair i < j of conditions within keys: a non-equi self-join per key."""
    a = patterns.select(*keys, F.col("condition").alias("i"), F.col("pattern").alias("a"))
    b = patterns.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("condition").alias("j"), F.col("pattern").alias("b"))
    on = F.col("i") < F.col("j")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return a.join(b, on).drop(*[f"_{k}" for k in keys])


def rdm(patterns: DataFrame, measure: str = "correlation", keys: Sequence[str] = (), covariance: np.ndarray | None = None) -> DataFrame:
    """(keys, i, j, d). Mahalanobis takes the pooled covariance, by which patterns are whitened first."""
    if measure == "mahalanobis":
        inverse = np.linalg.pinv(covariance if covariance is not None else np.eye(1))
        white = np.linalg.cholesky((inverse + inverse.T) / 2 + 1e-15 * np.eye(len(inverse)))
        rows = [F.array(*[F.lit(float(w)) for w in white[:, k]]) for k in range(white.shape[1])]
        patterns = patterns.withColumn("pattern", F.array(*[_sum(F.zip_with("pattern", r, lambda p, q: p * q)) for r in rows]))
        measure = "euclidean"
    return pairs(patterns, keys).select(*keys, "i", "j", dissimilarity(F.col("a"), F.col("b"), measure).alias("d"))


def pooled_covariance(patterns: DataFrame, pattern: str = "pattern") -> np.ndarray:
    """Covariance of all trials plus a ridge of 1e-6 of its mean variance; sums are aggregated, features squared are returned."""
    n = patterns.select(F.size(pattern)).first()[0]
    x = patterns.select(*[F.element_at(pattern, k + 1).alias(f"x{k}") for k in range(n)])
    cells = [F.covar_samp(f"x{a}", f"x{b}") for a in range(n) for b in range(a + 1)]
    row = x.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).first()
    out, i = np.zeros((n, n)), 0
    for a in range(n):
        for b in range(a + 1):
            out[a, b] = out[b, a] = row[i]
            i += 1
    return out + 1e-6 * np.trace(out) / n * np.eye(n)


def rsa(long: DataFrame, measure: str = "correlation", keys: Sequence[str] = ("time",), normalise: str = "none", **names) -> DataFrame:
    """The matrix per key over condition-average patterns."""
    return normalise_rdm(rdm(condition_patterns(long, keys, **names), measure, keys), normalise, keys)


def normalise_rdm(matrix: DataFrame, method: str = "none", keys: Sequence[str] = ()) -> DataFrame:
    """zscore, rank (ordinal) or minmax over the upper triangle."""
    w = Window.partitionBy(*keys)
    if method == "none":
        return matrix
    if method == "zscore":
        sd = F.stddev_samp("d").over(w)
        return matrix.withColumn("d", F.when(sd > 0, (F.col("d") - F.avg("d").over(w)) / F.nullif(sd, F.lit(0.0))).otherwise(0.0))
    if method == "rank":
        return matrix.withColumn("d", F.row_number().over(w.orderBy("d", "i", "j")).cast("double"))
    if method == "minmax":
        lo, hi = F.min("d").over(w), F.max("d").over(w)
        return matrix.withColumn("d", F.when(hi > lo, (F.col("d") - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise(0.0))
    raise ValueError(f"unknown method {method}")


def with_ranks(matrix: DataFrame, keys: Sequence[str] = (), column: str = "d") -> DataFrame:
    """Replaces a column by its rank within keys, ties averaged."""
    w = Window.partitionBy(*keys)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, column))
    return matrix.withColumn(column, F.rank().over(w.orderBy(column)) + (ties - 1) / 2)


def correlate(matrix: DataFrame, model: DataFrame, method: str = "spearman", keys: Sequence[str] = ()) -> DataFrame:
    """Correlation per key of a matrix with a model (i, j, m)."""
    both = matrix.join(model.select("i", "j", F.col("d").alias("m")), ["i", "j"])
    if method == "spearman":
        both = with_ranks(with_ranks(both, keys, "d"), keys, "m")
    return both.groupBy(*keys).agg(F.corr("d", "m").alias("r"))


def compare_models(matrix: DataFrame, models: dict[str, DataFrame], method: str = "spearman", keys: Sequence[str] = ("time",), n_permutations: int = 1000, seed: int = 0) -> DataFrame:
    """(model, keys, r, p): p is the share of condition relabellings with |r| as large."""
    ship(matrix)
    out = None
    types = {f.name: f.dataType.simpleString() for f in matrix.schema}
    ddl = "model string, " + "".join(f"{k} {types[k]}, " for k in keys) + "r double, p double"
    for name, model in models.items():
        both = matrix.join(model.select("i", "j", F.col("d").alias("m")), ["i", "j"])
        part = both.groupBy(*keys).applyInArrow(_relabelled(name, method, list(keys), n_permutations, seed), ddl)
        out = part if out is None else out.unionByName(part)
    return out


def _relabelled(name: str, method: str, keys: list[str], n_permutations: int, seed: int):
    def run(key, table):
        import pyarrow as pa

        i, j = np.array(table.column("i").to_pylist()), np.array(table.column("j").to_pylist())
        d, m = table.column("d").to_numpy(zero_copy_only=False).astype(float), table.column("m").to_numpy(zero_copy_only=False).astype(float)
        if method == "spearman":
            d, m = num.ranks(d), num.ranks(m)
        nodes, flat = np.unique(np.concatenate([i, j]), return_inverse=True)
        a, b = flat[: len(i)], flat[len(i) :]
        square = np.zeros((len(nodes), len(nodes)))
        square[a, b] = square[b, a] = m
        corr = lambda x: float(np.corrcoef(d, x)[0, 1])
        r, rng, hits = corr(m), np.random.default_rng(seed), 0
        for _ in range(n_permutations):
            p = rng.permutation(len(nodes))
            hits += abs(corr(square[p[a], p[b]])) >= abs(r)
        cols = {k: pa.array([v.as_py()], v.type) for k, v in zip(keys, key, strict=True)}
        return pa.table({"model": [name]} | cols | {"r": [r], "p": [hits / n_permutations if n_permutations else float("nan")]})

    return run


def grand_average(matrices: DataFrame, keys: Sequence[str] = ("time",)) -> DataFrame:
    """Mean matrix over participants."""
    return matrices.groupBy(*keys, "i", "j").agg(F.avg("d").alias("d"), F.count("d").alias("n"))


def noise_ceiling(matrices: DataFrame, method: str = "spearman", keys: Sequence[str] = ("time",), participant: str = "participant") -> DataFrame:
    """(keys, lower, upper): mean correlation of each participant with the others' mean, and with the mean of all."""
    w = Window.partitionBy(*keys, "i", "j")
    n = F.count("d").over(w)
    rows = matrices.withColumn("all", F.avg("d").over(w)).withColumn("others", F.when(n > 1, (F.sum("d").over(w) - F.col("d")) / F.nullif(n - 1, F.lit(0))))
    group = [*keys, participant]
    if method == "spearman":
        for c in ("d", "all", "others"):
            rows = with_ranks(rows, group, c)
    each = rows.groupBy(*group).agg(F.corr("d", "others").alias("lo"), F.corr("d", "all").alias("hi"))
    return each.groupBy(*keys).agg(F.avg("lo").alias("lower"), F.avg("hi").alias("upper"))


def crossvalidated(long: DataFrame, measure: str = "correlation", method: str = "splithalf", n_folds: int = 5, n_iterations: int = 100, keys: Sequence[str] = ("time",), epoch: str = "epoch", seed: int = 0) -> DataFrame:
    """Mean over splits of the matrices between training and held-out patterns, made symmetric.

    splithalf: random halves per iteration; kfold: folds by hash; loo: every trial
    held out in turn (numbered within its condition).
    """
    if method == "splithalf":
        number = F.explode(F.sequence(F.lit(1), F.lit(n_iterations)))
        rows = long.withColumn("_split", number)
        rows = rows.withColumn("_test", F.pmod(F.xxhash64(epoch, "_split", F.lit(seed)), F.lit(2)) == 0)
    else:
        nth = F.dense_rank().over(Window.partitionBy(*keys, "condition").orderBy(epoch))
        fold = F.pmod(nth, F.lit(n_folds)) if method == "kfold" else nth
        rows = long.withColumn("_fold", fold)
        last = F.lit(n_folds - 1) if method == "kfold" else F.max("_fold").over(Window.partitionBy(*keys))
        rows = rows.withColumn("_last", last).withColumn("_split", F.explode(F.sequence(F.lit(0 if method == "kfold" else 1), F.col("_last")))).drop("_last")
        rows = rows.withColumn("_test", F.col("_fold") == F.col("_split")).drop("_fold")
    part = lambda test: condition_patterns(rows.filter(F.col("_test") if test else ~F.col("_test")), [*keys, "_split"])
    k = [*keys, "_split"]
    a = part(False).select(*k, F.col("condition").alias("i"), F.col("pattern").alias("a"))
    b = part(True).select(*k, F.col("condition").alias("j"), F.col("pattern").alias("b"))
    d = a.join(b, k).filter("i <> j").select(*k, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), dissimilarity(F.col("a"), F.col("b"), measure).alias("d"))
    return d.groupBy(*keys, "i", "j").agg(F.avg("d").alias("d"))


def model_from_values(df: DataFrame, item: str, value: str, how: str = "difference") -> DataFrame:
    """Model matrix of |x_i - x_j| (difference) or of unequal labels as 1 (categorical)."""
    a, b = df.select(F.col(item).alias("i"), F.col(value).alias("a")), df.select(F.col(item).alias("j"), F.col(value).alias("b"))
    d = F.abs(F.col("a") - F.col("b")) if how == "difference" else (F.col("a") != F.col("b")).cast("double")
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", d.cast("double").alias("d"))


def model_from_vectors(df: DataFrame, item: str, vector: str, measure: str = "correlation") -> DataFrame:
    return rdm(df.select(F.col(item).alias("condition"), F.col(vector).alias("pattern")), measure)


def model_from_similarity(matrix: DataFrame) -> DataFrame:
    """1 - min-max scaled similarity; (i, j, s) -> (i, j, d)."""
    w = Window.partitionBy()
    lo, hi = F.min("s").over(w), F.max("s").over(w)
    return matrix.select("i", "j", (1 - F.when(hi > lo, (F.col("s") - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise(0.0)).alias("d"))


def model_from_condensed(spark, distances: Sequence[float], n: int) -> DataFrame:
    """Upper-triangle distances in row order, items numbered from 1."""
    if len(distances) != n * (n - 1) // 2:
        raise ValueError("wrong number of distances")
    it = iter(distances)
    return spark.createDataFrame([(i, j, float(next(it))) for i in range(1, n + 1) for j in range(i + 1, n + 1)], "i int, j int, d double")


def resample_times(df: DataFrame, targets: DataFrame, keys: Sequence[str], time: str = "time", value: str = "value", method: str = "linear") -> DataFrame:
    """Values at target times by linear or nearest interpolation, clamped at the ends: an as-of join on either side."""
    w = Window.partitionBy(*keys).orderBy(time, "_kind")
    known = df.select(*keys, time, value, F.lit(0).alias("_kind"))
    asked = df.select(*keys).distinct().crossJoin(targets.select(F.col(time))).withColumn(value, F.lit(None).cast("double")).withColumn("_kind", F.lit(1))
    rows = known.unionByName(asked)
    point = F.when(F.col("_kind") == 0, F.struct(F.col(time).alias("t"), F.col(value).alias("v")))
    rows = rows.withColumn("_a", F.last(point, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first(point, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    t0, v0, t1, v1, t = F.col("_a.t"), F.col("_a.v"), F.col("_b.t"), F.col("_b.v"), F.col(time)
    if method == "nearest":
        between = F.when(t - t0 <= t1 - t, v0).otherwise(v1)
    else:
        between = v0 + (v1 - v0) * F.coalesce((t - t0) / F.nullif(t1 - t0, F.lit(0.0)), F.lit(0.0))
    out = F.when(F.col("_a").isNull(), v1).when(F.col("_b").isNull() | (t0 == t), v0).otherwise(between)
    return rows.filter("_kind = 1").select(*keys, time, out.alias(value))


def temporal_model(df: DataFrame, targets: DataFrame | None = None, item: str = "condition", feature: str = "channel", measure: str = "euclidean", time: str = "time") -> DataFrame:
    """A model matrix per time point of feature series, resampled to target times if given."""
    if targets is not None:
        df = resample_times(df, targets, [item, feature], time)
    return rdm(condition_patterns(df, [time], item, feature), measure, [time])
