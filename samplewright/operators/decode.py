"""Pattern decoding: linear support vectors per time point, and tests against chance."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as num
from .series import ship
from .stats import find_clusters


def complete_participants(df: DataFrame, condition: str = "condition", participant: str = "participant") -> DataFrame:
    """Keeps participants that have every condition."""
    n = df.select(condition).distinct().count()
    ok = df.groupBy(participant).agg(F.countDistinct(condition).alias("n")).filter(F.col("n") == n).select(participant)
    return df.join(ok, participant, "left_semi")


def svms(x: np.ndarray, rows: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 200, tol: float = 1e-4, seed: int = 0) -> np.ndarray:
    """Weights and bias of binary linear C-SVCs (labels +-1), by dual coordinate descent.

    One problem per line of `rows` (row numbers of x) and y; all have as many rows
    and visit them in the same order, so a step is one product for all of them.
    """
    rng = np.random.default_rng(seed)
    xb = np.hstack([x, np.ones((len(x), 1))])
    rows, y = np.ascontiguousarray(rows.T), np.ascontiguousarray(y.T, dtype=float)
    norm, a, w = (xb**2).sum(axis=1)[rows], np.zeros(rows.shape), np.zeros((rows.shape[1], xb.shape[1]))
    out, left = np.zeros_like(w), np.arange(len(w))
    for _ in range(rounds):
        g, before = np.empty_like(a), a.copy()
        for i in rng.permutation(len(rows)):
            z = xb.take(rows[i], axis=0)
            g[i] = y[i] * np.einsum("pd,pd->p", z, w) - 1
            a[i] = np.minimum(np.maximum(a[i] - g[i] / norm[i], 0), cost)
            w += ((a[i] - before[i]) * y[i])[:, None] * z
        worst = np.abs(np.where(before <= 0, np.minimum(g, 0), np.where(before >= cost, np.maximum(g, 0), g))).max(axis=0, initial=0)
        out[left], on = w, worst >= tol
        if not on.any():
            break
        if not on.all():
            rows, y, norm, a = (np.ascontiguousarray(v[:, on]) for v in (rows, y, norm, a))
            w, left = w[on], left[on]
    return out


def _box(a: np.ndarray, fixed: np.ndarray, cost: float, tol: float, most: int = 80) -> np.ndarray:
    """Weights fixed + a'alpha, 0 <= alpha <= cost, with the least |w|^2 / 2 + cost * hinge: a primal-dual interior point method.

    Rows of a are trials times their labels. A step is one product of (columns x columns).
    """
    kind = a.dtype.type
    alpha = np.full(len(a), kind(cost / 2))
    beta = alpha.copy()  # cost - alpha
    w, eye = fixed + alpha @ a, np.eye(a.shape[1], dtype=a.dtype)
    r = a @ w - 1
    s = np.maximum(r, 0) + kind(0.1)
    t = s - r

    def reach(da, ds, dt):
        worst = max(float((x / y).max()) for x, y in ((-da, alpha), (da, beta), (-ds, s), (-dt, t)))
        return 1 / worst if worst > 1 else 1.0

    for _ in range(most):
        r = a @ w - 1
        gap = float(alpha @ s + beta @ t)
        if gap <= tol * max(1.0, float(cost * np.maximum(-r, 0).sum() + w @ w / 2)):
            break
        off, d = r - s + t, 1 / (s / alpha + t / beta)
        b = a * np.sqrt(d)[:, None]
        inverse = np.linalg.inv(eye + b.T @ b)

        def step(x, y):
            g = x / alpha - y / beta - off  # noqa: B023
            dw = inverse @ ((g * d) @ a)  # noqa: B023
            da = (g - a @ dw) * d  # noqa: B023
            return dw, da, (x - s * da) / alpha, (y + t * da) / beta

        _, da, ds, dt = step(-alpha * s, -beta * t)
        f = kind(reach(da, ds, dt))
        left = float((alpha + f * da) @ (s + f * ds) + (beta - f * da) @ (t + f * dt))
        aim = kind((left / gap) ** 3 * gap / (2 * len(a)))
        dw, da, ds, dt = step(aim - alpha * s - da * ds, aim - beta * t + da * dt)
        f = kind(min(1.0, 0.99 * reach(da, ds, dt)))
        w, alpha, beta, s, t = w + f * dw, alpha + f * da, beta - f * da, s + f * ds, t + f * dt
    return w


def plane(a: np.ndarray, cost: float = 1.0, tol: float = 1e-9, small: int = 1024) -> np.ndarray:
    """The weights of one binary C-SVC to a relative duality gap of tol; rows of a are (trial, 1) times the label.

    Many rows are solved roughly first. Those far from the margin then stay on
    their sides, the others are solved to the end, and all are looked at again:
    rows that turn out on the other side join the others until there are none.
    """
    none = np.zeros(a.shape[1])
    if len(a) <= small:
        return _box(a, none, cost, tol)
    w = _box(a.astype(np.float32), none.astype(np.float32), cost, 1e-2).astype(float)
    m = a @ w - 1
    near = max(small // 2, len(a) // 12)
    band = np.zeros(len(a), dtype=bool)
    band[np.argpartition(np.abs(m), near)[:near]] = True
    while True:
        inside = ~band & (m < 0)
        w = _box(a[band], cost * (inside.astype(float) @ a), cost, tol)
        m = a @ w - 1
        wrong = ~band & ((m < 0) != inside)
        if not wrong.any():
            return w
        band |= np.abs(m) <= np.abs(m[wrong]).max()


def classify(train: np.ndarray, labels: np.ndarray, test: np.ndarray, cost: float = 1.0) -> np.ndarray:
    """Classes of the test rows by one-versus-one votes over standardised features; the lower class wins ties.

    Problems of no more rows than weights are solved together by coordinate descent, others one by one to the end.
    """
    mean, sd = train.mean(axis=0), train.std(axis=0, ddof=1)
    sd[sd == 0] = 1
    x, test = (train - mean) / sd, (test - mean) / sd
    classes = np.unique(labels)
    of = [np.flatnonzero(labels == c) for c in classes]
    votes = np.zeros((len(test), len(classes)))
    few: dict[int, list] = {}
    found = {}
    for i, j in combinations(range(len(classes)), 2):
        n = len(of[i]) + len(of[j])
        if n <= x.shape[1] + 1:
            rows = np.sort(np.concatenate([of[i], of[j]]))
            few.setdefault(n, []).append((i, j, rows, np.where(labels[rows] == classes[i], 1.0, -1.0)))
        else:
            a = np.ones((n, x.shape[1] + 1))
            a[: len(of[i]), :-1], a[len(of[i]) :, :-1] = x[of[i]], x[of[j]]
            a[len(of[i]) :] *= -1
            found[i, j] = plane(a, cost)
    for same in few.values():
        ws = svms(x, np.stack([p[2] for p in same]), np.stack([p[3] for p in same]), cost)
        found |= {(i, j): w for (i, j, *_), w in zip(same, ws, strict=True)}
    for (i, j), w in found.items():
        first = test @ w[:-1] + w[-1] >= 0
        votes[first, i] += 1
        votes[~first, j] += 1
    return classes[votes.argmax(axis=1)]


def decode(
    df: DataFrame,
    names: Sequence[str],
    keys: Sequence[str] = ("participant", "time"),
    condition: str = "condition",
    epoch: str = "epoch",
    n_iterations: int = 100,
    n_folds: int = 3,
    equalise: bool = True,
    cost: float = 1.0,
    seed: int = 0,
) -> DataFrame:
    """Per key: accuracy, its standard error over iterations, chance, and the confusion matrix (rows: true class, shares).

    Every iteration shuffles trials, equalises their numbers, and makes folds of
    n // k trials per class; the rest always train. A key's iterations are shared
    out over up to 20 tasks, each of which gets the key's trials.
    """
    ship(df)
    names, keys = list(names), list(keys)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    head = "".join(f"{k} {types[k]}, " for k in keys)
    parts = max(1, min(20, n_iterations))

    def run(key, table):
        import pyarrow as pa

        part = key[-1].as_py()
        table = table.sort_by([(condition, "ascending"), (epoch, "ascending")])
        x = np.column_stack([table.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names])
        classes, y = np.unique(np.array(table.column(condition).to_pylist()), return_inverse=True)
        rng, k = np.random.default_rng(seed), len(classes)
        scores, confusion = [], np.zeros((k, k))
        least = min((y == c).sum() for c in range(k))
        for turn in range(n_iterations):
            groups = [rng.permutation(np.flatnonzero(y == c)) for c in range(k)]
            if turn % parts != part:
                continue
            groups = [g[:least] if equalise else g for g in groups]
            right = total = 0
            for f in range(n_folds):
                test = np.concatenate([g[f * (len(g) // n_folds) : (f + 1) * (len(g) // n_folds)] for g in groups])
                train = np.setdiff1d(np.concatenate(groups), test)
                if not len(test) or not len(train):
                    continue
                got = classify(x[train], y[train], x[test], cost)
                right += int((got == y[test]).sum())
                total += len(test)
                np.add.at(confusion, (y[test], got), 1)
            scores.append(right / total if total else float("nan"))
        cols = {n: pa.array([v.as_py()], v.type) for n, v in zip(keys, key, strict=False)}
        return pa.table(cols | {"scores": pa.array([scores], pa.list_(pa.float64())), "counts": pa.array([confusion.tolist()], pa.list_(pa.list_(pa.float64())))})

    def gather(key, table):
        import pyarrow as pa

        scores, confusion = [s for part in table.column("scores").to_pylist() for s in part], np.sum([np.array(c) for c in table.column("counts").to_pylist()], axis=0)
        share = confusion / np.maximum(confusion.sum(axis=1, keepdims=True), 1)
        se = float(np.std(scores, ddof=1) / np.sqrt(len(scores))) if len(scores) > 1 else 0.0
        cols = {n: pa.array([v.as_py()], v.type) for n, v in zip(keys, key, strict=True)}
        return pa.table(cols | {"accuracy": [float(np.mean(scores))], "stderror": [se], "chance": [1.0 / len(share)], "confusion": pa.array([share.tolist()], pa.list_(pa.list_(pa.float64())))})

    rows = df.select(*dict.fromkeys([*keys, condition, epoch, *names]))
    rows = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = rows.repartitionByRange(max(4 * parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys, "_part")  # by hashes, some tasks would get several parts
    done = rows.groupBy(*keys, "_part").applyInArrow(run, head + "scores array<double>, counts array<array<double>>")
    return done.groupBy(*keys).applyInArrow(gather, head + "accuracy double, stderror double, chance double, confusion array<array<double>>")


def confusion_matrix(df: DataFrame, truth: str = "condition", predicted: str = "predicted") -> DataFrame:
    """Counts and row shares of (true, predicted)."""
    out = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(truth)))


def grand_average(decoded: DataFrame, time: str = "time") -> DataFrame:
    """Mean accuracy over participants with its standard error."""
    return decoded.groupBy(time).agg(
        F.avg("accuracy").alias("accuracy"), F.coalesce(F.stddev_samp("accuracy") / F.sqrt(F.count("accuracy")), F.lit(0.0)).alias("stderror"), F.count("accuracy").alias("n"), F.first("chance").alias("chance")
    )


def test_against_chance(decoded: DataFrame, alpha: float = 0.05, correction: str = "none", time: str = "time") -> DataFrame:
    """One-tailed one-sample t per time point."""
    from .stats import add_p

    out = decoded.groupBy(time).agg(F.avg(F.col("accuracy") - F.col("chance")).alias("m"), F.stddev_samp("accuracy").alias("s"), F.count("accuracy").alias("n"))
    se = F.col("s") / F.sqrt("n")
    t = F.when(se > 0, F.col("m") / F.nullif(se, F.lit(0.0))).when(F.col("m") > 0, float("inf")).when(F.col("m") < 0, float("-inf")).otherwise(float("nan"))
    out = add_p(out.select(time, t.alias("t"), (F.col("n") - 1).cast("double").alias("df")), "right")
    level = F.lit(alpha) / (F.count_if(~F.isnan("p")).over(Window.partitionBy()) if correction == "bonferroni" else F.lit(1))
    return out.withColumn("significant", ~F.isnan("p") & (F.col("p") <= level))


test_against_chance.__test__ = False


def chance_clusters(decoded: DataFrame, alpha: float = 0.05, n_permutations: int = 1000, statistic: str = "sum", time: str = "time", seed: int = 0) -> DataFrame:
    """Temporal clusters above chance with sign-flip p values: start, end, stat, p, significant."""
    spark = decoded.sparkSession
    pdf = decoded.select("participant", time, (F.col("accuracy") - F.col("chance")).alias("d")).toPandas()  # participants x times
    wide = pdf.pivot_table(index="participant", columns=time, values="d").sort_index(axis=1)
    d, times = wide.to_numpy(), wide.columns.to_numpy()
    high = num.t_quantile(1 - alpha, len(d) - 1)
    one = lambda z: z.mean(axis=0) / np.maximum(z.std(axis=0, ddof=1) / np.sqrt(len(z)), 1e-300)
    size = lambda t, m: float(t[m].sum()) if statistic == "sum" else float(m.sum())
    near = np.eye(1, dtype=bool)
    runs = lambda t: [m[0] for m in find_clusters((t > high)[None, :], near, "temporal")]
    perms = spark.range(n_permutations)
    ship(perms)
    shared = spark.sparkContext.broadcast(d)  # participants x times of one study

    def flipped(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_pylist()
            signs = [np.random.default_rng([seed, p]).choice([-1.0, 1.0], len(shared.value))[:, None] for p in ids]
            maps = [one(shared.value * s) for s in signs]
            yield pa.RecordBatch.from_arrays([pa.array([max([size(z, m) for m in runs(z)], default=0.0) for z in maps], pa.float64())], ["most"])

    t = one(d)
    null = np.array([r["most"] for r in perms.mapInArrow(flipped, "most double").collect()])  # one number per permutation
    rows = []
    for m in runs(t):
        s = size(t, m)
        p = (1 + int((null >= s).sum())) / (n_permutations + 1)
        rows.append((float(times[m][0]), float(times[m][-1]), s, p, bool(p < alpha)))
    return spark.createDataFrame(rows, "start double, end double, stat double, p double, significant boolean")
