"""Independent components: Infomax, removal, and detection of artifact components."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numeric as num
from .process import linear_map
from .series import ship


@dataclass(frozen=True)
class Ica:
    names: tuple[str, ...]
    unmixing: np.ndarray  # components x channels
    mixing: np.ndarray  # channels x components
    mean: np.ndarray
    scale: float
    variance: np.ndarray
    removed: tuple[int, ...] = ()

    @property
    def labels(self) -> list[str]:
        return [f"IC{i + 1}" for i in range(len(self.unmixing))]


def _moments(x: np.ndarray):
    """(number, mean, summed products about the mean) of samples x channels."""
    mean = x.mean(axis=0)
    y = x - mean
    return len(x), mean, y.T @ y


def _merge(parts: Sequence[tuple]):
    """The moments of all parts, in their order."""
    count, mean, products = parts[0]
    for n, m, p in parts[1:]:
        d = m - mean
        products = products + p + np.outer(d, d) * (count * n / (count + n))
        mean, count = mean + d * (n / (count + n)), count + n
    return count, mean, products


def _sphere(moments: tuple, n: int):
    """(mean, scale, sphering matrix n x channels of the centred and scaled data, covariance of these)."""
    count, mean, products = moments
    scale = float(np.sqrt(np.abs(products.sum()) / (count * len(mean)))) or 1.0
    cov = products / scale**2 / count
    values, vectors = np.linalg.eigh(cov)
    top = np.argsort(values)[::-1][:n]
    return mean, scale, (vectors[:, top] / np.sqrt(np.maximum(values[top], 1e-12))).T, cov


def _sums(x: np.ndarray, to: np.ndarray, offset: np.ndarray, signs: np.ndarray | None) -> list[np.ndarray]:
    """What a step needs of the samples: energy, score x component, slope x squared component, and moments of components to x + offset.

    The logistic model, or with signs that of extended Infomax.
    """
    u = x @ to.T + offset
    if signs is None:
        size = np.exp(-np.abs(u))
        energy = np.abs(u) + 2 * np.log1p(size)
        score = np.sign(u) * (1 - size) / (1 + size)
        slope = (1 - score * score) / 2
    else:
        t = np.tanh(u)
        energy = u * u / 2 + signs * (np.abs(u) + np.log1p(np.exp(-2 * np.abs(u))))
        score, slope = u + signs * t, 1 + signs * (1 - t * t)
    square = u * u
    return [np.array([len(x), energy.sum()]), score.T @ u, slope.T @ square, square.sum(axis=0), (square * square).sum(axis=0)]


class _Climb:
    """Infomax by all samples at once: the unmixing of sphered data at which the natural gradient 1 - E[score u'] is zero.

    A preconditioned quasi-Newton search (L-BFGS over block-diagonal curvatures).
    `trial` is the matrix to be evaluated next, until `done`.
    """

    def __init__(self, n: int, extended: bool, steps: int, tol: float):
        self.signs = np.ones(n) if extended else None
        self.trial = self.w = np.eye(n)
        self.left, self.tol, self.done, self.moved = steps, tol, steps < 1, 0
        self.value, self.memory, self.gradient = None, [], None

    def direction(self, gradient: np.ndarray) -> np.ndarray:
        q, used = gradient.copy(), []
        for s, y in reversed(self.memory):
            k = (s * q).sum() / (s * y).sum()
            q -= k * y
            used.append(k)
        h = self.curvature
        both = h * h.T - 1
        np.fill_diagonal(both, 1)
        z = (h.T * q - q.T) / both
        np.fill_diagonal(z, np.diag(q) / (1 + np.diag(h)))
        for (s, y), k in zip(self.memory, reversed(used), strict=True):
            z += s * (k - (y * z).sum() / (s * y).sum())
        return -z

    def tell(self, sums: list[np.ndarray]) -> None:
        """Takes the evaluation of `trial`: accepts it or goes less far."""
        (count, energy), cross, slope, m2, m4 = sums
        self.left -= 1
        value = energy / count - np.linalg.slogdet(self.trial)[1]
        first = self.value is None
        if not first and not value <= self.value + 1e-4 * self.far * self.slope + 1e-13 * abs(self.value):
            self.far /= 4
            if self.far < 1e-6:
                self.done = not self.memory  # nowhere lower
                self.memory = []
                self.plan(self.gradient)
        else:
            gradient = cross / count - np.eye(len(cross))
            if not first:
                s, y = self.far * self.step, gradient - self.gradient
                self.moved += 1
                if (s * y).sum() > 1e-14 * (s * s).sum():
                    self.memory = [*self.memory, (s, y)][-7:]
            self.w, self.value, self.gradient = self.trial, value, gradient
            h = slope / count
            least = (h + h.T - np.sqrt((h - h.T) ** 2 + 4)) / 2
            self.curvature = h + np.maximum(0.01 - least, 0)
            if self.signs is not None and not first and self.moved % 10 == 0:
                signs = np.where(m4 / count / np.maximum((m2 / count) ** 2, 1e-12) < 3, -1.0, 1.0)
                if (signs != self.signs).any():
                    self.signs, self.value, self.memory = signs, None, []  # another function: evaluate here again
            if self.value is not None:
                self.done = np.abs(gradient).max() < self.tol
                self.plan(gradient)
        self.trial = self.w if self.value is None else self.w + self.far * self.step @ self.w
        if not np.isfinite(self.w).all() or np.abs(self.w).max() > 1e8:  # no component there
            self.w, self.done = np.eye(len(self.w)), True
        self.done = bool(self.done or self.left < 1)

    def plan(self, gradient: np.ndarray) -> None:
        self.step = self.direction(gradient)
        if not (self.step * gradient).sum() < 0:
            self.memory = []
            self.step = self.direction(gradient)
        self.step = self.step * min(1.0, 0.5 / max(np.abs(self.step).max(), 1e-300))
        self.slope, self.far = float((self.step * gradient).sum()), 1.0


def _model(w: np.ndarray, sphere: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, ...]:
    """(unmixing, mixing, shares of variance), strongest component first."""
    unmixing = w @ sphere
    mixing = np.linalg.pinv(unmixing)
    variance = (mixing**2).sum(axis=0) * np.einsum("ij,jk,ik->i", unmixing, cov, unmixing)
    by = np.argsort(variance)[::-1]
    return unmixing[by], mixing[:, by], variance[by] / variance.sum()


def infomax(x: np.ndarray, n: int, extended: bool = False, steps: int = 512, tol: float = 1e-8) -> tuple[np.ndarray, ...]:
    """Infomax of samples x channels: (unmixing, mixing, mean, scale, variances), strongest component first."""
    parts = [x[at : at + _ROWS] for at in range(0, len(x), _ROWS)]
    mean, scale, sphere, cov = _sphere(_merge([_moments(p) for p in parts]), n)
    climb = _Climb(n, extended, steps, tol)
    while not climb.done:
        to = climb.trial @ sphere / scale
        sums = [_sums(p, to, -to @ mean, climb.signs) for p in parts]
        climb.tell([np.sum(v, axis=0) for v in zip(*sums, strict=True)])
    unmixing, mixing, variance = _model(climb.w, sphere, cov)
    return unmixing, mixing, mean, scale, variance


_ROWS = 1 << 14
_MODEL = "mean array<double>, scale double, unmixing array<array<double>>, mixing array<array<double>>, variance array<double>, artifacts array<int>, projection array<array<double>>, offset array<double>"


def fit_each(
    df: DataFrame,
    names: Sequence[str],
    keys: Sequence[str],
    order: Sequence[str] = ("sample",),
    n_components: int | None = None,
    percentage: float = 100.0,
    extended: bool = False,
    seed: int = 0,
    remove: Sequence[int] | None = None,
    eog: Sequence[str] = (),
    rate: float | None = None,
    detect: dict | None = None,
    **options,
) -> DataFrame:
    """One model per recording: keys, matrices, artifact components, and the map (projection, offset) that removes them.

    All recordings are fitted together: a step is one pass over their samples, of
    which sums by recording reach the driver. `percentage` below 100 takes that share
    of the samples, the first by a hash of `order`. Samples with missing values are
    left out. Artifact components are `remove`, or those that `identify` finds with
    the channels `eog` and the sample rate, by recording on its samples in order.
    """
    names, keys, order, eog = list(names), list(keys), list(order), [e for e in eog if e in df.columns]
    n = n_components or max(1, len(names) - 1)
    if n > len(names):
        raise ValueError("more components than channels")
    schema = T.StructType([df.schema[k] for k in keys] + T.StructType.fromDDL(_MODEL).fields)
    ship(df)
    rows = df.select(*dict.fromkeys([*keys, *(order if percentage < 100 else []), *names]))
    if percentage < 100:
        w = Window.partitionBy(*keys)
        rows = rows.withColumn("_of", F.count(F.lit(1)).over(w)).withColumn("_at", F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), *order), *order)))
        rows = rows.filter(F.col("_at") <= F.greatest(F.lit(n + 1), F.round(F.col("_of") * (percentage / 100))))
    models = _fit_all(rows.select(*dict.fromkeys([*keys, *names])), names, keys, n, extended, **options)
    found = {k: list(remove) for k in models} if remove is not None else _identify_all(df, models, names, keys, order, eog, rate, detect or {})
    out = []
    for k, (unmixing, mixing, mean, scale, variance) in models.items():
        proj = mixing[:, found[k]] @ unmixing[found[k]] if found[k] else np.zeros((len(names), len(names)))
        out.append((*k, mean.tolist(), float(scale), unmixing.tolist(), mixing.tolist(), variance.tolist(), found[k], proj.tolist(), (proj @ mean).tolist()))
    return _from_driver(df, out, schema)


def _from_driver(df: DataFrame, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small table whose size Spark knows."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    types = to_arrow_schema(schema)
    cols = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(types)]
    return df.sparkSession.createDataFrame(pa.Table.from_arrays(cols, schema=types), schema)


def _packed(rows: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """The complete samples of each recording in blocks of up to _ROWS: keys, and samples x channels as bytes."""
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("block", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        kinds, held, total = None, {}, 0

        def blocks(least):
            nonlocal total
            ready = []
            for key in [k for k, v in held.items() if sum(map(len, v)) >= least]:
                x = np.concatenate(held.pop(key))
                cut = len(x) if least == 1 else len(x) // _ROWS * _ROWS
                if cut < len(x):
                    held[key] = [x[cut:]]
                total -= cut * x.shape[1]
                ready += [(key, x[at : min(at + _ROWS, cut)].tobytes()) for at in range(0, cut, _ROWS)]
            for key, block in ready:
                yield pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in zip(key, kinds, strict=True)], pa.array([block], pa.binary())], [*keys, "block"])

        for batch in batches:
            kinds = [batch.column(k).type for k in keys]
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names])
            coded = [batch.column(k).dictionary_encode(null_encoding="encode") for k in keys]
            code = np.zeros(len(x), dtype=np.int64)
            for c in coded:
                code = code * len(c.dictionary) + c.indices.to_numpy(zero_copy_only=False)
            code[~np.isfinite(x).all(axis=1)] = -1
            by = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[by], prepend=-2))
            for lo, hi in zip(starts, [*starts[1:], len(x)], strict=True):
                if code[by[lo]] >= 0:
                    held.setdefault(tuple(c[int(by[lo])].as_py() for c in coded), []).append(x[by[lo:hi]])
                    total += (hi - lo) * x.shape[1]
            yield from blocks(_ROWS)
            if total > 1 << 23:
                yield from blocks(1)
        yield from blocks(1)

    return rows.mapInArrow(run, schema)


def _fit_all(rows: DataFrame, names: list[str], keys: list[str], n: int, extended: bool, steps: int = 512, tol: float = 1e-8) -> dict[tuple, tuple]:
    """(unmixing, mixing, mean, scale, variances) by recording."""
    sc, width = rows.sparkSession.sparkContext, len(names)
    packed = _packed(rows, names, keys).persist(StorageLevel.DISK_ONLY)
    schema = T.StructType([rows.schema[k] for k in keys] + T.StructType.fromDDL("part int, sums array<array<double>>").fields)

    def by_recording(what, merge):
        """what(samples, key) of each block, merged by recording: first in tasks, then in the order of tasks."""

        def run(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            kinds, got = None, {}
            for batch in batches:
                kinds = [batch.column(k).type for k in keys]
                for row in range(batch.num_rows):
                    key = tuple(batch.column(k)[row].as_py() for k in keys)
                    new = what(np.frombuffer(batch.column("block")[row].as_buffer(), dtype=float).reshape(-1, width), key)
                    if new is not None:
                        got[key] = merge([got[key], new]) if key in got else new
            for key, v in got.items():
                flat = pa.array([[np.ravel(a).tolist() for a in v]], pa.list_(pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays([*[pa.array([a], t) for a, t in zip(key, kinds, strict=True)], pa.array([TaskContext.get().partitionId()], pa.int32()), flat], [*keys, "part", "sums"])

        return run

    def add(parts):
        return [np.sum(v, axis=0) for v in zip(*parts, strict=True)]

    def collected(what, merge, shapes):
        parts = {}
        for r in sorted(packed.mapInArrow(by_recording(what, merge), schema).collect(), key=lambda r: r["part"]):
            parts.setdefault(tuple(r[k] for k in keys), []).append([np.reshape(v, s) for v, s in zip(r["sums"], shapes, strict=True)])
        return {k: merge(v) for k, v in parts.items()}

    try:
        spheres = {k: _sphere(v, n) for k, v in collected(lambda x, _: _moments(x), _merge, [(), (width,), (width, width)]).items()}
        climbs = {k: _Climb(n, extended, steps, tol) for k in spheres}
        while active := {k: c for k, c in climbs.items() if not c.done}:
            maps = {}
            for k, c in active.items():
                to = c.trial @ spheres[k][2] / spheres[k][1]
                maps[k] = (to, -to @ spheres[k][0], c.signs)
            shared = sc.broadcast(maps)
            for k, sums in collected(lambda x, key: _sums(x, *shared.value[key]) if key in shared.value else None, add, [(2,), (n, n), (n, n), (n,), (n,)]).items():  # noqa: B023
                climbs[k].tell(sums)
            shared.destroy()
    finally:
        packed.unpersist()
    out = {}
    for k, c in climbs.items():
        unmixing, mixing, variance = _model(c.w, spheres[k][2], spheres[k][3])
        out[k] = (unmixing, mixing, spheres[k][0], spheres[k][1], variance)
    return out


def _identify_all(df: DataFrame, models: dict[tuple, tuple], names: list[str], keys: list[str], order: list[str], eog: list[str], rate: float | None, detect: dict) -> dict[tuple, list[int]]:
    """The artifact components by recording."""
    shared = df.sparkSession.sparkContext.broadcast(models)
    schema = T.StructType([df.schema[k] for k in keys] + T.StructType.fromDDL("artifacts array<int>").fields)

    def run(table):
        import pyarrow as pa

        table = table.sort_by([(c, "ascending") for c in order])
        key = tuple(table.column(k)[0].as_py() for k in keys)
        found = []
        if key in shared.value:
            unmixing, mixing, mean, scale, variance = shared.value[key]
            column = lambda c: table.column(c).to_numpy(zero_copy_only=False).astype(float)
            x = np.column_stack([column(c) for c in names])
            whole = np.isfinite(x).all(axis=1)
            model = Ica(tuple(names), unmixing, mixing, mean, scale, variance)
            found = identify(model, (x[whole] - mean) / scale @ unmixing.T, {c: column(c)[whole] for c in eog}, rate, **detect)["all"]
        return pa.table({k: table.column(k).slice(0, 1) for k in keys} | {"artifacts": pa.array([found], pa.list_(pa.int32()))})

    got = df.select(*dict.fromkeys([*keys, *order, *names, *eog])).groupBy(*keys).applyInArrow(run, schema).collect()
    return {tuple(r[k] for k in keys): r["artifacts"] for r in got}


def remove_each(df: DataFrame, models: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Removes each recording's artifact components by its own model: one join (models are a row per recording) and one projection."""
    keys, names = list(keys), list(names)
    joined = df.join(F.broadcast(models.select(*keys, F.col("projection").alias("ica projection"), F.col("offset").alias("ica offset"))), keys, "left")
    clean = {}
    for i, n in enumerate(names):
        part = F.lit(0.0)
        for j, m in enumerate(names):
            part = part + F.col("ica projection")[i][j] * F.col(m)
        clean[n] = F.coalesce(F.col(n) - part + F.col("ica offset")[i], F.col(n))
    return joined.select(*[clean[c].alias(c) if c in clean else F.col(c) for c in df.columns])


def run_ica(df: DataFrame, names: Sequence[str], n_components: int | None = None, percentage: float = 100.0, extended: bool = False, keys: Sequence[str] = ("sample",), seed: int = 0, **options) -> Ica:
    """The model of one recording, fitted on its distinct samples; only sums and matrices reach the driver."""
    rows = df.dropDuplicates(list(keys)).select(F.lit(0).alias("recording"), *dict.fromkeys([*keys, *names]))
    r = fit_each(rows, names, ["recording"], keys, n_components, percentage, extended, seed, remove=(), **options).first()
    return Ica(tuple(names), np.array(r["unmixing"]), np.array(r["mixing"]), np.array(r["mean"]), r["scale"], np.array(r["variance"]))


def activations(df: DataFrame, ica: Ica, keep: Sequence[str]) -> DataFrame:
    """keep, then one column per component: W (x - mean) / scale."""
    out = []
    for label, row in zip(ica.labels, ica.unmixing, strict=True):
        total = F.lit(float(-(row @ ica.mean) / ica.scale))
        for n, w in zip(ica.names, row, strict=True):
            total = total + F.col(n) * F.lit(float(w / ica.scale))
        out.append(total.alias(label))
    return df.select(*keep, *out)


def remove_components(df: DataFrame, ica: Ica, components: Sequence[int]) -> tuple[DataFrame, Ica]:
    """x' = x - M_s W_s (x - mean) for 0-based components; a linear map, so one projection."""
    s = list(components)
    proj = ica.mixing[:, s] @ ica.unmixing[s]
    m = np.eye(len(ica.names)) - proj
    return linear_map(df, ica.names, m, proj @ ica.mean), replace(ica, removed=tuple(sorted(set(ica.removed) | set(s))))


def restore_components(df: DataFrame, original: DataFrame, keys: Sequence[str], ica: Ica, components: Sequence[int]) -> tuple[DataFrame, Ica]:
    """Adds the components' activity, taken from the original samples, back."""
    s = list(components)
    proj = ica.mixing[:, s] @ ica.unmixing[s]
    part = linear_map(original.select(*keys, *ica.names), ica.names, proj, -proj @ ica.mean)
    part = part.select(*keys, *[F.col(n).alias(f"_add_{n}") for n in ica.names])
    out = df.join(part, list(keys)).withColumns({n: F.col(n) + F.col(f"_add_{n}") for n in ica.names}).drop(*[f"_add_{n}" for n in ica.names])
    return out, replace(ica, removed=tuple(sorted(set(ica.removed) - set(s))))


def _z(values: np.ndarray) -> np.ndarray:
    sd = values.std(ddof=1) if len(values) > 1 else 0.0
    return (values - values.mean()) / sd if sd else np.zeros(len(values))


def _standing_out(r: np.ndarray, z_threshold: float, min_correlation: float) -> list[int]:
    z = _z(r)
    return [i for i in range(len(r)) if r[i] > min_correlation and (z[i] > z_threshold or r[i] > 0.9)]


def eog_components(act: DataFrame, ica: Ica, eog: Sequence[str] = ("vEOG", "hEOG"), z_threshold: float = 3.0, min_correlation: float = 0.5) -> dict[str, list[int]]:
    """Components whose |r| with an EOG channel is high and stands out. `act` holds activations and EOG."""
    row = act.agg(*[F.corr(label, e).alias(f"{label}|{e}") for label in ica.labels for e in eog]).first()
    return {e: _standing_out(np.array([abs(row[f"{label}|{e}"] or 0.0) for label in ica.labels]), z_threshold, min_correlation) for e in eog}


def identify(model: Ica, act: np.ndarray, eog: dict[str, np.ndarray], rate: float | None = None, eog_z: float = 3.0, eog_r: float = 0.5, kurtosis_z: float = 3.0, line: float = 50.0, line_z: float = 3.0) -> dict[str, list[int]]:
    """All artifact components of a recording in one call: by EOG channel, then ecg, line_noise (both need the rate), kurtosis, and all of them."""
    out = {}
    for name, x in eog.items():
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.array([abs(np.corrcoef(a, x)[0, 1]) for a in act.T])
        out[name] = _standing_out(np.nan_to_num(r), eog_z, eog_r)
    if rate:
        out["ecg"] = ecg_components(act, rate)
        out["line_noise"] = line_noise_components(act, rate, line, z_threshold=line_z)
    out["spatial_kurtosis"] = spatial_kurtosis_components(model, kurtosis_z)
    return out | {"all": combine(*out.values())}


def find_peaks(x: np.ndarray, prominence: float = 2.0, window: int = 1) -> np.ndarray:
    """Strict local extrema beyond mean +- prominence standard deviations."""
    mean, sd = x.mean(), x.std(ddof=1)
    if len(x) <= 2 * window:
        return np.zeros(0, dtype=int)
    inner = x[window : len(x) - window]
    near = np.stack([x[window + d : len(x) - window + d] for d in range(-window, window + 1) if d])
    high = (inner > near.max(axis=0)) & (inner > mean + prominence * sd)
    low = (inner < near.min(axis=0)) & (inner < mean - prominence * sd)
    return np.flatnonzero(high | low) + window


def beat_metrics(peaks: np.ndarray, rate: float, lo: float, hi: float) -> dict[str, float]:
    gaps = np.diff(peaks) / rate
    good = gaps[(gaps >= lo) & (gaps <= hi)]
    return {"n": len(good), "mean": float(good.mean()) if len(good) else float("nan"), "std": float(good.std(ddof=1)) if len(good) > 1 else float("nan"), "ratio": len(good) / len(gaps) if len(gaps) else 0.0}


def ecg_components(act: np.ndarray, rate: float, min_bpm: float = 40, max_bpm: float = 120, prominence: float = 4, min_peaks: int = 100, max_std: float = 0.2, min_ratio: float = 0.5) -> list[int]:
    """Components (columns of act) with regular heart-rate peaks."""
    out = []
    for i in range(act.shape[1]):
        x = _z(act[:, i])
        for sign in (1, -1):
            peaks = find_peaks(sign * x, prominence)
            peaks = peaks[(sign * x)[peaks] > 0]
            m = beat_metrics(peaks, rate, 60 / max_bpm, 60 / min_bpm)
            if m["n"] >= min_peaks and m["std"] <= max_std and m["ratio"] >= min_ratio:
                out.append(i)
                break
    return out


def spatial_kurtosis_components(ica: Ica, z_threshold: float = 3.0) -> list[int]:
    m = ica.mixing - ica.mixing.mean(axis=0)
    k = (m**4).mean(axis=0) / np.maximum((m**2).mean(axis=0) ** 2, 1e-300) - 3
    return [int(i) for i in np.flatnonzero(_z(k) > z_threshold)]


def line_noise_components(act: np.ndarray, rate: float, line: float = 50.0, bandwidth: float = 1.0, z_threshold: float = 3.0, min_harmonic: float = 0.5) -> list[int]:
    """Components whose power at the line frequency stands out, with a harmonic of some strength."""
    f, p = num.welch(act, rate, min(len(act), int(4 * rate)))
    band = lambda c: p[(f >= c - bandwidth) & (f <= c + bandwidth)].mean(axis=0) if ((f >= c - bandwidth) & (f <= c + bandwidth)).any() else np.zeros(p.shape[1])
    around = p[(f > line - 5 * bandwidth) & (f < line + 5 * bandwidth) & (np.abs(f - line) > bandwidth)].mean(axis=0)
    ratio = band(line) / np.maximum(around, 1e-300)
    harmonic = band(2 * line) / np.maximum(band(line), 1e-300)
    reachable = 2 * line < rate / 2
    return [int(i) for i in np.flatnonzero((_z(ratio) > z_threshold) & (~np.full(len(ratio), reachable) | (harmonic >= min_harmonic)))]


def combine(*classes: Sequence[int]) -> list[int]:
    return sorted({int(i) for c in classes for i in c})
