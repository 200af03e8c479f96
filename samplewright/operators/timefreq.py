"""Time-frequency power: Morlet wavelets, short-time Fourier, multitaper; baselines.

Each trial is transformed in one Arrow group; averages over trials are ordinary
aggregates of power and of the complex value's parts, so they combine map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as num
from .series import reduce_series

_OUT = "channel string, time double, freq double, re double, im double, power double"
BASELINES = ("absolute", "relative", "relchange", "normchange", "vssum", "db", "zscore", "percent")


def _long(names, times, freqs, z, power):
    """z and power are time x freq x channel; rows are time-major, frequency inner."""
    nt, nf = len(times), len(freqs)
    return {
        "channel": np.repeat(names, nt * nf),
        "time": np.tile(np.repeat(times, nf), len(names)),
        "freq": np.tile(freqs, nt * len(names)),
        "re": np.moveaxis(z.real, 2, 0).ravel(),
        "im": np.moveaxis(z.imag, 2, 0).ravel(),
        "power": np.moveaxis(power, 2, 0).ravel(),
    }


def _averaged(trials: DataFrame, keys: Sequence[str], epoch: str, return_trials: bool) -> DataFrame:
    if return_trials:
        return trials.withColumn("phase", F.atan2("im", "re")).drop("re", "im")
    group = [k for k in keys if k != epoch]
    out = trials.groupBy(*group, "channel", "time", "freq").agg(F.avg("power").alias("power"), F.atan2(F.avg("im"), F.avg("re")).alias("phase"), F.count(F.lit(1)).alias("n_epochs"))
    return out


def _pad(x: np.ndarray, how: str | None) -> tuple[np.ndarray, int]:
    if how is None:
        return x, 0
    n = len(x) - 1
    before = x[n:0:-1] if how in ("pre", "both") else x[:0]
    after = x[-2::-1] if how in ("post", "both") else x[:0]
    return np.concatenate([before, x, after]), len(before)


def _edges(z, power, half, n):
    """NaN where half a window reaches outside the trial; half: samples per frequency."""
    i = np.arange(n)[:, None]
    out = (i < half[None, :]) | (i > n - 1 - half[None, :])
    z[out], power[out] = np.nan, np.nan


def morlet(df: DataFrame, freqs: Sequence[float], rate: float, names: Sequence[str], keys: Sequence[str] = ("condition", "epoch"), cycles: float | tuple[float, float] = 7, time: str = "time", epoch: str = "epoch", pad: str | None = None, return_trials: bool = False, filter_edges: bool = True) -> DataFrame:
    """Power and phase by convolution with Morlet wavelets; `cycles` may grow from low to high frequency."""
    f = np.asarray(freqs, float)
    c = np.full(len(f), float(cycles)) if np.isscalar(cycles) else np.geomspace(cycles[0], cycles[1], len(f))
    sigma, names = c / (2 * np.pi * f), list(names)

    def kernel(t, x):
        y, at = _pad(x, pad)
        n = len(y)
        longest = int(np.ceil(4 * sigma.max() * rate))
        size = 1 << int(n + 2 * longest + 1).bit_length()
        fy = np.fft.fft(y, size, axis=0)
        z = np.empty((len(t), len(f), x.shape[1]), dtype=complex)
        for k, (fr, s) in enumerate(zip(f, sigma, strict=True)):
            h = int(np.ceil(4 * s * rate))
            w = np.arange(-h, h + 1) / rate
            wave = np.exp(2j * np.pi * fr * w - w**2 / (2 * s**2))
            wave *= 2 / np.abs(np.exp(-(w**2) / (2 * s**2))).sum()  # a unit sine has unit amplitude
            z[:, k] = np.fft.ifft(fy * np.fft.fft(wave, size)[:, None], axis=0)[h + at : h + at + len(t)]
        power = np.abs(z) ** 2
        if filter_edges and pad is None:
            _edges(z, power, np.ceil(c / f / 2 * rate), len(t))
        return _long(names, t, f, z, power)

    return _averaged(reduce_series(df, keys, time, names, kernel, _OUT), keys, epoch, return_trials)


def _windowed(tapers_of, f, rate, names, step, widths, pad, filter_edges):
    def kernel(t, x):
        y, at = _pad(x, pad)
        centres = np.arange(0, len(t), max(1, round(step * rate)))
        z = np.zeros((len(centres), len(f), x.shape[1]), dtype=complex)
        power = np.zeros(z.shape)
        for k, fr in enumerate(f):
            n = int(widths[k])
            tapers = tapers_of(k, n)
            wave = np.exp(-2j * np.pi * fr * (np.arange(n) - n // 2) / rate)
            padded = np.pad(y, [(n, n), (0, 0)])
            for i, cpt in enumerate(centres):
                part = padded[cpt + at + n - n // 2 :][:n]
                got = np.array([(part * (tp * wave)[:, None]).sum(axis=0) for tp in tapers]) * np.sqrt(2 / n)
                z[i, k] = got.mean(axis=0)
                power[i, k] = (np.abs(got) ** 2).mean(axis=0)
        if filter_edges and pad is None:
            half = np.asarray(widths) // 2
            out = (centres[:, None] < half[None, :]) | (centres[:, None] > len(t) - 1 - half[None, :])
            z[out], power[out] = np.nan, np.nan
        return _long(names, t[centres], f, z, power)

    return kernel


def stft(df: DataFrame, freqs: Sequence[float], rate: float, names: Sequence[str], keys: Sequence[str] = ("condition", "epoch"), window_length: float | None = None, cycles: float | None = None, time_steps: float = 0.05, time: str = "time", epoch: str = "epoch", pad: str | None = None, return_trials: bool = False, filter_edges: bool = True) -> DataFrame:
    """Hann windows of fixed length, or of a number of cycles of each frequency."""
    if (window_length is None) == (cycles is None):
        raise ValueError("give window_length or cycles")
    f, names = np.asarray(freqs, float), list(names)
    widths = np.full(len(f), round(window_length * rate)) if cycles is None else np.round(cycles / f * rate).astype(int)

    def tapers(_, n):
        w = num.hann(n)
        return [w / np.linalg.norm(w)]

    return _averaged(reduce_series(df, keys, time, names, _windowed(tapers, f, rate, names, time_steps, widths, pad, filter_edges), _OUT), keys, epoch, return_trials)


def multitaper(df: DataFrame, freqs: Sequence[float], rate: float, names: Sequence[str], cycles: float, keys: Sequence[str] = ("condition", "epoch"), frequency_smoothing: float | None = None, time_steps: float = 0.05, time: str = "time", epoch: str = "epoch", pad: str | None = None, return_trials: bool = False, filter_edges: bool = True) -> DataFrame:
    """DPSS tapers over `cycles` cycles; the smoothing is a share of each frequency (0.4 by default)."""
    f, names = np.asarray(freqs, float), list(names)
    widths = np.maximum(3, np.round(cycles / f * rate)).astype(int)
    cache: dict = {}

    def tapers(k, n):
        smooth = 0.4 * f[k] if frequency_smoothing is None else frequency_smoothing
        nw = max(0.5, smooth * n / rate / 2)
        if (k, n) not in cache:
            cache[k, n] = num.dpss(n, nw, max(1, int(2 * nw - 1)))
        return cache[k, n]

    return _averaged(reduce_series(df, keys, time, names, _windowed(tapers, f, rate, names, time_steps, widths, pad, filter_edges), _OUT), keys, epoch, return_trials)


def baseline(df: DataFrame, window: tuple[float, float], method: str = "db", keys: Sequence[str] = ("condition", "channel", "freq"), power: str = "power") -> DataFrame:
    """Power against its mean over a time window, per channel and frequency; NaN are skipped. Not to be applied twice."""
    if method not in BASELINES:
        raise ValueError(f"unknown method {method}")
    w = Window.partitionBy(*keys)
    inside = F.when(F.col("time").between(*window) & ~F.isnan(power), F.col(power))
    mean, sd = F.avg(inside).over(w), F.stddev_pop(inside).over(w)
    p, m = F.col(power), F.when(F.abs(mean) < 1e-30, F.lit(1e-30)).otherwise(mean)
    total = F.when(F.abs(p + mean) < 1e-30, F.lit(1e-30)).otherwise(p + mean)
    out = {
        "absolute": p - mean,
        "relative": p / m,
        "relchange": (p - mean) / m,
        "normchange": (p - mean) / total,
        "vssum": (p - mean) / total,
        "db": 10 * F.log10(F.greatest(p, F.lit(1e-30)) / F.greatest(mean, F.lit(1e-30))),
        "zscore": (p - mean) / F.when(sd < 1e-30, F.lit(1e-30)).otherwise(sd),
        "percent": 100 * (p - mean) / m,
    }[method]
    return df.withColumn(power, out)
