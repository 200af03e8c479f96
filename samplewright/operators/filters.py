"""Digital filters and spectra, one Arrow group per series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as num
from .series import map_series, reduce_series


def _filter(df, kind, cutoff, rate, keys, names, order, method, transition, func, by):
    if method == "iir":
        sos = num.butterworth(kind, cutoff, rate, order)
        kernel = (lambda x: num.filtfilt(sos, x)) if func == "filtfilt" else (lambda x: num.sos_filter(sos, x))
    elif method == "fir":
        h = num.fir(kind, cutoff, rate, transition)
        kernel = lambda x: num.fir_filter(h, x, twice=func == "filtfilt")
    else:
        raise ValueError("filter_method is iir or fir")
    return map_series(df, keys, by, names, kernel)


def lowpass(df: DataFrame, cutoff: float, rate: float, keys: Sequence[str], names: Sequence[str], order: int = 3, method: str = "iir", transition: float = 0.1, func: str = "filtfilt", by: str = "sample") -> DataFrame:
    return _filter(df, "lowpass", cutoff, rate, keys, names, order, method, transition, func, by)


def highpass(df: DataFrame, cutoff: float, rate: float, keys: Sequence[str], names: Sequence[str], order: int = 1, method: str = "iir", transition: float = 0.25, func: str = "filtfilt", by: str = "sample") -> DataFrame:
    return _filter(df, "highpass", cutoff, rate, keys, names, order, method, transition, func, by)


def characteristics(kind: str, cutoff: float, rate: float, order: int = 3, method: str = "iir", transition: float = 0.1, points: int = 1000) -> dict[str, float]:
    """-3 and -6 dB points, pass-band ripple, stop-band attenuation, group delay at the pass band."""
    sos = num.butterworth(kind, cutoff, rate, order) if method == "iir" else None
    h = num.fir(kind, cutoff, rate, transition) if method == "fir" else None
    f, r = num.frequency_response(sos, h, rate, points)
    db = 20 * np.log10(np.maximum(np.abs(r), 1e-12))
    cross = lambda level: float(f[np.argmin(np.abs(db - level))])
    passing = f <= cutoff * 0.8 if kind == "lowpass" else f >= cutoff * 1.2
    stopping = f >= cutoff * 1.5 if kind == "lowpass" else f <= cutoff * 0.5
    phase = np.unwrap(np.angle(r))
    delay = -np.gradient(phase, 2 * np.pi * f) * rate
    return {
        "db3": cross(-3.0),
        "db6": cross(-6.0),
        "ripple_db": float(np.ptp(db[passing])) if passing.any() else float("nan"),
        "attenuation_db": float(-db[stopping].max()) if stopping.any() else float("nan"),
        "group_delay_samples": float(np.median(delay[passing])) if passing.any() else float("nan"),
    }


def spectrum(df: DataFrame, rate: float, keys: Sequence[str], names: Sequence[str], by: str = "sample", window_size: int = 256, overlap: float = 0.5, max_freq: float | None = None) -> DataFrame:
    """Welch power density: keys, channel, freq, power."""
    names = list(names)

    def kernel(_, x):
        f, p = num.welch(x, rate, window_size, overlap)
        keep = np.full(len(f), True) if max_freq is None else f <= max_freq
        n = int(keep.sum())
        return {"channel": np.repeat(names, n), "freq": np.tile(f[keep], len(names)), "power": p[keep].T.ravel()}

    return reduce_series(df, keys, by, names, kernel, "channel string, freq double, power double")


def decibels(df: DataFrame, column: str = "power", out: str = "db") -> DataFrame:
    return df.withColumn(out, 10 * F.log10(F.greatest(F.col(column), F.lit(1e-10))))
