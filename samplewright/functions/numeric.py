"""Numerical kernels on arrays: distributions, filters, windows, tapers. numpy only."""

from __future__ import annotations

from functools import lru_cache
from math import lgamma

import numpy as np


def betainc(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    x = np.asarray(x, dtype=float)
    swap = x > (a + 1) / (a + b + 2)
    p = np.where(swap, b, a)
    q = np.where(swap, a, b)
    z = np.clip(np.where(swap, 1 - x, x), 0, 1)
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + p * np.log(np.maximum(z, tiny)) + q * np.log(np.maximum(1 - z, tiny)))
    out = np.where(z <= 0, 0.0, front * h / p)
    return np.where(swap, 1 - out, out)


def t_cdf(t: np.ndarray, df: float) -> np.ndarray:
    t = np.asarray(t, dtype=float)
    with np.errstate(invalid="ignore", over="ignore"):
        half = betainc(df / 2, 0.5, np.where(np.isinf(t), 0.0, df / (df + np.where(np.isnan(t), 0.0, t) ** 2))) / 2
    return np.where(np.isnan(t), np.nan, np.where(t > 0, 1 - half, half))


def t_p(t: np.ndarray, df: float, tail: str = "both") -> np.ndarray:
    t = np.asarray(t, dtype=float)
    if tail == "both":
        return np.minimum(1.0, 2 * t_cdf(-np.abs(t), df))
    return t_cdf(-t if tail in ("right", "positive") else t, df)


def t_quantile(p: float, df: float) -> float:
    lo, hi = -1e6, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if float(t_cdf(np.array(mid), df)) < p else (lo, mid)
    return (lo + hi) / 2


def hann(n: int) -> np.ndarray:
    return np.ones(1) if n == 1 else 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))


def hamming(n: int) -> np.ndarray:
    return np.ones(1) if n == 1 else 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1))


def butterworth(kind: str, cutoff: float, rate: float, order: int) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) of a digital low or high pass, by the bilinear transform."""
    if not 0 < cutoff < rate / 2:
        raise ValueError("the cut-off must lie between 0 and half the sample rate")
    warp = np.tan(np.pi * cutoff / rate)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    poles = warp * poles if kind == "lowpass" else warp / poles
    z = (1 + poles) / (1 - poles)
    zero = -1.0 if kind == "lowpass" else 1.0
    at = 1.0 if kind == "lowpass" else -1.0
    sections, real = [], [p for p in z if abs(p.imag) < 1e-12]
    for p in z[z.imag > 1e-12]:
        a = np.array([1, -2 * p.real, abs(p) ** 2])
        b = np.array([1, -2 * zero, 1.0])
        sections.append((b, a))
    for p in real:
        sections.append((np.array([1, -zero, 0.0]), np.array([1, -p.real, 0.0])))
    out = []
    for b, a in sections:
        gain = np.polyval(a, at) / np.polyval(b, at)
        out.append(np.concatenate([b * gain, a]))
    return np.array(out)


def _steps(sos: np.ndarray, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sections over x (time x series), sample by sample, from states z (2 per section x series): (output, states)."""
    y, z = np.array(x, dtype=float), np.array(z, dtype=float)
    for s, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        z1, z2 = z[2 * s], z[2 * s + 1]
        for i in range(len(y)):
            v = y[i].copy()
            y[i] = b0 * v + z1
            z1, z2 = b1 * v - a1 * y[i] + z2, b2 * v - a2 * y[i]
        z[2 * s], z[2 * s + 1] = z1, z2
    return y, z


@lru_cache(maxsize=32)
def _block_maps(sections: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """What n samples do, as matrices: outputs and end states from (samples, states)."""
    sos = np.frombuffer(sections).reshape(-1, 6)
    states = 2 * len(sos)
    unit = np.eye(n + states)
    return _steps(sos, unit[:n], unit[n:])


def sos_filter(sos: np.ndarray, x: np.ndarray, steady: bool = False, block: int = 256) -> np.ndarray:
    """Runs sections along the first axis of x (time, ...); `steady` starts as if x[0] had lasted for ever.

    A filter is linear, so a block of samples is one matrix product; states carry over from block to block.
    """
    shape = np.shape(x)
    x = np.asarray(x, dtype=float).reshape(shape[0], -1)
    z, level = np.zeros((2 * len(sos), x.shape[1])), x[0] if len(x) else np.zeros(x.shape[1])
    for s, (b0, b1, b2, _, a1, a2) in enumerate(sos if steady else ()):
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        z[2 * s + 1] = (b2 - a2 * gain) * level
        z[2 * s] = (b1 - a1 * gain) * level + z[2 * s + 1]
        level = gain * level
    out = np.empty_like(x)
    for at in range(0, len(x), block):
        part = np.concatenate([x[at : at + block], z])
        to_out, to_state = _block_maps(np.ascontiguousarray(sos, dtype=float).tobytes(), len(part) - len(z))
        out[at : at + block], z = to_out @ part, to_state @ part
    return out.reshape(shape)


def filtfilt(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase: forward and backward over an odd extension at both ends."""
    x = np.asarray(x, dtype=float)
    n = min(len(x) - 1, 3 * (2 * len(sos) + 1))
    if n <= 0:
        return x.copy()
    ext = np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]])
    y = sos_filter(sos, ext, steady=True)
    y = sos_filter(sos, y[::-1], steady=True)[::-1]
    return y[n : n + len(x)]


def fir(kind: str, cutoff: float, rate: float, transition: float) -> np.ndarray:
    """Hamming-windowed sinc; its length follows from the transition width (relative to the cut-off)."""
    width = max(transition * cutoff, 1e-9)
    n = max(int(np.ceil(4 * rate / width)), 101)
    n = (1 << (n - 1).bit_length()) + 1
    k = np.arange(n) - n // 2
    h = 2 * cutoff / rate * np.sinc(2 * cutoff / rate * k) * hamming(n)
    h /= h.sum()
    if kind == "highpass":
        h = -h
        h[n // 2] += 1
    return h


def fir_filter(h: np.ndarray, x: np.ndarray, twice: bool = True) -> np.ndarray:
    """Convolution along the first axis without delay; `twice` squares the response, as forward-backward does."""
    n, m = len(x), len(h)
    size = 1 << (n + 2 * m).bit_length()
    pad = [(m, size - n - m)] + [(0, 0)] * (x.ndim - 1)
    response = np.fft.rfft(np.roll(np.pad(h, (0, size - m)), -(m // 2)))
    response = (np.abs(response) ** 2 if twice else response).reshape(-1, *[1] * (x.ndim - 1))
    return np.fft.irfft(np.fft.rfft(np.pad(x, pad), axis=0) * response, size, axis=0)[m : m + n]


def frequency_response(sos: np.ndarray | None, h: np.ndarray | None, rate: float, points: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and complex response of sections or taps."""
    f = np.linspace(0, rate / 2, points)
    z = np.exp(-2j * np.pi * f / rate)
    if h is not None:
        return f, np.polyval(h[::-1], z)
    out = np.ones(points, dtype=complex)
    for b0, b1, b2, _, a1, a2 in sos:
        out *= (b0 + b1 * z + b2 * z**2) / (1 + a1 * z + a2 * z**2)
    return f, out


def dpss(n: int, nw: float, k: int) -> np.ndarray:
    """The first k discrete prolate spheroidal tapers, from the tridiagonal eigenproblem."""
    i = np.arange(n)
    main = ((n - 1 - 2 * i) / 2.0) ** 2 * np.cos(2 * np.pi * nw / n)
    off = i[1:] * (n - i[1:]) / 2.0
    _, v = np.linalg.eigh(np.diag(main) + np.diag(off, 1) + np.diag(off, -1))
    v = v[:, ::-1][:, :k].T
    for j, t in enumerate(v):
        first = t.sum() if j % 2 == 0 else t[np.argmax(np.abs(t) > 1e-9)]
        if first < 0:
            v[j] = -t
    return v


def welch(x: np.ndarray, rate: float, size: int = 256, overlap: float = 0.5, window=hann) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density along the first axis."""
    size = min(size, len(x))
    step = max(1, int(size * (1 - overlap)))
    w = window(size)
    starts = range(0, len(x) - size + 1, step)
    total = 0.0
    for s in starts:
        total = total + np.abs(np.fft.rfft(x[s : s + size] * w.reshape(-1, *[1] * (x.ndim - 1)), axis=0)) ** 2
    p = total / (len(starts) * rate * (w**2).sum())
    p[1 : -1 if size % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(size, 1 / rate), p


def ranks(x: np.ndarray) -> np.ndarray:
    """Ranks with ties averaged."""
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(counts)
    return (last - (counts - 1) / 2)[inverse]


