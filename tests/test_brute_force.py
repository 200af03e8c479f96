"""Queries that have no SQL twin, over their whole tables, against plain computations that share no code with them."""

import numpy as np
import pytest
from oracle import connect

from samplewright.functions import numeric as num
from samplewright.operators import stats
from samplewright.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.fixture(scope="module")
def vectors(con):
    """vec_id -> (label, samples)"""
    return {i: (c, np.asarray(v, dtype=float)) for i, c, v in con.sql("SELECT vec_id, label, embedding FROM embeddings").fetchall()}


@pytest.fixture(scope="module")
def erp(vectors):
    """participants x times, by condition"""
    sums = {}
    for i, (c, v) in vectors.items():
        sums.setdefault((c, i % 10), []).append(v)
    return {c: {p: np.mean(x, axis=0) for (k, p), x in sorted(sums.items()) if k == c} for c in {k for k, _ in sums}}


def t_tail(t, df, steps=200_001):
    """P(T > t) for t >= 0, by Simpson's rule over the density in u = atan(x / sqrt(df))."""
    u = np.linspace(np.arctan(t / np.sqrt(df)), np.pi / 2, steps)
    f = np.cos(u) ** (df - 1)
    simpson = lambda y, h: h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
    whole = np.linspace(-np.pi / 2, np.pi / 2, steps)
    return simpson(f, u[1] - u[0]) / simpson(np.cos(whole) ** (df - 1), whole[1] - whole[0])


def test_analytic_test(spark, sf_dir, erp):
    both = sorted(set(erp[1]) & set(erp[2]))
    d = np.array([erp[1][p] - erp[2][p] for p in both])
    t = d.mean(axis=0) / (d.std(axis=0, ddof=1) / np.sqrt(len(d)))
    got = catalog.QUERIES["analytic_test"](spark, sf_dir).toPandas().sort_values("time")
    p = np.array([2 * t_tail(abs(x), len(d) - 1) for x in t])
    assert len(got) == 64 and np.abs(got.t - t).max() < 2e-6 and np.abs(got.p - p).max() < 2e-6
    assert (got.significant.to_numpy() == (p <= 0.05 / 64)).all()


def test_decoding_against_chance(spark, sf_dir, erp):
    a = np.array([erp[1][p] for p in sorted(erp[1])])
    t = a.mean(axis=0) / (a.std(axis=0, ddof=1) / np.sqrt(len(a)))
    got = catalog.QUERIES["decoding_against_chance"](spark, sf_dir).toPandas().sort_values("time")
    p = np.array([t_tail(x, len(a) - 1) if x >= 0 else 1 - t_tail(-x, len(a) - 1) for x in t])
    assert np.abs(got.t - t).max() < 2e-6 and np.abs(got.p - p).max() < 2e-6 and (got.significant.to_numpy() == (p <= 0.05)).all()


def test_permutation_test(spark, sf_dir, erp):
    """Runs of one sign beyond the threshold, and how often 200 sign flips give a larger sum."""
    both = sorted(set(erp[1]) & set(erp[2]))
    a, b = (np.array([erp[c][p] for p in both])[:, None, :] for c in (1, 2))
    high = num.t_quantile(0.95, len(both) - 1)
    assert abs(t_tail(high, len(both) - 1) - 0.05) < 1e-8

    def sums(d):
        t = d.mean(axis=0) / (d.std(axis=0, ddof=1) / np.sqrt(len(d)))
        out, at = [], 0
        while at < len(t):
            end = at + 1
            sign = (t[at] > high) * 1 - (t[at] < -high) * 1
            while sign and end < len(t) and ((t[end] > high) * 1 - (t[end] < -high) * 1) == sign:
                end += 1
            if sign:
                out.append((t[at:end].sum(), at, end))
            at = end
        return out

    flips = [(lambda x, y: (x - y)[:, 0])(*stats.shuffled(a, b, "paired", 0, p)) for p in range(200)]
    null = [[s for s, *_ in sums(d)] for d in flips]
    most, least = (np.array([f([*x, 0.0]) for x in null]) for f in (max, min))
    want = {(at / 64, (end - 1) / 64): (s, (1 + ((most >= s).sum() if s > 0 else (least <= s).sum())) / 201) for s, at, end in sums((a - b)[:, 0])}
    got = {(min(r["times"]), max(r["times"])): (r["stat"], r["p"]) for r in catalog.QUERIES["permutation_test"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=2e-6) for k in want)


def by_samples(x, b, a):
    """A difference equation, sample by sample, that starts as if x[0] had lasted for ever."""
    past, out = [x[0]] * len(b), []
    level = x[0] * sum(b) / sum(a)
    ys = [level] * len(a)
    for v in x:
        past = [v, *past[:-1]]
        y = (sum(p * q for p, q in zip(b, past, strict=True)) - sum(p * q for p, q in zip(a[1:], ys, strict=False))) / a[0]
        ys = [y, *ys[:-1]]
        out.append(y)
    return np.array(out)


@pytest.mark.parametrize(("name", "kind", "cutoff", "order"), [("lowpass", "low", 8.0, 3), ("highpass", "high", 1.0, 1)])
def test_filters(spark, sf_dir, vectors, name, kind, cutoff, order):
    """Butterworth by its analogue poles and the bilinear transform, as one polynomial, forward and backward over an odd extension."""
    warp = 2 * 64 * np.tan(np.pi * cutoff / 64)
    poles = warp * np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    if kind == "high":
        poles = warp**2 / poles
    z = (128 + poles) / (128 - poles)
    a = np.real(np.poly(z))
    b = np.real(np.poly(np.full(order, -1.0 if kind == "low" else 1.0)))
    at = 1.0 if kind == "low" else -1.0
    b = b * np.polyval(a, at) / np.polyval(b, at)
    pad = 3 * (2 * ((order + 1) // 2) + 1)
    got = catalog.QUERIES[name](spark, sf_dir).toPandas().sort_values(["epoch", "pos"])
    for i, part in got.groupby("epoch"):
        x = vectors[i][1]
        wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
        y = by_samples(by_samples(wide, b, a)[::-1], b, a)[::-1][pad : pad + 64]
        assert np.abs(part.value.to_numpy() - y).max() < 2e-6
    assert set(got.epoch) == set(vectors)


def test_multitaper(spark, sf_dir, vectors):
    """Tapers as eigenvectors of the sinc kernel, windows written out, averages over trials."""
    got = catalog.QUERIES["multitaper"](spark, sf_dir).toPandas().set_index(["condition", "freq", "time"])
    count = 0
    for f in (8.0, 16.0):
        n = max(3, round(4 / f * 64))
        nw = max(0.5, 0.4 * f * n / 64 / 2)
        k = np.arange(n)
        with np.errstate(invalid="ignore"):
            kernel = np.where(k[:, None] == k, 2 * nw / n, np.sin(2 * np.pi * nw / n * (k[:, None] - k)) / (np.pi * np.where(k[:, None] == k, 1, k[:, None] - k)))
        tapers = np.linalg.eigh(kernel)[1][:, ::-1][:, : max(1, int(2 * nw - 1))].T
        wave = np.exp(-2j * np.pi * f * (k - n // 2) / 64)
        for c in {c for c, _ in vectors.values()}:
            trials = np.array([v for label, v in vectors.values() if label == c])
            for centre in range(0, 64, 3):
                power = got.power[c, f, centre / 64]
                if centre < n // 2 or centre > 63 - n // 2:
                    assert np.isnan(power)
                    continue
                part = trials[:, centre - n // 2 : centre - n // 2 + n]
                z = np.array([(part * (t * wave)).sum(axis=1) for t in tapers]) * np.sqrt(2 / n)
                assert abs(power - (np.abs(z) ** 2).mean()) < 2e-6
                count += 1
    assert count > 100


def test_rdm_compare_models(spark, sf_dir, vectors):
    labels = sorted({c for c, _ in vectors.values()})
    means = {c: np.mean([v for k, v in vectors.values() if k == c], axis=0) for c in labels}
    pairs = [(i, j) for i in labels for j in labels if i < j]
    rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    d = rank(np.array([np.linalg.norm(means[i] - means[j]) for i, j in pairs]))
    model = dict(zip(pairs, rank(np.array([abs(i - j) for i, j in pairs], dtype=float)), strict=True))
    r = np.corrcoef(d, [model[x] for x in pairs])[0, 1]
    rng, hits = np.random.default_rng(0), 0
    for _ in range(200):
        to = dict(zip(labels, np.array(labels)[rng.permutation(len(labels))], strict=True))
        hits += abs(np.corrcoef(d, [model[tuple(sorted((to[i], to[j])))] for i, j in pairs])[0, 1]) >= abs(r)
    got = catalog.QUERIES["rdm_compare_models"](spark, sf_dir).first()
    assert abs(got["r"] - r) < 2e-6 and abs(got["p"] - hits / 200) < 0.011  # equal correlations may round to either side
