"""Queries over the whole of their tables, against brute force."""

import numpy as np
import pytest
from oracle import connect
from pyspark.sql import functions as F

from samplewright.operators import decode, ica
from samplewright.plans import catalog
from samplewright.sources import views


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_resample_times_reads_every_trial(spark, sf_dir, con):
    vectors = {i: np.asarray(v, dtype=float) for i, v in con.sql("SELECT vec_id, embedding FROM embeddings").fetchall()}
    got = {(r["epoch"], r["time"]): r["value"] for r in catalog.QUERIES["resample_times"](spark, sf_dir).collect()}
    at = [-0.5, 0.1, 0.33, 0.5, 2.0]
    want = {(i, t): x for i, v in vectors.items() for t, x in zip(at, np.interp(at, np.arange(64) / 64, v), strict=True)}
    assert max(vectors) >= 50 and got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 2e-6


def test_decoding_reads_every_condition_in_every_iteration(spark, sf_dir, con):
    got = {r["half"]: r for r in catalog.QUERIES["decoding"](spark, sf_dir).collect()}
    least = dict(con.sql("SELECT half, min(n) FROM (SELECT vec_id % 2 AS half, label, count(*) AS n FROM embeddings GROUP BY ALL) GROUP BY half").fetchall())
    assert got.keys() == least.keys()
    for half, r in got.items():
        assert r["chance"] == 0.1 and np.shape(r["confusion"]) == (10, 10) and np.allclose(np.sum(r["confusion"], axis=1), 1)
        tested = 100 * 3 * (least[half] // 3)  # of each condition: iterations x folds x trials
        counts = np.array(r["confusion"]) * tested
        assert np.abs(counts - counts.round()).max() < 1e-6 and abs(np.trace(counts) / counts.sum() - r["accuracy"]) < 1e-6
        fewer = np.array(r["confusion"]) * tested / 50
        assert np.abs(fewer - fewer.round()).max() > 0.01


def one_svm(x, y, cost=1.0):
    """One problem, one trial at a time."""
    rng, xb = np.random.default_rng(0), np.hstack([x, np.ones((len(x), 1))])
    a, w = np.zeros(len(x)), np.zeros(xb.shape[1])
    for _ in range(200):
        worst = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (xb[i] @ w) - 1
            worst = max(worst, abs(min(g, 0) if a[i] <= 0 else max(g, 0) if a[i] >= cost else g))
            new = min(max(a[i] - g / (xb[i] @ xb[i]), 0), cost)
            w, a[i] = w + (new - a[i]) * y[i] * xb[i], new
        if worst < 1e-4:
            break
    return w


def test_problems_solved_together_are_as_alone():
    rng = np.random.default_rng(3)
    x, label = rng.normal(size=(60, 4)), np.arange(60) % 3
    x[:, 0] += 3 * (label == 1)  # some problems end sooner
    pairs = [(0, 1), (0, 2), (1, 2)]
    rows = [np.flatnonzero((label == i) | (label == j)) for i, j in pairs]
    y = [np.where(label[r] == i, 1.0, -1.0) for r, (i, _) in zip(rows, pairs, strict=True)]
    got = decode.svms(x, np.stack(rows), np.stack(y))
    assert np.allclose(got, [one_svm(x[r], s) for r, s in zip(rows, y, strict=True)], atol=1e-9)


@pytest.mark.parametrize(("n", "shift"), [(150, 0.0), (150, 9.0), (3000, 0.0), (3000, 0.4)])
def test_planes_are_the_optimum(n, shift):
    rng = np.random.default_rng(n)
    y = np.where(np.arange(n) % 2 == 0, 1.0, -1.0)
    x = rng.normal(size=(n, 30)) + shift * y[:, None] / 3
    a = y[:, None] * np.hstack([x, np.ones((n, 1))])
    w = decode.plane(a)
    m = a @ w - 1
    free = np.abs(m) < 1e-5  # at the optimum w = a'alpha, alpha is 1 inside the margin, 0 outside, and between on it
    alpha, *_ = np.linalg.lstsq(a[free].T, w - a[m <= -1e-5].sum(axis=0), rcond=None)
    assert np.abs(w - a[m <= -1e-5].sum(axis=0) - alpha @ a[free]).max() < 1e-3
    assert free.sum() <= 31 and alpha.min() > -1e-3 and alpha.max() < 1 + 1e-3
    if shift == 0 and n == 150:  # coordinate descent ends before it
        value = lambda v: v @ v / 2 + np.maximum(1 - a @ v, 0).sum()
        assert value(decode.svms(x, np.arange(n)[None], y[None])[0]) > value(w) + 1e-3


def test_ica_is_fitted_on_all_samples_of_each_recording(spark, sf_dir):
    rows = views.multich(spark, sf_dir).withColumn("p", F.col("P") / 1000).toPandas().sort_values(["participant", "epoch", "pos"])
    names, spent = ["Q", "p", "D", "T"], {}
    got = {k: x.set_index(["epoch", "pos"])[names] for k, x in catalog.QUERIES["ica_clean"](spark, sf_dir).toPandas().groupby("participant")}
    for k, part in rows.groupby("participant"):
        x = part[names].to_numpy(dtype=float)
        unmixing, mixing, mean, *_ = ica.infomax(x, 3)
        spent[k] = unmixing
        clean = x - (x - mean) @ (mixing[:, :1] @ unmixing[:1]).T
        assert np.abs(got[k].loc[list(zip(part.epoch, part.pos, strict=True))].to_numpy() - clean).max() < 2e-4
    assert len(got) == len(spent) > 1 and not np.allclose(*list(spent.values())[:2])  # models differ


def test_ica_ends_where_the_gradient_is_zero(spark):
    rng = np.random.default_rng(1)
    x, part = rng.laplace(size=(36000, 3)) @ rng.normal(size=(3, 3)) + 5, np.arange(36000) % 2  # each of more than a block
    rows = spark.createDataFrame([(int(p), i, *map(float, v)) for i, (p, v) in enumerate(zip(part, x, strict=True))] + [(0, -1, None, 1.0, 1.0)], "recording int, sample int, a double, b double, c double")
    for r in ica.fit_each(rows.repartition(5), ["a", "b", "c"], ["recording"], n_components=3, remove=(0,)).collect():
        mine = x[part == r["recording"]]
        u = np.array(r["unmixing"]) @ (mine - np.array(r["mean"])).T / r["scale"]
        assert np.abs(np.tanh(u / 2) @ u.T / len(mine) - np.eye(3)).max() < 1e-6
        assert np.allclose(r["unmixing"], ica.infomax(mine, 3)[0], atol=1e-6)


def test_ica_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(0)
    mixed = rng.laplace(size=(900, 3)) @ rng.normal(size=(3, 3))
    rows = spark.createDataFrame([(int(i % 2), int(i), *map(float, v)) for i, v in enumerate(mixed)], "recording int, sample int, a double, b double, c double")
    fits = [ica.fit_each(rows.repartition(n), ["a", "b", "c"], ["recording"], n_components=3, percentage=60, steps=40, remove=()).orderBy("recording").collect() for n in (1, 5)]
    assert fits[0] == fits[1] and fits[0][0]["unmixing"] != fits[0][1]["unmixing"]


@pytest.mark.parametrize("name", ["head", "tail"])
def test_ends_are_of_all_participants(spark, sf_dir, con, name):
    n = con.sql("SELECT user_id, count(*) FROM events GROUP BY ALL").fetchall()
    every = sorted((p, k) for p, m in n for k in range(1, m + 1))
    got = [(r["participant"], r["sample"]) for r in catalog.QUERIES[name](spark, sf_dir).collect()]
    assert sorted(got) == (every[:5] if name == "head" else every[-5:])
