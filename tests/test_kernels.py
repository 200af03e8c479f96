"""Numerical kernels against closed forms and brute force."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplewright.functions import numeric as num
from samplewright.operators import decode, filters, ica, rsa, stats, timefreq
from samplewright.sources import synthetic


def test_student_t():
    for df, want in ((1, 12.7062047), (5, 2.5705818), (30, 2.0422725)):  # tabulated
        assert abs(num.t_quantile(0.975, df) - want) < 1e-6
    assert abs(float(num.t_cdf(np.array(0.0), 7)) - 0.5) < 1e-12
    assert np.isnan(num.t_p(np.array([np.nan]), 3)[0]) and num.t_p(np.array([np.inf]), 3)[0] == 0


def test_butterworth_response():
    for kind in ("lowpass", "highpass"):
        for order in (1, 2, 3, 4):
            f, r = num.frequency_response(num.butterworth(kind, 20, 200, order), None, 200, 2001)
            assert abs(np.abs(r[np.argmin(np.abs(f - 20))]) - np.sqrt(0.5)) < 1e-3
            assert abs(np.abs(r[0 if kind == "lowpass" else -1]) - 1) < 1e-9
    with pytest.raises(ValueError):
        num.butterworth("lowpass", 150, 200, 2)


def test_filters_keep_and_remove(spark):
    df = synthetic.windowed_sines(spark, 1, (0.0, 4.0), 250, [2.0, 40.0], [1.0, 1.0], [(0, 9), (0, 9)])
    t = np.array([r[0] for r in df.select("time").orderBy("pos").collect()])
    for method in ("iir", "fir"):
        y = np.array([r[0] for r in filters.lowpass(df, 10, 250, ["epoch"], ["value"], method=method, transition=0.5, by="pos").orderBy("pos").select("value").collect()])
        assert np.abs(y - np.sin(4 * np.pi * t))[250:-250].max() < 0.05
    hi = np.array([r[0] for r in filters.highpass(df, 15, 250, ["epoch"], ["value"], order=4, by="pos").orderBy("pos").select("value").collect()])
    assert np.abs(hi - np.sin(80 * np.pi * t))[250:-250].max() < 0.05
    c = filters.characteristics("lowpass", 30, 250)
    assert abs(c["db3"] - 30) < 0.5


def test_spectrum_peak(spark):
    df = synthetic.windowed_sines(spark, 1, (0.0, 8.0), 128, [16.0], [1.0], [(0, 9)])
    p = filters.spectrum(df, 128, ["epoch"], ["value"], by="pos", window_size=128).toPandas()
    assert p.loc[p["power"].idxmax(), "freq"] == 16


@pytest.mark.parametrize("method", ["morlet", "stft", "multitaper"])
def test_time_frequency_finds_the_burst(spark, method):
    df = synthetic.windowed_sines(spark, 3, (-1.0, 1.0), 200, [10.0, 30.0], [1.0, 1.0], [(-1.0, 0.0), (0.0, 1.1)])
    kw = {"morlet": {"cycles": 5}, "stft": {"window_length": 0.3}, "multitaper": {"cycles": 5}}[method]
    out = getattr(timefreq, method)(df, [10.0, 20.0, 30.0], 200, ["value"], **kw).filter(~F.isnan("power"))
    mean = lambda f, lo, hi: out.filter((F.col("freq") == f) & F.col("time").between(lo, hi)).agg(F.avg("power")).first()[0]
    assert mean(10, -0.6, -0.4) > 20 * mean(30, -0.6, -0.4) and mean(30, 0.4, 0.6) > 20 * mean(10, 0.4, 0.6)
    if method == "morlet":
        assert abs(mean(10, -0.5, -0.4) - 1) < 0.05
    assert out.first()["n_epochs"] == 3


def test_tapers_are_orthonormal():
    t = num.dpss(64, 2.5, 4)
    assert np.allclose(t @ t.T, np.eye(4), atol=1e-9)


def test_infomax_unmixes():
    rng = np.random.default_rng(1)
    s = rng.laplace(size=(4000, 3))
    a = rng.normal(size=(3, 3))
    unmixing, mixing, *_ = ica.infomax(s @ a.T, 3, steps=200)
    g = np.abs(unmixing @ a)
    g /= g.max(axis=1, keepdims=True)
    assert np.sort(g, axis=1)[:, 1].max() < 0.2
    assert np.allclose(unmixing @ mixing, np.eye(3), atol=1e-8)


def test_ica_removal_restores(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, r)) for i, r in enumerate(rng.laplace(size=(500, 3)) @ rng.normal(size=(3, 3)))]
    df = spark.createDataFrame(rows, "sample int, a double, b double, c double")
    model = ica.run_ica(df, ["a", "b", "c"], 3, steps=20)
    clean, less = ica.remove_components(df, model, [0])
    assert less.removed == (0,)
    assert abs(ica.activations(clean, less, ["sample"]).agg(F.max(F.abs("IC1"))).first()[0]) < 1e-8
    back, _ = ica.restore_components(clean, df, ["sample"], less, [0])
    both = back.join(df.select("sample", F.col("a").alias("a0")), "sample")
    assert both.agg(F.max(F.abs(F.col("a") - F.col("a0")))).first()[0] < 1e-8


def test_ica_detectors():
    t = np.arange(0, 120, 0.004)
    beat = (np.arange(len(t)) % 225 == 100) * 10.0
    noise = np.random.default_rng(0).normal(size=(len(t), 10)) * 0.1
    act = np.column_stack([noise, beat + 0.01 * noise[:, 0], noise[:, 1] + np.sin(2 * np.pi * 50 * t)])
    assert 10 in ica.ecg_components(act, 250) and ica.line_noise_components(act, 250, z_threshold=2.5, min_harmonic=0) == [11]


def frame(spark, a, b):
    rows = [(1 if k == 0 else 2, p, f"c{c}", float(t), float(x[p, c, t])) for k, x in enumerate((a, b)) for p, c, t in product(*map(range, x.shape))]
    return spark.createDataFrame(rows, "condition int, participant int, channel string, time double, value double")


def test_cluster_test_against_all_sign_flips(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(6, 3, 8))
    a[:, :2, 3:6] += 2.5
    b = np.zeros_like(a)
    prep = stats.prepare(frame(spark, a, b), (1, 2))
    got = stats.permutation_test(prep, [("c0", "c1")], n_permutations=400).toPandas()
    near = np.eye(3, dtype=bool)
    near[0, 1] = near[1, 0] = True
    high, t = num.t_quantile(0.975, 5), stats.t_map(a, b)
    best = max(stats.find_clusters(t > high, near), key=lambda m: stats.cluster_sum(m, t))
    s = stats.cluster_sum(best, t)
    null = []
    for signs in product((-1, 1), repeat=6):
        z = stats.t_map(a * np.array(signs)[:, None, None], b)
        null.append(max([stats.cluster_sum(m, z) for m in stats.find_clusters(z > high, near)], default=0))
    exact = np.mean(np.array(null) >= s - 1e-9)
    top = got[got["polarity"] == "positive"].iloc[0]
    assert abs(top["stat"] - s) < 1e-9 and abs(top["p"] - exact) < 0.04 and list(top["channels"]) == ["c0", "c1"]
    for method in ("nonparametric_common", "nonparametric_individual"):
        assert stats.permutation_test(prep, [("c0", "c1")], n_permutations=50, threshold_method=method, min_num_neighbors=1).count() >= 0


@pytest.mark.parametrize("design", ["paired", "independent"])
def test_thresholds_come_from_all_permutations(spark, design):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(7, 2, 5)), rng.normal(size=(7, 2, 5))
    perms = spark.range(1500).repartition(5)
    shared = spark.sparkContext.broadcast((a, b, None))
    pool = np.abs([stats.t_map(*stats.shuffled(a, b, design, 3, p), design) for p in range(1500)])
    maps = stats._null_maps(perms, shared, design, 3, "both")
    for q in (0.5, 0.95, 0.999):
        assert abs(stats._pooled_quantile(perms, maps, q, bins=16, few=50) - np.quantile(pool, q)) < 1e-12
        assert abs(stats._pooled_quantile(perms, maps, q) - np.quantile(pool, q)) < 1e-12
        assert np.abs(stats._point_quantiles(perms, maps, q, (2, 5)) - np.quantile(pool, q, axis=0)).max() < 1e-12


def test_chance_clusters_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(2)
    rows = [(p, float(t), 0.5 + float(rng.normal(0.02 + 0.1 * (3 <= t < 7), 0.05)), 0.5) for p in range(12) for t in range(10)]
    people = spark.createDataFrame(rows, "participant int, time double, accuracy double, chance double")
    got = [decode.chance_clusters(x, n_permutations=300).collect() for x in (people, people.repartition(7))]
    assert got[0] == got[1] and min(r["p"] for r in got[0]) < 0.05


def test_analytic_t_edge_cases(spark):
    a = np.zeros((3, 1, 3))
    a[:, 0, 1] = 1.0
    a[:, 0, 2] = [1, 2, 4]
    out = stats.analytic_test(stats.prepare(frame(spark, a, np.zeros_like(a)), (1, 2))).orderBy("time").toPandas()
    assert np.isnan(out["t"][0]) and np.isinf(out["t"][1]) and not out["significant"][0]


def test_clusters_and_prefilter():
    mask = np.array([[1, 1, 0], [0, 1, 0], [0, 0, 1]], dtype=bool)
    near = np.eye(3, dtype=bool)
    assert len(stats.find_clusters(mask, near, "temporal")) == 3
    near[0, 1] = near[1, 0] = True
    assert len(stats.find_clusters(mask, near)) == 2
    assert stats.prefilter(mask, near, 2).sum() == 2


def test_decoding_separates(spark):
    rng = np.random.default_rng(0)
    rows = [(1, float(t), c, e, *map(float, rng.normal(size=2) + (4 * c if t else 0))) for t in (0, 1) for c in range(3) for e in range(12)]
    df = spark.createDataFrame(rows, "participant int, time double, condition int, epoch int, x double, y double")
    out = decode.decode(df, ["x", "y"], n_iterations=3).orderBy("time").collect()
    assert out[0]["accuracy"] < 0.7 and out[1]["accuracy"] > 0.95 and abs(out[1]["chance"] - 1 / 3) < 1e-12
    people = spark.createDataFrame([(p, float(t), 0.5 + (0.2 + 0.02 * p) * (3 <= t < 7) + 0.01 * ((p * 7 + t) % 5 - 2), 0.5) for p in range(8) for t in range(10)], "participant int, time double, accuracy double, chance double")
    assert decode.test_against_chance(people, correction="bonferroni").filter("significant").count() >= 4
    c = decode.chance_clusters(people, n_permutations=200).collect()
    assert (c[0]["start"], c[0]["end"], c[0]["significant"]) == (3.0, 6.0, True)


def test_similarity(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(5, 9))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "condition int, pattern array<double>")
    got = {m: {(r["i"], r["j"]): r["d"] for r in rsa.rdm(df, m, covariance=np.eye(9) * 4 if m == "mahalanobis" else None).collect()} for m in ("correlation", "spearman", "euclidean", "mahalanobis")}
    for i in range(5):
        for j in range(i + 1, 5):
            assert abs(got["correlation"][i, j] - (1 - np.corrcoef(x[i], x[j])[0, 1])) < 1e-9
            assert abs(got["spearman"][i, j] - (1 - np.corrcoef(num.ranks(x[i]), num.ranks(x[j]))[0, 1])) < 1e-9
            assert abs(got["euclidean"][i, j] - np.linalg.norm(x[i] - x[j])) < 1e-9
            assert abs(got["mahalanobis"][i, j] - np.linalg.norm(x[i] - x[j]) / 2) < 1e-6
    cov = rsa.pooled_covariance(df)
    want = np.cov(x.T)
    assert np.allclose(cov, want + 1e-6 * np.trace(want) / 9 * np.eye(9))
    m = rsa.rdm(df, "euclidean").withColumn("time", F.lit(0.0))
    out = rsa.compare_models(m, {"self": m.drop("time")}, n_permutations=50).first()
    assert abs(out["r"] - 1) < 1e-12 and out["p"] < 0.2
    assert rsa.model_from_condensed(spark, [1, 2, 3], 3).count() == 3
    sim = rsa.model_from_similarity(spark.createDataFrame([(1, 2, 0.0), (1, 3, 10.0)], "i int, j int, s double")).orderBy("j").collect()
    assert [r["d"] for r in sim] == [1.0, 0.0]


@pytest.mark.parametrize("method", ["splithalf", "kfold", "loo"])
def test_crossvalidated_similarity(spark, method):
    rows = [(0.0, c, e, f"x{k}", float(c * k + 0.01 * ((e * 3 + k) % 4))) for c in range(3) for e in range(6) for k in range(4)]
    df = spark.createDataFrame(rows, "time double, condition int, epoch int, channel string, value double")
    out = rsa.crossvalidated(df, "euclidean", method, n_folds=3, n_iterations=4).orderBy("i", "j").collect()
    assert len(out) == 3 and abs(out[1]["d"] - 2 * out[0]["d"]) < 0.1
