"""Queries on artifacts, layouts, statistics, time-frequency, decoding and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as num
from ..operators import artifacts, average, channels, decode, filters, ica, layout, process, rsa, stats, timefreq
from ..operators.select import melt
from ..sources import views
from .q_signals import erp, merp
from .registry import query, rounded

CH = list(views.CHANNELS)


@query("SELECT epoch, pos, abs(Q) > 45 OR abs(P) > 90000 OR abs(D) > 45 AS is_extreme, abs(Q) > 45 AS is_extreme_value_Q_45 FROM multich", "multich")
def extreme_values(spark, d):
    rows = views.multich(spark, d)
    out = rows.withColumn("p", F.col("P") / 2000)
    out = artifacts.extreme_values(artifacts.extreme_values(out, ["Q", "p", "D"], 45, out="is_extreme"), ["Q"], 45, "separate")
    return out.select("epoch", "pos", "is_extreme", "is_extreme_value_Q_45")


@query("SELECT condition, channel, count(*) FILTER (abs(value) > 40) AS n_extreme FROM (SELECT condition, unnest(['Q', 'D']) AS channel, unnest([Q, D]) AS value FROM multich) GROUP BY ALL", "multich")
def count_extreme(spark, d):
    return artifacts.n_extreme(views.multich(spark, d), ["Q", "D"], 40, ["condition"])


_BAD = """WITH m AS (SELECT condition, epoch, var_samp(value) AS variance, max(value) AS max, min(value) AS min, max(abs(value)) AS abs, max(value) - min(value) AS range, kurtosis_pop(value) AS kurtosis FROM trials GROUP BY ALL),
z AS (SELECT condition, epoch, abs, (variance - avg(variance) OVER w) / stddev_samp(variance) OVER w AS z1, (max - avg(max) OVER w) / stddev_samp(max) OVER w AS z2, (min - avg(min) OVER w) / stddev_samp(min) OVER w AS z3,
  (abs - avg(abs) OVER w) / stddev_samp(abs) OVER w AS z4, (range - avg(range) OVER w) / stddev_samp(range) OVER w AS z5, (kurtosis - avg(kurtosis) OVER w) / stddev_samp(kurtosis) OVER w AS z6 FROM m WINDOW w AS (PARTITION BY condition)),
b AS (SELECT condition, epoch FROM z WHERE greatest(abs(z1), abs(z2), abs(z3), abs(z4), abs(z5), abs(z6)) > 2 OR abs > 0.45)"""


def _bad(spark, d):
    return artifacts.bad_epochs(views.trials(spark, d), ["value"], 2, 0.45)


@query(_BAD + " SELECT condition, 'value' AS channel, epoch FROM b", "trials")
def bad_epochs(spark, d):
    return _bad(spark, d).select("condition", "channel", "epoch")


@query(_BAD + " SELECT epoch, pos, round(value, 6) + 0.0 AS value FROM trials WHERE epoch NOT IN (SELECT epoch FROM b)", "trials")
def reject_epochs(spark, d):
    return rounded(artifacts.reject(views.trials(spark, d), _bad(spark, d)).select("epoch", "pos", "value"), "value")


@query("SELECT epoch, pos, round(value, 6) + 0.0 AS value FROM trials WHERE epoch NOT IN (SELECT epoch FROM trials WHERE abs(value) > 0.4)", "trials")
def reject_flagged(spark, d):
    flagged = artifacts.extreme_values(views.trials(spark, d), ["value"], 0.4, out="hot")
    return rounded(artifacts.reject_flagged(flagged, ["hot"]).select("epoch", "pos", "value"), "value")


@query(
    """WITH a AS (SELECT DISTINCT condition, epoch FROM trials WHERE abs(value) > 0.35), b AS (SELECT DISTINCT condition, epoch FROM trials WHERE value > 0.33),
j AS (SELECT coalesce(a.condition, b.condition) AS condition, a.epoch AS x, b.epoch AS y FROM a FULL JOIN b ON a.epoch = b.epoch)
SELECT condition, count(x) AS before, count(y) AS after, count(*) FILTER (x IS NOT NULL AND y IS NULL) AS repaired, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS still_bad, count(*) FILTER (x IS NULL) AS "new",
CASE WHEN count(x) > 0 THEN round_even(count(*) FILTER (x IS NOT NULL AND y IS NULL) * 100.0 / count(x), 1)::DOUBLE ELSE 0 END AS repaired_percentage FROM j GROUP BY condition""",
    "trials",
)
def compare_rejections(spark, d):
    rows = views.trials(spark, d)
    return artifacts.compare_rejections(rows.filter("abs(value) > 0.35"), rows.filter("value > 0.33"))


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY participant ORDER BY sample) AS i FROM recording), c AS (SELECT *, (i - 1) // 2 + 1 AS k FROM r WHERE (i - 1) % 2 = 0),
h AS (SELECT participant, k FROM (SELECT *, abs(value - lag(value) OVER (PARTITION BY participant ORDER BY sample)) AS df FROM c) WHERE df >= 60),
o AS (SELECT participant, k * 2 AS i FROM (SELECT *, lag(k) OVER (PARTITION BY participant ORDER BY k) AS b FROM h) WHERE b IS NULL OR k - b > 2)
SELECT participant, sample, EXISTS (SELECT 1 FROM o WHERE o.participant = r.participant AND o.i = r.i) AS is_onset FROM r""",
    "recording",
)
def eog_onsets(spark, d):
    return artifacts.eog_onsets(views.recording(spark, d), "value", 60, 40).select("participant", "sample", "is_onset")


_EDGE = """l AS (SELECT n_name AS label, CAST(n_nationkey % 5 AS DOUBLE) AS x2, CAST(n_nationkey // 5 AS DOUBLE) AS y2 FROM nation),
p AS (SELECT a.label AS channel, b.label AS neighbour, sqrt((a.x2 - b.x2) ** 2 + (a.y2 - b.y2) ** 2) AS distance FROM l a JOIN l b ON a.label <> b.label WHERE (a.x2 - b.x2) ** 2 + (a.y2 - b.y2) ** 2 <= 2.25),
e AS (SELECT *, (1 / distance) / sum(1 / distance) OVER (PARTITION BY channel) AS weight FROM p)"""


def _grid(spark, d):
    k = F.col("n_nationkey").cast("double")
    return views.table(spark, d, "nation").select(F.col("n_name").alias("label"), (k % 5).alias("x2"), F.floor(k / 5).cast("double").alias("y2"))


@query("WITH " + _EDGE + " SELECT channel, neighbour, round(distance, 6) + 0.0 AS distance, round(weight, 6) + 0.0 AS weight FROM e")
def layout_neighbours(spark, d):
    return rounded(layout.neighbours(_grid(spark, d), 1.5), "distance", "weight")


@query("WITH " + _EDGE + " SELECT avg(n) AS mean_neighbours FROM (SELECT count(neighbour) AS n FROM l LEFT JOIN e ON label = channel GROUP BY label)")
def mean_neighbours(spark, d):
    return layout.mean_neighbours(layout.neighbours(_grid(spark, d), 1.5), _grid(spark, d))


@query(
    "WITH "
    + _EDGE
    + """, b AS (SELECT n_name AS channel FROM nation WHERE n_nationkey IN (0, 12, 13, 24))
SELECT b.channel, count(neighbour) >= 2 AND count(*) FILTER (neighbour IN (SELECT channel FROM b)) = 0 AS repairable FROM b LEFT JOIN e ON b.channel = e.channel GROUP BY b.channel"""
)
def channel_repairable(spark, d):
    bad = views.table(spark, d, "nation").filter(F.col("n_nationkey").isin(0, 12, 13, 24)).select(F.col("n_name").alias("channel"))
    return artifacts.repairable(bad, layout.neighbours(_grid(spark, d), 1.5))


@query("SELECT epoch, pos, round(0.25 * D + 0.75 * T, 6) + 0.0 AS Q, round(0.5 * (0.25 * D + 0.75 * T) + 0.5 * T, 6) + 0.0 AS D, round(T, 6) + 0.0 AS T FROM multich", "multich")
def repair_neighbours(spark, d):
    weights = {"Q": {"D": 0.25, "T": 0.75}, "D": {"Q": 0.5, "T": 0.5}}
    out = artifacts.repair_neighbours(views.multich(spark, d).select("epoch", "pos", "Q", "D", "T"), ["Q", "D", "T"], ["Q", "D"], weights)
    return rounded(out, "Q", "D", "T")


@query(
    "SELECT epoch, pos, round(CASE WHEN epoch % 7 = 0 THEN 0.25 * D + 0.75 * T ELSE Q END, 6) + 0.0 AS Q FROM multich", "multich"
)
def repair_epochs(spark, d):
    rows = views.multich(spark, d).select("condition", "epoch", "pos", "Q", "D", "T")
    bad = rows.filter("epoch % 7 = 0").select("epoch", F.lit("Q").alias("channel"))
    return rounded(artifacts.repair_epochs(rows, ["Q", "D", "T"], bad, {"Q": {"D": 0.25, "T": 0.75}}, ["epoch"]).select("epoch", "pos", "Q"), "Q")


@query(
    """WITH l AS (SELECT n_name AS label, radians(CAST(n_nationkey * 4 AS DOUBLE)) AS inc, radians(CAST(n_nationkey * 14 AS DOUBLE)) AS azi FROM nation),
c AS (SELECT label, sin(inc) * cos(azi) AS x, sin(inc) * sin(azi) AS y, cos(inc) AS z, inc * cos(azi) * 2 / pi() AS x2, inc * sin(azi) * 2 / pi() AS y2 FROM l),
s AS (SELECT greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) / 2 AS h, (max(x) + min(x)) / 2 AS mx, (max(y) + min(y)) / 2 AS my, (max(z) + min(z)) / 2 AS mz FROM c)
SELECT label, round(x2, 6) + 0.0 AS x2, round(y2, 6) + 0.0 AS y2, round((x - mx) / h, 6) + 0.0 AS x3, round((y - my) / h, 6) + 0.0 AS y3, round((z - mz) / h, 6) + 0.0 AS z3 FROM c, s"""
)
def layout_coordinates(spark, d):
    k = F.col("n_nationkey").cast("double")
    rows = views.table(spark, d, "nation").select(F.col("n_name").alias("label"), (k * 4).alias("inc"), (k * 14).alias("azi"))
    out = layout.cartesian_3d(layout.cartesian_2d(rows)).drop("inc", "azi")
    return rounded(out, "x2", "y2", "x3", "y3", "z3")


_PAIRED = """WITH a AS (SELECT * FROM erp WHERE condition = 1), b AS (SELECT * FROM erp WHERE condition = 2),
d AS (SELECT a.participant, a.pos, a.time, a.value - b.value AS d FROM a JOIN b USING (participant, pos)),
s AS (SELECT pos, time, avg(d) AS m, stddev_samp(d) AS s, count(*) AS n FROM d GROUP BY pos, time)"""


def _prepared(spark, d, design="paired"):
    rows = erp(spark, d).withColumn("channel", F.lit("value"))
    return stats.prepare(rows, (1, 2), design)


@query(_PAIRED + " SELECT 'value' AS channel, time, round(m / (s / sqrt(n)), 6) + 0.0 AS t, CAST(n - 1 AS DOUBLE) AS df FROM s", "erp")
def paired_t(spark, d):
    return rounded(stats.t_table(_prepared(spark, d)), "t")


@query(
    """WITH s AS (SELECT time, avg(value) FILTER (condition = 1) AS ma, avg(value) FILTER (condition = 2) AS mb, var_samp(value) FILTER (condition = 1) AS va, var_samp(value) FILTER (condition = 2) AS vb,
  count(*) FILTER (condition = 1) AS na, count(*) FILTER (condition = 2) AS nb FROM erp WHERE condition IN (1, 2) GROUP BY time)
SELECT 'value' AS channel, time, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb)), 6) + 0.0 AS t, CAST(na + nb - 2 AS DOUBLE) AS df FROM s""",
    "erp",
)
def independent_t(spark, d):
    return rounded(stats.t_table(_prepared(spark, d, "independent"), "independent"), "t")


@query()
def analytic_test(spark, d):
    return rounded(stats.analytic_test(_prepared(spark, d), correction="bonferroni"), "t", "p")


@query()
def permutation_test(spark, d):
    return rounded(stats.permutation_test(_prepared(spark, d), n_permutations=200, cluster_type="temporal", threshold=0.1), "stat", "p")


_PAT = """WITH p AS (SELECT condition, pos, avg(value) AS v FROM trials GROUP BY condition, pos), x AS (SELECT a.condition AS i, b.condition AS j, a.v AS va, b.v AS vb FROM p a JOIN p b ON a.pos = b.pos AND a.condition < b.condition)"""


@query(_PAT + " SELECT i, j, round(1 - corr(va, vb), 6) + 0.0 AS d FROM x GROUP BY i, j", "trials")
def rdm_correlation(spark, d):
    return rounded(rsa.rdm(rsa.mean_patterns(views.patterns(spark, d))), "d")


@query(_PAT + " SELECT i, j, round(sqrt(sum((va - vb) ** 2)), 6) + 0.0 AS d FROM x GROUP BY i, j", "trials")
def rdm_euclidean(spark, d):
    return rounded(rsa.rdm(rsa.mean_patterns(views.patterns(spark, d)), "euclidean"), "d")


@query(
    """WITH p AS (SELECT condition, pos, avg(value) AS v FROM trials GROUP BY condition, pos), r AS (SELECT condition, pos, rank() OVER (PARTITION BY condition ORDER BY v) + (count(*) OVER (PARTITION BY condition, v) - 1) / 2.0 AS v FROM p)
SELECT a.condition AS i, b.condition AS j, round(1 - corr(a.v, b.v), 6) + 0.0 AS d FROM r a JOIN r b ON a.pos = b.pos AND a.condition < b.condition GROUP BY 1, 2""",
    "trials",
)
def rdm_spearman(spark, d):
    return rounded(rsa.rdm(rsa.mean_patterns(views.patterns(spark, d)), "spearman"), "d")


@query(
    _PAT
    + """, m AS (SELECT i, j, sqrt(sum((va - vb) ** 2)) AS d FROM x GROUP BY i, j)
SELECT i, j, round((d - avg(d) OVER ()) / stddev_samp(d) OVER (), 6) + 0.0 AS z, CAST(row_number() OVER (ORDER BY d, i, j) AS DOUBLE) AS rank, round((d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()), 6) + 0.0 AS scaled FROM m""",
    "trials",
)
def rdm_normalised(spark, d):
    m = rsa.rdm(rsa.mean_patterns(views.patterns(spark, d)), "euclidean")
    out = None
    for method, name in (("zscore", "z"), ("rank", "rank"), ("minmax", "scaled")):
        part = rsa.normalise_rdm(m, method).withColumnRenamed("d", name)
        out = part if out is None else out.join(part, ["i", "j"])
    return rounded(out, "z", "scaled")


@query(
    _PAT
    + """, m AS (SELECT i, j, sqrt(sum((va - vb) ** 2)) AS d, CAST(j - i AS DOUBLE) AS w FROM x GROUP BY i, j),
r AS (SELECT rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0 AS a, rank() OVER (ORDER BY w) + (count(*) OVER (PARTITION BY w) - 1) / 2.0 AS b FROM m) SELECT round(corr(a, b), 6) + 0.0 AS r FROM r""",
    "trials",
)
def rdm_model_correlation(spark, d):
    m = rsa.rdm(rsa.mean_patterns(views.patterns(spark, d)), "euclidean")
    model = rsa.model_from_values(m.select(F.explode(F.array("i", "j")).alias("c")).distinct(), "c", "c")
    return rounded(rsa.correlate(m, model), "r")


@query(
    """WITH p AS (SELECT participant, condition, pos, avg(value) AS v FROM trials GROUP BY ALL),
m AS (SELECT a.participant, a.condition AS i, b.condition AS j, sqrt(sum((a.v - b.v) ** 2)) AS d FROM p a JOIN p b ON a.participant = b.participant AND a.pos = b.pos AND a.condition < b.condition GROUP BY ALL)
SELECT i, j, round(avg(d), 6) + 0.0 AS d, count(*) AS n FROM m GROUP BY i, j""",
    "trials",
)
def rdm_grand_average(spark, d):
    return rounded(rsa.grand_average(_participant_rdms(spark, d), []), "d")


def _participant_rdms(spark, d):
    rows = views.trials(spark, d).withColumnRenamed("pos", "channel")
    return rsa.rdm(rsa.condition_patterns(rows, ["participant"]), "euclidean", ["participant"])


@query(
    """WITH p AS (SELECT participant, condition, pos, avg(value) AS v FROM trials GROUP BY ALL),
m AS (SELECT a.participant, a.condition AS i, b.condition AS j, sqrt(sum((a.v - b.v) ** 2)) AS d FROM p a JOIN p b ON a.participant = b.participant AND a.pos = b.pos AND a.condition < b.condition GROUP BY ALL),
o AS (SELECT *, avg(d) OVER w AS al, CASE WHEN count(*) OVER w > 1 THEN (sum(d) OVER w - d) / (count(*) OVER w - 1) END AS ot FROM m WINDOW w AS (PARTITION BY i, j)),
e AS (SELECT participant, corr(d, ot) AS lo, corr(d, al) AS hi FROM o GROUP BY participant) SELECT round(avg(lo), 6) + 0.0 AS lower, round(avg(hi), 6) + 0.0 AS upper FROM e""",
    "trials",
)
def noise_ceiling(spark, d):
    return rounded(rsa.noise_ceiling(_participant_rdms(spark, d), "pearson", []), "lower", "upper")


@query()
def rdm_compare_models(spark, d):
    m = rsa.rdm(rsa.mean_patterns(views.patterns(spark, d)), "euclidean").withColumn("time", F.lit(0.0))
    model = rsa.model_from_values(m.select(F.explode(F.array("i", "j")).alias("c")).distinct(), "c", "c")
    return rounded(rsa.compare_models(m, {"distance": model}, n_permutations=200), "r", "p")


@query(
    """WITH f AS (SELECT *, dense_rank() OVER (PARTITION BY condition ORDER BY epoch) % 3 AS fold FROM trials), s AS (SELECT split FROM range(3) r(split)),
p AS (SELECT split, fold = split AS held, condition, pos, avg(value) AS v FROM f, s GROUP BY ALL),
x AS (SELECT a.split, a.condition AS a, b.condition AS b, sqrt(sum((a.v - b.v) ** 2)) AS d FROM p a JOIN p b ON a.split = b.split AND a.pos = b.pos AND NOT a.held AND b.held AND a.condition <> b.condition GROUP BY ALL)
SELECT 0.0::DOUBLE AS time, least(a, b) AS i, greatest(a, b) AS j, round(avg(d), 6) + 0.0 AS d FROM x GROUP BY ALL""",
    "trials",
)
def rdm_crossvalidated(spark, d):
    rows = views.trials(spark, d).select(F.lit(0.0).alias("time"), "condition", "epoch", F.col("pos").alias("channel"), "value")
    return rounded(rsa.crossvalidated(rows, "euclidean", "kfold", n_folds=3), "d")


@query("SELECT a.n_nationkey AS i, b.n_nationkey AS j, CAST(a.n_regionkey <> b.n_regionkey AS DOUBLE) AS d FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def model_categorical(spark, d):
    return rsa.model_from_values(views.table(spark, d, "nation"), "n_nationkey", "n_regionkey", "categorical")


@query(
    """WITH q AS (SELECT unnest([-0.5, 0.1, 0.33, 0.5, 2.0])::DOUBLE AS t),
a AS (SELECT epoch, t, max(time) FILTER (time <= t) AS t0, min(time) FILTER (time >= t) AS t1 FROM trials, q GROUP BY ALL),
b AS (SELECT a.*, max(value) FILTER (time = t0) AS v0, max(value) FILTER (time = t1) AS v1 FROM a JOIN trials x ON x.epoch = a.epoch AND (time = t0 OR time = t1) GROUP BY ALL)
SELECT epoch, t AS time, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) + 0.0 AS value FROM b""",
    "trials",
)
def resample_times(spark, d):
    rows = views.trials(spark, d).select("epoch", "time", "value")
    targets = spark.createDataFrame([(x,) for x in (-0.5, 0.1, 0.33, 0.5, 2.0)], "time double")
    return rounded(rsa.resample_times(rows, targets, ["epoch"]), "value")


@query(
    """WITH p AS (SELECT epoch, pos % 4 AS freq, time, value * value AS power FROM trials), b AS (SELECT *, avg(power) FILTER (time BETWEEN 0 AND 0.25) OVER (PARTITION BY epoch, freq) AS m FROM p)
SELECT epoch, freq, time, round((power - m) / (power + m), 6) + 0.0 AS normchange, round(100 * (power - m) / m, 3) + 0.0 AS percent FROM b""",
    "trials",
)
def tf_baseline(spark, d):
    rows = views.trials(spark, d).select("epoch", (F.col("pos") % 4).alias("freq"), "time", (F.col("value") * F.col("value")).alias("power"))
    a = timefreq.baseline(rows, (0.0, 0.25), "normchange", ["epoch", "freq"]).withColumnRenamed("power", "normchange")
    b = timefreq.baseline(rows, (0.0, 0.25), "percent", ["epoch", "freq"]).withColumnRenamed("power", "percent")
    return rounded(rounded(a.join(b, ["epoch", "freq", "time"]), "normchange"), "percent", digits=3)


@query()
def lowpass(spark, d):
    return rounded(filters.lowpass(views.trials(spark, d), 8.0, 64.0, ["epoch"], ["value"], by="pos"), "value")


@query()
def highpass(spark, d):
    return rounded(filters.highpass(views.trials(spark, d), 1.0, 64.0, ["epoch"], ["value"], by="pos"), "value")


@query(
    """WITH w AS (SELECT n, 0.5 - 0.5 * cos(2 * pi() * n / 31) AS h FROM range(32) r(n)), f AS (SELECT k FROM range(17) r(k)), g AS (SELECT s FROM (VALUES (0), (16), (32)) v(s)),
z AS (SELECT epoch, s, k, sum(value * h * cos(2 * pi() * k * n / 32)) AS re, sum(value * h * sin(2 * pi() * k * n / 32)) AS im FROM trials, w, f, g WHERE pos - 1 = s + n GROUP BY ALL),
p AS (SELECT epoch, k, avg(re * re + im * im) / (64.0::DOUBLE * (SELECT sum(h * h) FROM w)) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END AS power FROM z GROUP BY epoch, k)
SELECT epoch, 'value' AS channel, k * 2.0::DOUBLE AS freq, round(power, 6) + 0.0 AS power, round(10 * log10(greatest(power, 1e-10::DOUBLE)), 6) + 0.0 AS db FROM p""",
    "trials",
)
def spectrum(spark, d):
    return rounded(filters.decibels(filters.spectrum(views.trials(spark, d), 64.0, ["epoch"], ["value"], by="pos", window_size=32)), "power", "db")


@query(
    """WITH f AS (SELECT freq, 3 / (2 * pi() * freq) AS s, CAST(ceil(4 * 64 * 3 / (2 * pi() * freq)) AS INTEGER) AS h, CAST(ceil(3 / freq / 2 * 64) AS INTEGER) AS half FROM (VALUES (8.0::DOUBLE), (12.0), (16.0)) v(freq)),
k AS (SELECT freq, s, half, unnest(range(-h, h + 1)) AS j FROM f),
g AS (SELECT *, exp(-((j / 64.0::DOUBLE) ** 2) / (2 * s * s)) AS e FROM k),
w AS (SELECT freq, half, j, 2 * e / sum(e) OVER (PARTITION BY freq) AS a, 2 * pi() * freq * j / 64.0::DOUBLE AS ph FROM g),
z AS (SELECT t.condition, t.epoch, w.freq, w.half, t.pos - 1 + w.j AS i, sum(t.value * a * cos(ph)) AS re, sum(t.value * a * sin(ph)) AS im FROM trials t, w WHERE t.pos - 1 + w.j BETWEEN 0 AND 63 GROUP BY ALL),
m AS (SELECT condition, freq, i, i < half OR i > 63 - half AS edge, avg(re * re + im * im) AS power, avg(re) AS re, avg(im) AS im, count(*) AS n_epochs FROM z GROUP BY ALL)
SELECT condition, 'value' AS channel, i / 64.0::DOUBLE AS time, freq, CASE WHEN edge THEN 'NaN'::DOUBLE ELSE round(power, 6) + 0.0 END AS power, CASE WHEN edge THEN 'NaN'::DOUBLE ELSE round(atan2(im, re), 6) + 0.0 END AS phase, n_epochs FROM m""",
    "trials",
)
def morlet(spark, d):
    return rounded(timefreq.morlet(views.trials(spark, d), [8.0, 12.0, 16.0], 64.0, ["value"], cycles=3), "power", "phase")


@query(
    """WITH f AS (SELECT freq FROM (VALUES (8.0::DOUBLE), (16.0)) v(freq)), h AS (SELECT n, 0.5 - 0.5 * cos(2 * pi() * n / 31) AS h FROM range(32) r(n)),
w AS (SELECT freq, n, h / sqrt((SELECT sum(h * h) FROM h)) * sqrt(2.0::DOUBLE / 32) AS a, -2 * pi() * freq * (n - 16) / 64.0::DOUBLE AS ph FROM f, h), c AS (SELECT unnest(range(0, 64, 3)) AS c),
z AS (SELECT condition, epoch, freq, c, sum(value * a * cos(ph)) AS re, sum(value * a * sin(ph)) AS im FROM trials, w, c WHERE pos - 1 = c - 16 + n GROUP BY ALL),
m AS (SELECT condition, freq, c, c < 16 OR c > 47 AS edge, avg(re * re + im * im) AS power, avg(re) AS re, avg(im) AS im, count(*) AS n_epochs FROM z GROUP BY ALL)
SELECT condition, 'value' AS channel, c / 64.0::DOUBLE AS time, freq, CASE WHEN edge THEN 'NaN'::DOUBLE ELSE round(power, 6) + 0.0 END AS power, CASE WHEN edge THEN 'NaN'::DOUBLE ELSE round(atan2(im, re), 6) + 0.0 END AS phase, n_epochs FROM m""",
    "trials",
)
def stft(spark, d):
    return rounded(timefreq.stft(views.trials(spark, d), [8.0, 16.0], 64.0, ["value"], window_length=0.5), "power", "phase")


@query()
def multitaper(spark, d):
    return rounded(timefreq.multitaper(views.trials(spark, d), [8.0, 16.0], 64.0, ["value"], cycles=4), "power", "phase")


@query()
def ica_clean(spark, d):
    rows = views.multich(spark, d).withColumn("p", F.col("P") / 1000)
    names = ["Q", "p", "D", "T"]
    models = ica.fit_each(rows, names, ["participant"], ("epoch", "pos"), remove=(0,))
    return rounded(ica.remove_each(rows, models, names, ["participant"]).select("participant", "epoch", "pos", *names), *names, digits=4)


@query()
def decoding(spark, d):
    rows = views.patterns(spark, d).withColumn("half", F.col("epoch") % 2)
    wide = rows.select("half", "condition", "epoch", *[F.element_at("pattern", k + 1).alias(f"x{k}") for k in range(views.WIDTH)])
    return rounded(decode.decode(wide, [f"x{k}" for k in range(views.WIDTH)], ["half"]), "accuracy", "stderror")


@query(
    """WITH p AS (SELECT l_returnflag AS condition, l_linestatus AS predicted, count(*) AS n FROM lineitem GROUP BY ALL) SELECT condition, predicted, n, n / sum(n) OVER (PARTITION BY condition) AS share FROM p"""
)
def confusion_matrix(spark, d):
    return decode.confusion_matrix(views.table(spark, d, "lineitem"), "l_returnflag", "l_linestatus").withColumnsRenamed({"l_returnflag": "condition", "l_linestatus": "predicted"})


@query(
    """WITH a AS (SELECT time, participant, 0.5 + value AS accuracy FROM erp WHERE condition = 1) SELECT time, round(avg(accuracy), 6) + 0.0 AS accuracy, round(stddev_samp(accuracy) / sqrt(count(*)), 6) + 0.0 AS stderror, count(*) AS n, 0.5::DOUBLE AS chance FROM a GROUP BY time""",
    "erp",
)
def decoding_grand_average(spark, d):
    rows = erp(spark, d).filter("condition = 1").select("participant", "time", (0.5 + F.col("value")).alias("accuracy"), F.lit(0.5).cast("double").alias("chance"))
    return rounded(decode.grand_average(rows), "accuracy", "stderror")


@query()
def decoding_against_chance(spark, d):
    rows = erp(spark, d).filter("condition = 1").select("participant", "time", (0.5 + F.col("value")).alias("accuracy"), F.lit(0.5).cast("double").alias("chance"))
    return rounded(decode.test_against_chance(rows), "t", "p")


@query("SELECT channel, count(DISTINCT participant) AS n_participants FROM (SELECT participant, CASE WHEN pos > 3 THEN 'Q' ELSE 'D' END AS channel FROM multich WHERE Q > 48) GROUP BY channel", "multich")
def electrode_repairs(spark, d):
    rows = views.multich(spark, d).filter("Q > 48").select("participant", F.when(F.col("pos") > 3, "Q").otherwise("D").alias("channel"))
    return artifacts.electrode_repairs(rows)


@query("SELECT c_custkey AS file, CASE WHEN c_custkey % 3 = 0 THEN -1.0 ELSE c_acctbal END::DOUBLE AS percentage FROM customer")
def merge_summaries(spark, d):
    old = views.table(spark, d, "customer").select(F.col("c_custkey").alias("file"), F.col("c_acctbal").alias("percentage"))
    new = old.filter("file % 3 = 0").withColumn("percentage", F.lit(-1.0))
    return average.merge_summaries(old, new)


@query(
    """WITH l AS (SELECT participant, channel, avg(value) AS v FROM (SELECT participant, unnest(['Q', 'D', 'T']) AS channel, unnest([Q, D, T]) AS value FROM multich) GROUP BY ALL)
SELECT channel, round(avg(v), 6) + 0.0 AS mean, round(1.96 * stddev_samp(v) / sqrt(count(*)), 6) + 0.0 AS half_width FROM l GROUP BY channel""",
    "multich",
)
def summary_intervals(spark, d):
    long = melt(views.multich(spark, d), ["participant"], ["Q", "D", "T"]).groupBy("participant", "channel").agg(F.avg("value").alias("v"))
    return rounded(channels.average_summary(long, "v"), "mean", "half_width")


@query("SELECT participant, condition, pos, round(0.5 * Q - 0.5 * D, 6) + 0.0 AS Q, round(D + 1, 6) + 0.0 AS D FROM merp", "merp")
def linear_map(spark, d):
    out = process.linear_map(merp(spark, d).select("participant", "condition", "pos", "Q", "D"), ["Q", "D"], [[0.5, -0.5], [0, 1]], [0.0, 1.0])
    return rounded(out, "Q", "D")


# The 0.975 quantiles of Student's t, as printed in any table.
@query("SELECT df::INTEGER AS df, t::DOUBLE AS t FROM (VALUES (1, 12.706205), (2, 4.302653), (5, 2.570582), (9, 2.262157), (30, 2.042272), (120, 1.97993)) v(df, t)")
def t_quantiles(spark, d):
    return spark.createDataFrame([(df, round(num.t_quantile(0.975, df), 6)) for df in (1, 2, 5, 9, 30, 120)], "df int, t double")
