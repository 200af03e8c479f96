"""Queries on averages, channel statistics and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import average, channels, measure
from ..operators.select import melt
from ..sources import views
from .q_signals import erp, merp
from .registry import query, rounded

CH = list(views.CHANNELS)


@query(
    """SELECT condition, round(avg(amp), 6) + 0.0 AS mean_amplitude, count(*) AS n FROM (SELECT condition, epoch, avg(value) AS amp FROM trials WHERE time BETWEEN 0.25 AND 0.5 GROUP BY condition, epoch) GROUP BY condition""", "trials"
)
def mean_amplitude(spark, d):
    each = measure.measure(views.trials(spark, d), "mean_amplitude", ["condition", "epoch"], (0.25, 0.5))
    return rounded(each.groupBy("condition").agg(F.avg("value").alias("mean_amplitude"), F.count(F.lit(1)).alias("n")), "mean_amplitude")


@query("SELECT participant, condition, pos, time, round(value, 6) + 0.0 AS value, n_epochs FROM erp", "erp")
def average_epochs(spark, d):
    return rounded(erp(spark, d), "value")


@query(
    "SELECT condition, pos, min(time) AS time, round(avg(value), 6) + 0.0 AS value, CAST(sum(n_epochs) AS BIGINT) AS n_epochs, count(DISTINCT participant) AS n_participants, 'grand_avg_' || condition AS condition_name FROM erp GROUP BY condition, pos HAVING count(DISTINCT participant) >= 2",
    "erp",
)
def grand_average(spark, d):
    return rounded(average.grand_average(erp(spark, d), ["value"]), "value")


@query(
    "SELECT participant, condition, pos, time, CASE WHEN count(*) OVER w > 1 THEN round((sum(value) OVER w - value) / (count(*) OVER w - 1), 6) + 0.0 END AS value, CAST(sum(n_epochs) OVER w - n_epochs AS BIGINT) AS n_epochs FROM erp WINDOW w AS (PARTITION BY condition, pos)",
    "erp",
)
def jackknife(spark, d):
    return rounded(average.jackknife(erp(spark, d), ["value"]), "value")


@query(
    """WITH g AS (SELECT * FROM (VALUES (1, '1_2', 1), (1, '1_2', 2), (2, '2_3_4', 2), (2, '2_3_4', 3), (2, '2_3_4', 4)) v(g, name, c))
SELECT g AS condition, name AS condition_name, participant, epoch, pos, round(value, 6) + 0.0 AS value FROM trials JOIN g ON condition = c""",
    "trials",
)
def condition_combine(spark, d):
    out = average.condition_combine(views.trials(spark, d), [[1, 2], [2, 3, 4]])
    return rounded(out.select("condition", "condition_name", "participant", "epoch", "pos", "value"), "value")


@query(
    """SELECT CAST(k AS INTEGER) AS condition, 'difference_' || x || '_' || y AS condition_name, a.participant, a.pos, a.time, round(a.value - b.value, 6) + 0.0 AS value, least(a.n_epochs, b.n_epochs) AS n_epochs
FROM (VALUES (1, 1, 2), (2, 3, 0)) v(k, x, y) JOIN erp a ON a.condition = x JOIN erp b ON b.condition = y AND b.participant = a.participant AND b.pos = a.pos""",
    "erp",
)
def condition_difference(spark, d):
    out = average.condition_difference(erp(spark, d), [(1, 2), (3, 0)], ["value"])
    return rounded(out.select("condition", "condition_name", "participant", "pos", "time", "value", "n_epochs"), "value")


@query(
    """SELECT l.participant, l.pos, round(0.5 * ((r.Q - r.D) + (l.D - l.Q)), 6) + 0.0 AS C3, round(0.5 * ((r.D - r.Q) + (l.Q - l.D)), 6) + 0.0 AS C4
FROM merp l JOIN merp r ON l.participant = r.participant AND l.pos = r.pos WHERE l.condition = 'AF' AND r.condition = 'RF'""",
    "merp",
)
def lateralised(spark, d):
    rows = merp(spark, d).withColumnsRenamed({"Q": "C3", "D": "C4"})
    return rounded(average.lateralised(rows, [("AF", "RF")], ["C3", "C4"]).select("participant", "pos", "C3", "C4"), "C3", "C4")


@query(
    """WITH l AS (SELECT participant, unnest(['Q', 'P', 'D', 'T']) AS channel, unnest([Q, P, D, T]) AS value FROM multich),
s AS (SELECT participant, channel, min(value) AS min, max(value) AS max, stddev_samp(value) AS std, max(value) - min(value) AS range, var_samp(value) AS var FROM l GROUP BY ALL)
SELECT participant, channel, round(min, 4) + 0.0 AS min, round(max, 4) + 0.0 AS max, round(std, 4) + 0.0 AS std, round(range, 4) + 0.0 AS range, round(var / 1000, 4) + 0.0 AS var_k,
  round((var - avg(var) OVER w) / stddev_samp(var) OVER w, 4) + 0.0 AS zvar FROM s WINDOW w AS (PARTITION BY participant)""",
    "multich",
)
def channel_summary(spark, d):
    out = channels.channel_summary(views.multich(spark, d), CH, ["participant"]).withColumn("var_k", F.col("var") / 1000).drop("var")
    return rounded(out, "min", "max", "std", "range", "var_k", "zvar", digits=4)


@query(
    """SELECT 'Q' AS "row", 'P' AS "column", participant, round(corr(Q, P), 6) + 0.0 AS r FROM multich GROUP BY participant UNION ALL SELECT 'Q', 'D', participant, round(corr(Q, D), 6) + 0.0 FROM multich GROUP BY participant
UNION ALL SELECT 'T', 'P', participant, round(corr(T, P), 6) + 0.0 FROM multich GROUP BY participant UNION ALL SELECT 'T', 'D', participant, round(corr(T, D), 6) + 0.0 FROM multich GROUP BY participant""",
    "multich",
)
def correlation_matrix(spark, d):
    return rounded(channels.correlations(views.multich(spark, d), ["Q", "T"], ["P", "D"], ["participant"]).select("row", "column", "participant", "r"), "r")


@query(
    """WITH l AS (SELECT condition, unnest(['Q', 'P', 'D', 'T']) AS channel, unnest([Q, P, D, T]) AS value FROM multich),
m AS (SELECT condition, channel, min(value) AS lo, max(value) AS hi, count(*) AS n FROM l GROUP BY ALL),
k AS (SELECT l.condition, l.channel, floor((value - lo) / (hi - lo) * 99) AS bin, n, count(*) AS c FROM l JOIN m USING (condition, channel) GROUP BY ALL),
j AS (SELECT condition, channel, sum(-c * ln(c / n)) AS jp FROM k GROUP BY ALL),
z AS (SELECT condition, channel, (jp - avg(jp) OVER w) / stddev_samp(jp) OVER w AS jp FROM j WINDOW w AS (PARTITION BY condition))
SELECT condition, channel, round(jp, 4) + 0.0 AS jp, abs(jp) > 1.2 AS rejected FROM z""",
    "multich",
)
def joint_probability(spark, d):
    return rounded(channels.joint_probability(views.multich(spark, d), CH, ["condition"], bins=100, threshold=1.2, normalise=1), "jp", digits=4)


@query("SELECT participant, condition, pos, round(stddev_pop(v), 4) + 0.0 AS gfp FROM (SELECT participant, condition, pos, unnest([Q, D, T]) AS v FROM merp) GROUP BY ALL", "merp")
def field_power(spark, d):
    return rounded(channels.gfp(merp(spark, d), ["Q", "D", "T"]).select("participant", "condition", "pos", "gfp"), "gfp", digits=4)


@query(
    """WITH g AS (SELECT *, list_stddev_pop([Q, D, T]) AS s FROM merp), n AS (SELECT participant, condition, pos, Q / s AS q, D / s AS d, T / s AS t FROM g),
c AS (SELECT participant, condition, pos, sqrt(((q - lag(q) OVER w) ** 2 + (d - lag(d) OVER w) ** 2 + (t - lag(t) OVER w) ** 2) / 3) AS x FROM n WINDOW w AS (PARTITION BY participant, condition ORDER BY pos))
SELECT participant, condition, pos, round(coalesce(x, lead(x) OVER (PARTITION BY participant, condition ORDER BY pos)), 5) + 0.0 AS dissimilarity FROM c""",
    "merp",
)
def global_dissimilarity(spark, d):
    out = channels.dissimilarity(merp(spark, d), ["Q", "D", "T"], ["participant", "condition"])
    return rounded(out.select("participant", "condition", "pos", "dissimilarity"), "dissimilarity", digits=5)


@query(
    """WITH f AS (SELECT *, value > 100 AS hot, row_number() OVER (PARTITION BY participant ORDER BY sample) AS i FROM recording), g AS (SELECT *, i - row_number() OVER (PARTITION BY participant ORDER BY sample) AS k FROM f WHERE hot)
SELECT participant, min(time) AS start, max(time) AS "end", count(*) AS n FROM g GROUP BY participant, k""",
    "recording",
)
def flagged_regions(spark, d):
    return channels.regions_of(views.recording(spark, d).withColumn("hot", F.col("value") > 100), "hot", ["participant"])


@query("SELECT epoch, pos, round(CASE WHEN stddev_samp(value) OVER w = 0 THEN 0 ELSE (value - avg(value) OVER w) / stddev_samp(value) OVER w END, 6) + 0.0 AS value_z FROM trials WINDOW w AS (PARTITION BY epoch)", "trials")
def zscore_columns(spark, d):
    return rounded(channels.add_zscores(views.trials(spark, d), ["value"], ["epoch"]).select("epoch", "pos", "value_z"), "value_z")


@query(
    """WITH o AS (SELECT participant, condition, count(DISTINCT epoch) AS n_epochs, count(DISTINCT epoch) FILTER (epoch % 3 <> 0) AS n_clean FROM trials GROUP BY ALL)
SELECT *, round_even(n_clean * 100.0 / n_epochs, 1)::DOUBLE AS percentage FROM o""",
    "trials",
)
def epochs_table(spark, d):
    rows = views.trials(spark, d)
    return average.epochs_table(rows, rows.filter("epoch % 3 <> 0"))


@query(
    """SELECT participant, condition, round(avg(value), 6) + 0.0 AS mean_amplitude, round(sum(value) / 64, 6) + 0.0 AS integral, round(sum(abs(value)) / 64, 6) + 0.0 AS rectified_area,
round(sum(greatest(value, 0)) / 64, 6) + 0.0 AS positive_area, round(sum(abs(least(value, 0))) / 64, 6) + 0.0 AS negative_area FROM erp WHERE time BETWEEN 0.25 AND 0.75 GROUP BY participant, condition""",
    "erp",
)
def window_areas(spark, d):
    rows = erp(spark, d).filter(F.col("time").between(0.25, 0.75))
    return rounded(measure.areas(rows, ["participant", "condition"]), "mean_amplitude", "integral", "rectified_area", "positive_area", "negative_area")


_PEAK = """WITH r AS (SELECT *, row_number() OVER o AS i, count(*) OVER (PARTITION BY participant, condition) AS n, lag(value) OVER o AS a, lead(value) OVER o AS b,
  avg(value) OVER (o ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS la, avg(value) OVER (o ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ra FROM erp WINDOW o AS (PARTITION BY participant, condition ORDER BY time)),
f AS (SELECT *, i > 3 AND i <= n - 3 AND value > a AND value > b AND value > la AND value > ra AS up, i > 3 AND i <= n - 3 AND value < a AND value < b AND value < la AND value < ra AS down FROM r),
h AS (SELECT participant, condition, value AS hi, time AS ht FROM (SELECT *, row_number() OVER (PARTITION BY participant, condition ORDER BY up DESC, value DESC, time) AS k FROM f) WHERE k = 1),
l AS (SELECT participant, condition, value AS lo, time AS lt FROM (SELECT *, row_number() OVER (PARTITION BY participant, condition ORDER BY down DESC, value, time) AS k FROM f) WHERE k = 1)"""


@query(
    _PEAK
    + """ SELECT participant, condition, round(hi, 6) + 0.0 AS max_peak_amplitude, ht AS max_peak_latency, round(lo, 6) + 0.0 AS min_peak_amplitude, lt AS min_peak_latency,
round(hi - lo, 6) + 0.0 AS peak_to_peak_amplitude, abs(ht - lt) AS peak_to_peak_latency FROM h JOIN l USING (participant, condition)""",
    "erp",
)
def robust_peaks(spark, d):
    return rounded(measure.peaks(erp(spark, d), ["participant", "condition"]), "max_peak_amplitude", "min_peak_amplitude", "peak_to_peak_amplitude")


@query(
    """WITH r AS (SELECT participant, condition, time, sum(abs(value)) OVER (o ROWS UNBOUNDED PRECEDING) AS run, sum(abs(value)) OVER (PARTITION BY participant, condition) AS tot, lag(time) OVER o AS t0 FROM erp WINDOW o AS (PARTITION BY participant, condition ORDER BY time)),
q AS (SELECT *, lag(run) OVER (PARTITION BY participant, condition ORDER BY time) AS r0 FROM r),
x AS (SELECT participant, condition, CASE WHEN r0 IS NULL OR run = r0 THEN time ELSE t0 + (tot * 0.5 - r0) / (run - r0) * (time - t0) END AS y, row_number() OVER (PARTITION BY participant, condition ORDER BY time) AS k FROM q WHERE run >= tot * 0.5)
SELECT participant, condition, round(y, 6) + 0.0 AS fractional_area_latency FROM x WHERE k = 1""",
    "erp",
)
def fractional_area_latency(spark, d):
    rows = erp(spark, d).withColumn("value", F.abs("value"))
    return rounded(measure.fractional_area(rows, ["participant", "condition"]), "fractional_area_latency")


@query(
    _PEAK
    + """, p AS (SELECT participant, condition, CASE WHEN abs(hi) >= abs(lo) THEN hi ELSE lo END AS pk, CASE WHEN abs(hi) >= abs(lo) THEN ht ELSE lt END AS tp FROM h JOIN l USING (participant, condition)),
s AS (SELECT erp.*, pk, tp, CASE WHEN pk >= 0 THEN 1 ELSE -1 END AS g, lead(value) OVER o AS v2, lead(time) OVER o AS t2 FROM erp JOIN p USING (participant, condition) WINDOW o AS (PARTITION BY participant, condition ORDER BY time)),
x AS (SELECT participant, condition, time, coalesce(time + (pk * 0.5 - value) / nullif(v2 - value, 0) * (t2 - time), time) AS y, time < tp AND value * g <= pk * 0.5 * g AS low FROM s)
SELECT participant, condition, round(coalesce(arg_max(y, time) FILTER (low), min(time)), 6) + 0.0 AS fractional_peak_latency FROM x GROUP BY participant, condition""",
    "erp",
)
def fractional_peak_latency(spark, d):
    return rounded(measure.fractional_peak(erp(spark, d), ["participant", "condition"]), "fractional_peak_latency")


@query(
    """WITH b AS (SELECT participant, condition, pos, time, value - avg(value) FILTER (time BETWEEN 0 AND 0.125) OVER (PARTITION BY participant, condition) AS value FROM erp)
SELECT participant, condition, 'rectified_area' AS analysis_type, 0::DOUBLE AS baseline_interval_start, 0.125::DOUBLE AS baseline_interval_end, 0.25::DOUBLE AS analysis_interval_start, 0.5::DOUBLE AS analysis_interval_end,
round(sum(abs(value)) / 64, 6) + 0.0 AS value FROM b WHERE time BETWEEN 0.25 AND 0.5 GROUP BY participant, condition""",
    "erp",
)
def erp_measurements(spark, d):
    return rounded(measure.measure(erp(spark, d), "rectified_area", ["participant", "condition"], (0.25, 0.5), (0.0, 0.125)), "value")


@query(
    """WITH l AS (SELECT participant, unnest(['Q', 'D']) AS channel, unnest([Q, D]) AS value FROM merp WHERE condition = 'AF')
SELECT participant, round(avg(value) FILTER (channel = 'Q'), 6) + 0.0 AS Q, round(avg(value) FILTER (channel = 'D'), 6) + 0.0 AS D FROM l GROUP BY participant""",
    "merp",
)
def measurement_table(spark, d):
    long = melt(merp(spark, d).filter("condition = 'AF'"), ["participant", "condition", "time"], ["Q", "D"])
    table = measure.measure_table(measure.measure(long, "mean_amplitude"), ["Q", "D"])
    return rounded(table.select("participant", "Q", "D"), "Q", "D")
