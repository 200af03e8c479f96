"""Queries on column roles, selections, summaries, layouts, repairs and the table operations under them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import artifacts, average, channels, epochs, layout, select
from ..sources import views
from .q_analysis import _BAD, _EDGE, CH, _bad, _grid
from .q_signals import merp
from .registry import query, rounded


@query("SELECT participant, condition, epoch, pos, round(Q, 6) + 0.0 AS Q, round(P, 6) + 0.0 AS P, round(D, 6) + 0.0 AS D, round(T, 6) + 0.0 AS T FROM multich", "multich")
def role_columns(spark, d):
    rows = views.multich(spark, d).withColumn("note", F.lit("x"))
    roles = select.Roles.of(rows, CH)
    return rounded(roles.select(rows, "meta", "channels"), *CH)


@query("SELECT epoch, pos, round(T, 6) + 0.0 AS T, round(Q, 6) + 0.0 AS Q, round(P, 6) + 0.0 AS P FROM multich", "multich")
def pick_channels(spark, d):
    rows = views.multich(spark, d).select("epoch", "pos", *CH)
    return rounded(select.select_channels(rows, select.Roles.of(rows, CH), select.channels("T", 1, range(1, 3), "none")), "T", "Q", "P")


@query("SELECT round(D, 6) + 0.0 AS D, round(T, 6) + 0.0 AS T FROM multich", "multich")
def pick_other_channels(spark, d):
    rows = views.multich(spark, d).select("epoch", "pos", *CH)
    return rounded(select.select_channels(rows, select.Roles.of(rows, CH), select.channels_not(lambda n: n in "PQ"), include_meta=False), "D", "T")


@query("SELECT epoch, pos, round(Q, 6) + 0.0 AS Q FROM multich", "multich")
def delete_channels(spark, d):
    return rounded(select.drop_channels(views.multich(spark, d).select("epoch", "pos", *CH), "P", "D", "T"), "Q")


@query("SELECT epoch, pos, round((Q + P) / 2 - D, 6) + 0.0 AS vEOG, round(D - T, 6) + 0.0 AS hEOG FROM multich", "multich")
def eog_difference(spark, d):
    out = select.eog_channels(views.multich(spark, d), (["Q", "P"], ["D"]), (["D"], ["T"]))
    return rounded(out.select("epoch", "pos", "vEOG", "hEOG"), "vEOG", "hEOG")


_PAIRS = " UNION ALL ".join(f"SELECT condition, '{a}' AS \"row\", '{b}' AS \"column\", " + ("1.0::DOUBLE" if a == b else f"round(corr({a}, {b}), 6) + 0.0") + " AS r FROM multich GROUP BY condition" for a in CH for b in CH)


@query(_PAIRS, "multich")
def correlation_all(spark, d):
    return rounded(channels.correlations(views.multich(spark, d), CH, keys=["condition"]), "r")


@query(
    "WITH e AS (SELECT *, Q - D AS v, D - T AS h FROM multich) "
    + " UNION ALL ".join(f"SELECT '{a}' AS channel, '{b}' AS eog, round(corr({a}, {c}), 6) + 0.0 AS r FROM e" for a in "QDT" for b, c in (("vEOG", "v"), ("hEOG", "h"))),
    "multich",
)
def correlation_eog(spark, d):
    rows = select.eog_channels(views.multich(spark, d), (["Q"], ["D"]), (["D"], ["T"]))
    return rounded(channels.correlations(rows, list("QDT"), ["vEOG", "hEOG"]).withColumnsRenamed({"row": "channel", "column": "eog"}), "r")


@query(
    """WITH l AS (SELECT participant, condition, unnest(['Q', 'D', 'T']) AS channel, unnest([Q, D, T]) AS value FROM multich),
s AS (SELECT participant, condition, channel, min(value) AS min, max(value) AS max, stddev_samp(value) AS std, max(value) - min(value) AS range, var_samp(value) AS var FROM l GROUP BY ALL)
SELECT participant, condition, channel, round(min, 4) + 0.0 AS min, round(max, 4) + 0.0 AS max, round(std, 4) + 0.0 AS std, round(range, 4) + 0.0 AS range, round(var, 4) + 0.0 AS var,
  round((var - avg(var) OVER w) / stddev_samp(var) OVER w, 4) + 0.0 AS zvar FROM s WINDOW w AS (PARTITION BY participant, condition)""",
    "multich",
)
def channel_summary_by_trial_group(spark, d):
    out = channels.channel_summary(views.multich(spark, d), ["Q", "D", "T"], ["participant", "condition"])
    return rounded(out, "min", "max", "std", "range", "var", "zvar", digits=4)


@query(
    """WITH g AS (SELECT *, list_stddev_pop([Q, D, T]) AS s FROM merp), n AS (SELECT participant, condition, pos, s, Q / s AS q, D / s AS d, T / s AS t FROM g),
c AS (SELECT participant, condition, pos, s, sqrt(((q - lag(q) OVER w) ** 2 + (d - lag(d) OVER w) ** 2 + (t - lag(t) OVER w) ** 2) / 3) AS x FROM n WINDOW w AS (PARTITION BY participant, condition ORDER BY pos))
SELECT participant, condition, pos, round(s, 5) + 0.0 AS gfp, round(coalesce(x, lead(x) OVER (PARTITION BY participant, condition ORDER BY pos)), 5) + 0.0 AS dissimilarity FROM c""",
    "merp",
)
def power_and_dissimilarity(spark, d):
    out = channels.gfp_and_dissimilarity(merp(spark, d), ["Q", "D", "T"], ["participant", "condition"])
    return rounded(out.select("participant", "condition", "pos", "gfp", "dissimilarity"), "gfp", "dissimilarity", digits=5)


@query(
    """WITH a AS (SELECT participant, condition, count(DISTINCT epoch) AS n FROM trials GROUP BY ALL), b AS (SELECT participant, condition, count(DISTINCT epoch) AS m FROM trials WHERE epoch NOT IN (SELECT epoch FROM trials WHERE abs(value) > 0.4) GROUP BY ALL),
t AS (SELECT participant, round_even(coalesce(m, 0) * 100.0 / n, 1) AS percentage FROM a LEFT JOIN b USING (participant, condition)) SELECT participant, round_even(avg(percentage), 1)::DOUBLE AS percentage FROM t GROUP BY participant""",
    "trials",
)
def file_summary(spark, d):
    rows = views.trials(spark, d)
    clean = artifacts.reject_flagged(artifacts.extreme_values(rows, ["value"], 0.4, out="hot"), ["hot"])
    return average.file_summary(average.epochs_table(rows, clean).withColumn("percentage", F.col("percentage").cast("double")))


@query(
    """WITH p AS (SELECT count(DISTINCT l_suppkey % 10) AS n FROM lineitem) SELECT l_returnflag AS class, count(l_linenumber) AS total, round_even(count(l_linenumber) / any_value(p.n), 2)::DOUBLE AS mean FROM lineitem, p GROUP BY 1"""
)
def component_counts(spark, d):
    rows = views.table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("participant"), F.col("l_returnflag").alias("class"), F.col("l_linenumber").alias("component"))
    return artifacts.component_counts(rows)


@query("SELECT n_name AS channel FROM nation WHERE abs((n_nationkey - 12) / 5.0) > 1.7 OR n_regionkey = 2")
def bad_channels(spark, d):
    rows = views.table(spark, d, "nation").select(F.col("n_name").alias("channel"), ((F.col("n_nationkey") - 12) / 5.0).alias("zvar"), (F.col("n_regionkey") == 2).alias("rejected"))
    return artifacts.bad_channels(rows, rows, 1.7)


@query("SELECT n_name AS channel, coalesce(n_nationkey % 7 > 3 AND n_nationkey < 20, false) AS eog_related FROM nation")
def bad_channels_by_eog(spark, d):
    rows = views.table(spark, d, "nation").select(F.col("n_name").alias("channel"), F.col("n_nationkey").alias("k"))
    r = rows.filter("k < 20").select(F.col("channel").alias("row"), (F.col("k") % 7 / -10.0).alias("r"))
    return artifacts.by_eog_correlation(rows.select("channel"), r.unionByName(r.withColumn("r", F.lit(0.1))))


@query("SELECT o_orderkey AS file, o_custkey AS participant FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def subset_bad_data(spark, d):
    rows = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("participant"))
    table = views.table(spark, d, "customer").select(F.col("c_custkey").alias("participant"), F.col("c_acctbal").alias("percentage"))
    return artifacts.subset_bad_data(rows, table, 0.0).select("file", "participant")


@query(_BAD + " SELECT DISTINCT condition, epoch FROM b", "trials")
def unique_rejections(spark, d):
    return artifacts.unique_rejections(_bad(spark, d), ["condition", "epoch"])


@query(
    """WITH f AS (SELECT condition, epoch, bool_or(D > 0.09) AS hot, max(abs(Q)) AS most FROM multich GROUP BY ALL)
SELECT epoch, pos, round(CASE WHEN hot AND most > 40 THEN 0.25 * D + 0.75 * T ELSE Q END, 6) + 0.0 AS Q, round(T, 6) + 0.0 AS T FROM multich JOIN f USING (condition, epoch)""",
    "multich",
)
def repair_flagged_epochs(spark, d):
    rows = views.multich(spark, d).withColumn("hot", F.col("D") > 0.09)
    out = artifacts.repair_flagged_epochs(rows, ["Q", "D", "T"], "hot", 40.0, {"Q": {"D": 0.25, "T": 0.75}})
    return rounded(out.select("epoch", "pos", "Q", "T"), "Q", "T")


@query("WITH " + _EDGE + " SELECT label, x2, y2 FROM (SELECT CASE label WHEN 'FRANCE' THEN 'Fz' WHEN 'CHINA' THEN 'Cz' ELSE label END AS label, x2, y2 FROM l) WHERE label IN ('Fz', 'Cz', 'PERU', 'nowhere')")
def layout_subset(spark, d):
    return layout.subset_layout(layout.rename_in_layout(_grid(spark, d), {"FRANCE": "Fz", "CHINA": "Cz"}), ["Fz", "Cz", "PERU", "nowhere"])


@query(
    """WITH s AS (SELECT epoch, condition, count(*) AS n, min(time) AS lo, max(time) AS hi FROM trials GROUP BY ALL) SELECT min(n) = max(n) AND max(lo) - min(lo) < 1e-9 AND max(hi) - min(hi) < 1e-9 AS same FROM s""",
    "trials",
)
def same_structure(spark, d):
    return average.same_structure(views.trials(spark, d), ["condition", "epoch"])


@query("SELECT condition, epoch, ((pos - 1) // 4 + 1)::INTEGER AS pos, round(value, 6) + 0.0 AS value FROM trials WHERE (pos - 1) % 4 = 0", "trials")
def resample_epochs(spark, d):
    out = epochs.resample(views.trials(spark, d), 4, ["condition", "epoch"], by="pos", triggers=None)
    return rounded(out.select("condition", "epoch", F.col("pos").cast("int").alias("pos"), "value"), "value")


@query("SELECT round(min(time), 6) + 0.0 AS low, round(max(time), 6) + 0.0 AS high FROM trials", "trials")
def time_limits(spark, d):
    return rounded(select.value_limits(views.trials(spark, d), ["time"]), "low", "high")


@query("SELECT DISTINCT condition FROM multich", "multich")
def conditions_present(spark, d):
    return spark.createDataFrame([(c,) for c in average.group_by_condition(views.multich(spark, d))], "condition string")


@query(
    """WITH b AS (SELECT label, inc, azi, sin(inc) * cos(azi) AS x, sin(inc) * sin(azi) AS y, cos(inc) AS z FROM (SELECT n_name AS label, radians(CAST(n_nationkey * 4 AS DOUBLE)) AS inc, radians(CAST(n_nationkey * 14 AS DOUBLE)) AS azi FROM nation)),
s AS (SELECT greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) / 2 AS h FROM b),
p AS (SELECT a.label AS channel, b.label AS neighbour, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / h AS distance FROM b a, b, s WHERE a.label <> b.label)
SELECT channel, neighbour, round(distance, 6) + 0.0 AS distance FROM p WHERE distance <= 0.5"""
)
def layout_neighbours_3d(spark, d):
    k = F.col("n_nationkey").cast("double")
    rows = views.table(spark, d, "nation").select(F.col("n_name").alias("label"), (k * 4).alias("inc"), (k * 14).alias("azi"))
    return rounded(layout.neighbours(layout.cartesian_3d(rows), 0.5, ("x3", "y3", "z3")).select("channel", "neighbour", "distance"), "distance")


@query("SELECT n::INTEGER AS n, floor(sqrt(n))::INTEGER AS n_rows, ceil(n / floor(sqrt(n)))::INTEGER AS n_columns FROM range(1, 61) r(n)")
def best_rectangles(spark, d):
    return spark.createDataFrame([(n, *layout.best_rectangle(n)) for n in range(1, 61)], "n int, n_rows int, n_columns int")


# Lists as users write them, and the numbers they stand for.
@query("SELECT * FROM (VALUES ('1,3:5;8', '1 3 4 5 8'), ('2 2, 1', '1 2'), ('7', '7'), ('3:3', '3')) v(\"text\", numbers)")
def number_lists(spark, d):
    return spark.createDataFrame([(t, " ".join(map(str, select.parse_ints(t)))) for t in ("1,3:5;8", "2 2, 1", "7", "3:3")], "text string, numbers string")
