"""Queries on selection, triggers, epochs and per-row transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import epochs, process, select, triggers
from ..operators.epochs import EpochCondition
from ..sources import views
from .registry import query, rounded

PC = ("participant", "condition", "pos")


def erp(spark, sf_dir):
    from ..operators.average import average_epochs

    return average_epochs(views.trials(spark, sf_dir), ["participant", "condition"], ["value"])


def merp(spark, sf_dir):
    from ..operators.average import average_epochs

    rows = views.multich(spark, sf_dir).withColumn("time", F.col("pos").cast("double"))
    return average_epochs(rows, ["participant", "condition"], list(views.CHANNELS))


@query("SELECT participant, sample, triggers FROM (SELECT *, triggers AS t0, lag(triggers, 1, 0) OVER (PARTITION BY participant ORDER BY sample) AS b FROM recording) WHERE t0 > b", "recording")
def trigger_onsets(spark, d):
    return triggers.clean(views.recording(spark, d)).filter("triggers <> 0").select("participant", "sample", "triggers")


@query("SELECT triggers AS trigger, count(*) AS count FROM recording WHERE triggers <> 0 GROUP BY 1", "recording")
def trigger_count(spark, d):
    return triggers.count(views.recording(spark, d))


@query(
    "SELECT triggers AS trigger, count(*) AS raw, count(*) FILTER (triggers > b) AS cleaned FROM (SELECT *, lag(triggers, 1, 0) OVER (PARTITION BY participant ORDER BY sample) AS b FROM recording) WHERE triggers <> 0 GROUP BY 1",
    "recording",
)
def trigger_count_raw_clean(spark, d):
    return triggers.count_raw_and_clean(views.recording(spark, d))


@query("SELECT participant, sample AS start FROM (SELECT *, lag(triggers) OVER (PARTITION BY participant ORDER BY sample) AS b FROM recording) WHERE triggers = 2 AND (b IS NULL OR b <> 2)", "recording")
def trigger_value_search(spark, d):
    return triggers.search(views.recording(spark, d), 2)


@query(
    "SELECT participant, sample AS start FROM (SELECT *, lag(triggers) OVER (PARTITION BY participant ORDER BY sample) AS b FROM recording) WHERE triggers BETWEEN 2 AND 3 AND (b IS NULL OR b <> triggers)",
    "recording",
)
def trigger_range_search(spark, d):
    return triggers.search(views.recording(spark, d), [range(2, 4)])


_SEQ = """WITH w AS (SELECT *, lag(triggers) OVER o AS b, row_number() OVER o AS i, count(*) OVER (PARTITION BY participant) AS n FROM recording WINDOW o AS (PARTITION BY participant ORDER BY sample)),
z AS (SELECT *, lead(triggers, 1) OVER o AS n1, lead(triggers, 2) OVER o AS n2 FROM w WHERE triggers <> 0 WINDOW o AS (PARTITION BY participant ORDER BY sample))"""


@query(_SEQ + " SELECT participant, sample AS start FROM z WHERE triggers = 1 AND (b IS NULL OR b <> 1) AND i <= n - 1 AND n1 = 2", "recording")
def trigger_sequence_search(spark, d):
    return triggers.search(views.recording(spark, d), [1, 2])


@query(
    _SEQ
    + """ SELECT DISTINCT participant, sample AS start FROM z WHERE (triggers = 1 AND (b IS NULL OR b <> 1) AND i <= n - 2 AND n1 IS NOT NULL AND n2 = 3)
    OR (triggers = 4 AND (b IS NULL OR b <> 4) AND i <= n - 1 AND n1 BETWEEN 1 AND 2)""",
    "recording",
)
def trigger_any_sequence_search(spark, d):
    return triggers.search_any(views.recording(spark, d), [[1, triggers.ANY, 3], [4, range(1, 3)]])


@query('SELECT participant, time, triggers, time - lag(time) OVER (PARTITION BY participant ORDER BY time) AS "interval" FROM recording WHERE triggers <> 0', "recording")
def trigger_intervals(spark, d):
    return triggers.intervals(views.recording(spark, d))


@query(
    "SELECT r.participant, r.sample, EXISTS (SELECT 1 FROM recording t WHERE t.participant = r.participant AND t.triggers IN (3, 4) AND r.sample BETWEEN t.sample - 2 AND t.sample + 3) AS epoch_window FROM recording r", "recording"
)
def mark_trigger_windows(spark, d):
    return epochs.mark_trigger_windows(views.recording(spark, d), [3, 4], (-2.0, 3.0), 1.0).select("participant", "sample", "epoch_window")


_ZERO = """WITH p AS (SELECT *, lag(triggers) OVER o AS b, row_number() OVER o AS i, count(*) OVER (PARTITION BY participant) AS n FROM recording WINDOW o AS (PARTITION BY participant ORDER BY sample)),
q AS (SELECT *, lead(triggers, 1) OVER (PARTITION BY participant ORDER BY sample) AS n1 FROM p WHERE triggers <> 0),
s AS (SELECT participant, 1 AS condition, 'click_error' AS condition_name, sample AS start, sample + 1 AS zero FROM q WHERE triggers = 1 AND (b IS NULL OR b <> 1) AND i <= n - 1 AND n1 = 2
  UNION ALL SELECT participant, 2, 'purchase_after_signup', sample, sample FROM q x WHERE triggers = 3 AND (b IS NULL OR b <> 3) AND i <= n
    AND EXISTS (SELECT 1 FROM recording y WHERE y.participant = x.participant AND y.triggers = 4 AND y.sample < x.sample)),
e AS (SELECT *, row_number() OVER (PARTITION BY participant, condition ORDER BY start) AS epoch FROM s),
l AS (SELECT participant, min(sample) AS a, max(sample) AS z FROM recording GROUP BY 1)"""
CONDITIONS = (EpochCondition("click_error", ((1, 2),), reference_index=2), EpochCondition("purchase_after_signup", ((3,),), after=4))


@query(
    _ZERO
    + """ SELECT r.participant, e.condition, e.condition_name, CAST(e.epoch AS INTEGER) AS epoch, r.sample - (e.zero - 2) + 1 AS pos, CAST(r.sample - e.zero AS DOUBLE) AS time, round(r.value, 6) + 0.0 AS value
    FROM e JOIN l ON e.participant = l.participant AND e.zero - 2 >= l.a AND e.zero + 3 <= l.z JOIN recording r ON r.participant = e.participant AND r.sample BETWEEN e.zero - 2 AND e.zero + 3""",
    "recording",
)
def extract_epochs(spark, d):
    out = epochs.extract(views.recording(spark, d), CONDITIONS, (-2.0, 3.0), 1.0)
    return rounded(out.select("participant", "condition", "condition_name", "epoch", "pos", "time", "value"), "value")


@query(_ZERO + " SELECT participant, condition, CAST(epoch AS INTEGER) AS epoch, start, zero FROM e", "recording")
def epoch_zero_points(spark, d):
    rec = views.recording(spark, d)
    parts = [epochs.zero_points(rec, c, 1.0).withColumn("condition", F.lit(i)) for i, c in enumerate(CONDITIONS, 1)]
    return parts[0].unionByName(parts[1]).select("participant", "condition", "epoch", "start", "zero")


@query("SELECT participant, condition, epoch, pos, time, round(value - avg(value) FILTER (time BETWEEN 0 AND 0.25) OVER (PARTITION BY epoch), 6) + 0.0 AS value FROM trials", "trials")
def baseline(spark, d):
    return rounded(process.baseline(views.trials(spark, d), ["epoch"], ["value"], (0.0, 0.25)), "value")


@query("SELECT epoch, pos, round(Q - (Q + D + T) / 3, 6) + 0.0 AS Q, round(D - (Q + D + T) / 3, 6) + 0.0 AS D, round(T - (Q + D + T) / 3, 6) + 0.0 AS T FROM multich", "multich")
def rereference(spark, d):
    out = process.rereference(views.multich(spark, d).select("epoch", "pos", "Q", "D", "T"), "avg", ["Q", "D", "T"])
    return rounded(out, "Q", "D", "T")


_MIRROR = """WITH m AS (SELECT epoch, 63 + pos AS pos, time, value FROM trials UNION ALL SELECT epoch, 65 - pos, time + (2 - 2 * pos) / 64.0::DOUBLE, value FROM trials WHERE pos > 1
  UNION ALL SELECT epoch, 63 + 128 - pos, time + (128 - 2 * pos) / 64.0::DOUBLE, value FROM trials WHERE pos < 64)"""


@query(_MIRROR + " SELECT epoch, CAST(pos AS INTEGER) AS pos, round(time, 6) + 0.0 AS time, round(value, 6) + 0.0 AS value FROM m", "trials")
def mirror(spark, d):
    out = epochs.mirror(views.trials(spark, d).select("epoch", "pos", "time", "value"), ["epoch"])
    return rounded(out.withColumn("pos", F.col("pos").cast("int")), "time", "value")


@query("SELECT epoch, pos, round(value, 6) + 0.0 AS value FROM trials", "trials")
def mirror_round_trip(spark, d):
    out = epochs.unmirror(epochs.mirror(views.trials(spark, d).select("epoch", "pos", "time", "value"), ["epoch"]), ["epoch"])
    return rounded(out.select("epoch", F.col("pos").cast("int").alias("pos"), "value"), "value")


@query(
    """WITH r AS (SELECT *, sample AS i, count(*) OVER (PARTITION BY participant) AS n FROM recording),
m AS (SELECT participant, least((n - 1) // 4 + 1, greatest(1, CAST(round_even(i / 4.0, 0) AS BIGINT))) AS k, arg_max(triggers, i) AS t FROM r WHERE triggers <> 0 GROUP BY 1, 2)
SELECT r.participant, (r.i - 1) // 4 + 1 AS sample, time, coalesce(t, 0) AS triggers, round(value, 6) + 0.0 AS value FROM r LEFT JOIN m ON r.participant = m.participant AND (r.i - 1) // 4 + 1 = m.k WHERE (r.i - 1) % 4 = 0""",
    "recording",
)
def resample(spark, d):
    return rounded(epochs.resample(views.recording(spark, d), 4, ["participant"]), "value")


@query(
    """WITH s AS (SELECT participant, condition, epoch, pos, time - (epoch % 8) / 64.0::DOUBLE AS t, value FROM trials),
w AS (SELECT participant, condition, max(lo) AS a, min(hi) AS b FROM (SELECT participant, condition, epoch, min(t) AS lo, max(t) AS hi FROM s GROUP BY ALL) GROUP BY ALL),
x AS (SELECT s.*, w.a, row_number() OVER (PARTITION BY epoch ORDER BY t) AS p FROM s JOIN w USING (participant, condition) WHERE t > a - 1 / 128.0 AND t <= b + 1 / 128.0)
SELECT participant, condition, epoch, CAST(p AS INTEGER) AS pos, round(a + (p - 1) / 64.0::DOUBLE, 6) + 0.0 AS time, round(value, 6) + 0.0 AS value FROM x""",
    "trials",
)
def realign(spark, d):
    rows = views.trials(spark, d).withColumn("rt", (F.col("epoch") % 8) / F.lit(64.0))
    return rounded(epochs.realign(rows, "rt").drop("rt"), "time", "value").select("participant", "condition", "epoch", "pos", "time", "value")


@query("SELECT participant, epoch, pos, round((Q + D) / 2, 6) + 0.0 AS Q_D, round((Q + P + D + T) / 4, 6) + 0.0 AS avg, round(Q - (D + T) / 2, 6) + 0.0 AS diff FROM multich", "multich")
def channel_average_difference(spark, d):
    out = select.channel_average(views.multich(spark, d), [["Q", "D"], list(views.CHANNELS)], all_channels=views.CHANNELS)
    out = select.channel_difference(out, ["Q"], ["D", "T"])
    return rounded(out.select("participant", "epoch", "pos", "Q_D", "avg", "diff"), "Q_D", "avg", "diff")


@query("SELECT epoch, pos, Q > 25 AND D > 0.05 AS both, Q > 25 OR D > 0.05 AS either, NOT (Q > 25 AND D > 0.05) AS nand, NOT (Q > 25 OR D > 0.05) AS nor FROM multich", "multich")
def combine_flags(spark, d):
    out = views.multich(spark, d).select("epoch", "pos", (F.col("Q") > 25).alias("a"), (F.col("D") > 0.05).alias("b"))
    for how, name in (("and", "both"), ("or", "either"), ("nand", "nand"), ("nor", "nor")):
        out = select.combine_flags(out, ["a", "b"], how, name)
    return out.drop("a", "b")


@query("SELECT participant, condition, epoch, pos, time, round(value, 6) + 0.0 AS value FROM trials WHERE time BETWEEN 0.25 AND 0.5 AND condition IN (1, 3) AND participant IN (2, 4, 6) AND value > 0", "trials")
def subset(spark, d):
    return rounded(select.subset(views.trials(spark, d), (0.25, 0.5), F.col("value") > 0, conditions=[1, 3], participants=[2, 4, 6]), "value")


@query("SELECT participant, condition, epoch, pos, Q AS D, D AS Q FROM multich", "multich")
def rename_swap(spark, d):
    return select.rename_channels(views.multich(spark, d).select("participant", "condition", "epoch", "pos", "Q", "D"), {"Q": "D", "D": "Q"})


@query("SELECT round(least(min(Q), min(D), min(T)), 6) + 0.0 AS low, round(greatest(max(Q), max(D), max(T)), 6) + 0.0 AS high FROM multich", "multich")
def value_limits(spark, d):
    return rounded(select.value_limits(views.multich(spark, d), ["Q", "D", "T"]), "low", "high")


@query("SELECT * FROM (SELECT participant, sample, time, triggers, round(value, 6) + 0.0 AS value FROM recording ORDER BY participant, sample LIMIT 5)", "recording")
def head(spark, d):
    return rounded(select.head(views.recording(spark, d), by=("participant", "sample")), "value")


@query("SELECT * FROM (SELECT participant, sample, time, triggers, round(value, 6) + 0.0 AS value FROM recording ORDER BY participant DESC, sample DESC LIMIT 5)", "recording")
def tail(spark, d):
    return rounded(select.tail(views.recording(spark, d), by=("participant", "sample")), "value")


@query(
    """WITH s AS (SELECT epoch, pos, time, value, regr_slope(value, time) OVER w AS b, avg(value) OVER w AS my, avg(time) OVER w AS mx FROM trials WINDOW w AS (PARTITION BY epoch))
SELECT epoch, pos, round(value - (my + b * (time - mx)), 6) + 0.0 AS detrended FROM s""",
    "trials",
)
def detrend(spark, d):
    return rounded(select.detrend(views.trials(spark, d), ["epoch"]).select("epoch", "pos", "detrended"), "detrended")


@query("SELECT participant, sample, round(lead(value, 2) OVER (PARTITION BY participant ORDER BY sample) - value, 6) + 0.0 AS change FROM recording", "recording")
def consecutive(spark, d):
    return rounded(select.consecutive(views.recording(spark, d), ["participant"], "sample", "value", 2).select("participant", "sample", "change"), "change")


@query(
    "SELECT participant, min(sample) AS first, max(sample) AS last FROM (SELECT participant, sample, sample - row_number() OVER (PARTITION BY participant ORDER BY sample) AS g FROM recording WHERE triggers <> 0) GROUP BY participant, g", "recording"
)
def split_groups(spark, d):
    return select.split_groups(views.recording(spark, d).filter("triggers <> 0"), ["participant"], "sample")


@query("SELECT epoch, min(pos) FILTER (time >= 0.2) AS start, max(pos) FILTER (time <= 0.7) AS \"end\" FROM trials GROUP BY epoch", "trials")
def index_range(spark, d):
    return select.index_range(views.trials(spark, d), ["epoch"], (0.2, 0.7))


@query(
    """WITH q AS (SELECT * FROM (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.77::DOUBLE)) v(wanted)),
x AS (SELECT epoch, wanted, pos, time, row_number() OVER (PARTITION BY epoch, wanted ORDER BY abs(time - wanted), pos) AS r FROM trials, q) SELECT epoch, wanted, pos, time FROM x WHERE r = 1""",
    "trials",
)
def nearest_samples(spark, d):
    return select.nearest(views.trials(spark, d), ["epoch"], [0.1, 0.5, 0.77])


@query("SELECT epoch, pos FROM trials WHERE (time BETWEEN 0.1 AND 0.2) OR (time BETWEEN 0.6 AND 0.65)", "trials")
def samples_in_regions(spark, d):
    return views.trials(spark, d).filter(select.in_regions("time", [(0.1, 0.2), (0.6, 0.65)])).select("epoch", "pos")


@query("SELECT c_custkey, c_name, 'Customer#' || lpad(substr(c_name, 10), CAST(greatest(10, length(substr(c_name, 10))) AS INTEGER), '0') AS key, CAST(substr(c_name, 10) AS BIGINT) AS participant FROM customer")
def natural_keys(spark, d):
    rows = views.table(spark, d, "customer").select("c_custkey", "c_name")
    return rows.select("c_custkey", "c_name", select.natural_key("c_name").alias("key"), select.participant_of("c_name").alias("participant"))


@query("SELECT epoch, pos, round(avg(value) OVER (PARTITION BY epoch ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) + 0.0 AS value FROM trials", "trials")
def moving_mean(spark, d):
    return rounded(process.moving_mean(views.trials(spark, d), ["epoch"], "pos", ["value"], 5).select("epoch", "pos", "value"), "value")


@query("SELECT dense_rank() OVER (ORDER BY condition) AS number, condition, participant, epoch FROM (SELECT DISTINCT condition, participant, epoch FROM trials)", "trials")
def numbered_conditions(spark, d):
    rows = views.trials(spark, d).select("condition", "participant", "epoch").distinct()
    number = select.numbered(rows.select("condition").distinct(), "condition").withColumn("number", F.col("number").cast("long"))
    return rows.join(number, "condition").select("number", "condition", "participant", "epoch")
