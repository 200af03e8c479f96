"""Hand-computed cases, invariants and error paths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplewright.operators import artifacts, average, channels, epochs, layout, measure, process, select, triggers
from samplewright.sources import synthetic


def rec(spark, codes):
    return spark.createDataFrame([(1, i + 1, float(i), c) for i, c in enumerate(codes)], "participant int, sample long, time double, triggers int")


def test_onset_cleaning(spark):
    got = triggers.clean(rec(spark, [0, 1, 1, 0, 0, 2, 2, 2, 0, 0])).orderBy("sample").toPandas()["triggers"].tolist()
    assert got == [0, 1, 0, 0, 0, 2, 0, 0, 0, 0]
    assert triggers.clean(rec(spark, [3, 2, 0])).orderBy("sample").toPandas()["triggers"].tolist() == [3, 0, 0]


def test_sequences_skip_zeros(spark):
    starts = lambda codes, seq: sorted(r["start"] for r in triggers.search(rec(spark, codes), seq).collect())
    assert starts([1, 0, 2, 3, 1, 0, 2, 3], [1, 2]) == [1, 5]
    assert starts([0, 1, 1, 0, 2, 2], 1) == [2]
    assert starts([1, 2, 9, 1, 5, 9], [1, triggers.ANY, 9]) == [1, 4]
    assert starts([1, 0, 4, 0], [range(1, 3), 4]) == [1]
    with pytest.raises(ValueError):
        triggers.search(rec(spark, [1]), [triggers.ANY, 1])


def test_markers_to_codes(spark):
    m = spark.createDataFrame([("f", 1, "", 1), ("f", 2, "S 2", 5), ("f", 3, "S 1", 5), ("f", 4, "S 2", 99)], "file string, marker int, description string, position int")
    got = sorted(tuple(r) for r in triggers.markers_to_codes(m, ["file"], n_samples=50).collect())
    assert got == [("f", 1, 1, ""), ("f", 5, 2, "S 1")]


def test_epochs_keep_gaps_and_rezero(spark):
    df = synthetic.with_triggers(spark, {2: 1, 300: 1, 700: 1})
    out = epochs.extract(df, [epochs.EpochCondition("a", ((1,),))], (-0.1, 0.2), 1000)
    got = out.groupBy("epoch").agg(F.min("time").alias("lo"), F.max("time").alias("hi"), F.count("*").alias("n")).orderBy("epoch").collect()
    assert [(r["epoch"], round(r["lo"], 6), round(r["hi"], 6), r["n"]) for r in got] == [(2, -0.1, 0.2, 301), (3, -0.1, 0.2, 301)]
    with pytest.raises(ValueError):
        epochs.extract(df, [], (0.1, 0.2), 1000)


def test_conditions_validate_and_parse():
    with pytest.raises(ValueError):
        epochs.EpochCondition("a", ((1, 2),), reference_index=3)
    with pytest.raises(ValueError):
        epochs.EpochCondition("a", ((1,),), after=1, before=2)
    with pytest.raises(ValueError):
        epochs.EpochCondition("a", ((1, 2),), timing_pairs=((1, 2),), min_interval=2, max_interval=1)
    c = epochs.parse_conditions({"epochs": {"conditions": [{"name": "x", "trigger_sequences": [[1, "any", "3-5"]]}]}})[0]
    assert c.trigger_sequences == ((1, "any", range(3, 6)),)


def test_mirror_round_trip(spark):
    df = synthetic.trials(spark, n_epochs=2, n=21, n_channels=1)
    keys = ["participant", "condition", "epoch"]
    want = df.orderBy("epoch", "pos").toPandas()
    for side, n in (("pre", 41), ("post", 41), ("both", 61)):
        m = epochs.mirror(df, keys, side)
        assert m.count() == 2 * n
        steps = np.diff(m.filter("epoch = 1").orderBy("pos").toPandas()["time"])
        assert np.allclose(steps, 0.001)
        back = epochs.unmirror(m, keys, side).orderBy("epoch", "pos").toPandas()
        assert np.allclose(back["Ch1"], want["Ch1"]) and np.allclose(back["time"], want["time"])


def test_mirror_deals_larger_tables_to_more_tasks(spark):
    most = []
    for n in (600, 2400):
        back = epochs.unmirror(epochs.mirror(synthetic.trials(spark, n_epochs=n, n=500, n_channels=1), ["epoch"]), ["epoch"])
        parts = back.groupBy(F.spark_partition_id()).count().toPandas()["count"]
        assert parts.sum() == n * 500
        most.append(parts.max())
    assert most[1] < 2 * most[0]
    odd = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 2, 0.5, None), (1, None, None, 3.0)], "epoch int, pos int, time double, v double")
    got = epochs.mirror(odd, ["epoch"]).orderBy("pos").collect()
    assert [(r["pos"], r["time"], r["v"]) for r in got] == [(None, None, 3.0), (1, -0.5, None), (2, 0.0, 1.0), (3, 0.5, None), (4, 1.0, 1.0)]


def test_resample_moves_triggers(spark):
    out = epochs.resample(rec(spark, [0, 0, 0, 7, 0, 0, 0, 9]), 4, ["participant"]).orderBy("sample").toPandas()
    assert out["sample"].tolist() == [1, 2] and out["triggers"].tolist() == [7, 9]


def test_gfp_of_known_maps(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (2, 2.0, 3.0, 4.0), (3, 3.0, 4.0, 5.0)], "pos int, a double, b double, c double")
    out = channels.gfp_and_dissimilarity(df, ["a", "b", "c"]).toPandas()
    assert np.allclose(out["gfp"], np.sqrt(2 / 3))
    n = channels.gfp(df.withColumn("a", F.col("a") * F.col("pos")), ["a", "b", "c"], normalise=True).toPandas()["gfp"]
    assert n.min() == 0 and n.max() == 100


def test_averages(spark):
    df = synthetic.trials(spark, n_epochs=4, n=20, participants=3, conditions=(1, 2))
    erps = average.average_epochs(df, ["participant", "condition"], ["Ch1"])
    assert erps.agg(F.min("n_epochs"), F.max("n_epochs")).first() == (4, 4)
    g = average.grand_average(erps, ["Ch1"])
    assert g.first()["n_epochs"] == 12 and g.count() == 40
    j = average.jackknife(erps.withColumn("Ch1", F.col("participant").cast("double")), ["Ch1"]).select("participant", "Ch1").distinct()
    assert {(r[0], r[1]) for r in j.collect()} == {(1, 2.5), (2, 2.0), (3, 1.5)}
    d = average.condition_difference(erps, [(2, 1), (1, 9)], ["Ch1"]).toPandas()
    assert len(d) == 60 and set(d["condition_name"]) == {"difference_2_1"}
    assert average.lateral_pairs(["C3", "C4", "Fz", "O1", "P2"]) == [("C3", "C4")]
    l1 = average.lateralised(erps.withColumnsRenamed({"Ch1": "C3"}).withColumn("C4", F.lit(1.0)), [(1, 2)], ["C3", "C4"]).toPandas()
    assert np.allclose(l1["C3"], -l1["C4"])


def test_measures_of_a_sine(spark):
    df = synthetic.windowed_sines(spark, 1, (0.0, 1.0), 1000, [1.0], [2.0], [(0.0, 1.1)])
    m = measure.areas(df, ["epoch"]).first()
    assert abs(m["integral"]) < 0.01 and abs(m["rectified_area"] - 4 / np.pi) < 0.01 and abs(m["positive_area"] - m["negative_area"]) < 0.01
    p = measure.peaks(df, ["epoch"]).first()
    assert abs(p["max_peak_amplitude"] - 2) < 1e-6 and abs(p["max_peak_latency"] - 0.25) < 1e-9 and abs(p["peak_to_peak_latency"] - 0.5) < 1e-9
    half = df.filter("time <= 0.5")
    assert abs(measure.fractional_area(half, ["epoch"]).first()[1] - 0.25) < 2e-3
    assert abs(measure.fractional_peak(half, ["epoch"]).first()[1] - 1 / 12) < 2e-3
    assert abs(measure.fractional_peak(half, ["epoch"], direction="offset").first()[1] - 5 / 12) < 2e-3
    with pytest.raises(ValueError):
        measure.measure(df, "median")
    for kind in measure.MEASURES:
        assert measure.measure(df, kind, ["epoch"], (0.1, 0.9), (0.0, 0.1)).count() == 1


def test_selection():
    names = ["Fp1", "Fz", "Cz", "vEOG"]
    assert select.channels("Cz", "Fp1")(names) == ["Cz", "Fp1"]
    assert select.channels(range(1, 3))(names) == ["Fp1", "Fz"]
    assert select.channels_not(lambda n: n.endswith("EOG"))(names) == names[:3]
    assert select.parse_ints("1,3:5;8") == [1, 3, 4, 5, 8] and select.extract_int("a1b2") == 12
    with pytest.raises(ValueError):
        select.parse_ints("1.5")


def test_roles_and_columns(spark):
    df = spark.createDataFrame([(0.1, 1, 1.0, 2.0, True)], "time double, sample int, A double, B double, bad boolean")
    r = select.Roles.of(df, ["A", "B"])
    assert (r.meta, r.channels, r.extra) == (("time", "sample"), ("A", "B"), ("bad",))
    assert select.select_channels(df, r, select.channels("B"), include_extra=False).columns == ["time", "sample", "B"]
    with pytest.raises(ValueError):
        select.rename_channels(df, {"A": "B"})
    with pytest.raises(ValueError):
        select.drop_channels(df, "X")
    with pytest.raises(ValueError):
        process.rereference(df, ["Q"], ["A", "B"])
    assert process.rereference(df, "none", ["A", "B"]) is df


def test_participant_ids(spark):
    df = spark.createDataFrame([("/x/12_sub7_b.bdf",), ("/x/abc.bdf",)], "p string")
    a, b = (r[0] for r in df.select(select.participant_of("p")).collect())
    assert a == 7 and 0 <= b < 10000


def test_extremes_rejection_and_repair(spark):
    df = synthetic.trials(spark, n_epochs=5, n=30, n_channels=3).withColumn("Ch1", F.when((F.col("epoch") == 2) & (F.col("pos") < 5), 300.0).otherwise(F.col("Ch1")))
    names = ["Ch1", "Ch2", "Ch3"]
    bad = artifacts.bad_epochs(df, names, 0, 100)
    assert [(r["channel"], r["epoch"], r["reasons"]) for r in bad.collect()] == [("Ch1", 2, ["abs_threshold"])]
    assert artifacts.reject(df, bad).select("epoch").distinct().count() == 4
    w = {"Ch1": {"Ch2": 0.5, "Ch3": 0.5}}
    fixed = artifacts.repair_epochs(df, names, bad.select("condition", "epoch", "channel"), w)
    assert fixed.filter("epoch = 2").agg(F.max(F.abs(F.col("Ch1") - F.col("Ch2")))).first()[0] < 1e-12
    flagged = artifacts.extreme_values(df, names, 100, out="hot")
    assert artifacts.repair_flagged_epochs(flagged, names, "hot", 100, w).agg(F.max("Ch1")).first()[0] < 1


def test_spherical_weights_reproduce_a_constant():
    rng = np.random.default_rng(0)
    w = layout.spherical_weights(rng.normal(size=(20, 3)), rng.normal(size=(3, 3)))
    assert np.allclose(w.sum(axis=1), 1, atol=1e-6)


def test_topography_and_grid():
    pts = np.array([[0, 0], [0.5, 0], [0, 0.5], [-0.5, 0], [0, -0.5]])
    for m in ("thin_plate", "inverse_distance", "nearest"):
        assert np.allclose(layout.topography_grid([2.0] * 5, pts, 5, m), 2.0)
    assert layout.best_rectangle(10) == (3, 4)


def test_empty_tables_give_empty_results(spark):
    none = rec(spark, [1]).filter("false")
    assert triggers.count(none).count() == 0 and triggers.search(none, [1, 2]).count() == 0
    assert epochs.mark_trigger_windows(none, [1], (-1, 1), 1).count() == 0
    long = none.select("participant", "time", F.lit(1.0).alias("value"))
    assert measure.peaks(long, ["participant"]).count() == 0


def test_settings_chain(spark):
    from samplewright.operators.settings import Settings, apply_settings

    df = synthetic.continuous(spark, n=500, rate=250, n_channels=3)
    w = {"Ch3": {"Ch1": 0.5, "Ch2": 0.5}}
    out = apply_settings(df, Settings(lowpass=40, reference="avg", repaired=("Ch3",), regions=((0.1, 0.2),)), ["Ch1", "Ch2", "Ch3"], 250, weights=w)
    row = out.agg(F.max(F.abs(F.col("Ch3") - (F.col("Ch1") + F.col("Ch2")) / 2)).alias("gap"), F.count_if("is_selected_region").alias("n")).first()
    assert row["gap"] < 1e-9 and row["n"] == 26
    with pytest.raises(ValueError):
        apply_settings(df, Settings(removed_components=(0,)), ["Ch1"], 250)


def test_neighbour_lists_are_toml(spark):
    import tomllib

    pos = spark.createDataFrame([("A", 0.0, 0.0), ("B", 1.0, 0.0), ("C", 0.0, 2.0)], "label string, x2 double, y2 double")
    got = tomllib.loads(layout.neighbours_toml(layout.neighbours(pos, 2.0)))
    assert got["A"]["channels"] == ["B", "C"] and abs(sum(got["A"]["weights"]) - 1) < 1e-5
    assert layout.rename_in_layout(pos, {"A": "B", "B": "A"}).first()["label"] == "B" and layout.subset_layout(pos, ["A"]).count() == 1
