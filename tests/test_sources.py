"""Readers and sinks round-trip files written by the tests."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplewright.plans.preprocess import preprocess
from samplewright.operators.epochs import EpochCondition
from samplewright.sources import binary, config, synthetic, tables
from samplewright.streaming import epoching


def bdf(path, x, codes, rate):
    n = len(x) + 1
    pad = lambda s, w: str(s).encode().ljust(w)
    head = b"\xffBIOSEMI" + pad("", 80) + pad("", 80) + pad("01.01.20", 8) + pad("00.00.00", 8) + pad(256 * (n + 1), 8) + pad("24BIT", 44) + pad(x.shape[1] // rate, 8) + pad(1, 8) + pad(n, 4)
    labels = [*[f"A{i + 1}" for i in range(len(x))], "Status"]
    for values, w in ((labels, 16), ([""] * n, 80), (["uV"] * n, 8), ([-8388608] * n, 8), ([8388607] * n, 8), ([-8388608] * n, 8), ([8388607] * n, 8), ([""] * n, 80), ([rate] * n, 8), ([""] * n, 32)):
        head += b"".join(pad(v, w) for v in values)
    body = b""
    for r in range(x.shape[1] // rate):
        for row in [*x, codes]:
            for v in row[r * rate : (r + 1) * rate]:
                body += struct.pack("<i", int(v))[:3]
    path.write_bytes(head + body)


def test_bdf(spark, tmp_path):
    x = np.arange(-40, 40).reshape(2, 40) * 1000
    codes = np.zeros(40, int)
    codes[5:8] = 3
    bdf(tmp_path / "s1.bdf", x, codes, 20)
    out = binary.read_raw(spark, str(tmp_path / "s1.bdf"), ["A2", "A1"]).orderBy("sample").toPandas()
    assert out["A1"].tolist() == x[0].tolist() and out["A2"].tolist() == x[1].tolist()
    assert out.loc[out["triggers"] > 0, ["sample", "triggers"]].values.tolist() == [[6, 3]] and out["time"][20] == 1.0


def test_brainvision(spark, tmp_path):
    x = np.arange(60, dtype="<i2").reshape(20, 3)
    (tmp_path / "r.eeg").write_bytes(x.tobytes())
    (tmp_path / "r.vhdr").write_text("[Common Infos]\nNumberOfChannels=3\nSamplingInterval=2000\nDataOrientation=MULTIPLEXED\n[Binary Infos]\nBinaryFormat=INT_16\n[Channel Infos]\nCh1=Fp1,,0.5\nCh2=Fz,,1\nCh3=C\\1z,,2\n")
    (tmp_path / "r.vmrk").write_text("[Marker Infos]\nMk1=New Segment,,1,1,0\nMk2=Stimulus,S 2,5,1,0\nMk3=Stimulus,S 1,9,1,0\nMk4=Stimulus,S 1,99,1,0\n")
    out = binary.read_raw(spark, str(tmp_path / "r.vhdr"), ["Fp1", "C,z"]).orderBy("sample").toPandas()
    assert out["Fp1"].tolist() == (x[:, 0] * 0.5).tolist() and out["C,z"].tolist() == (x[:, 2] * 2.0).tolist()
    assert out.loc[out["triggers"] > 0, ["sample", "triggers", "triggers_info"]].values.tolist() == [[1, 1, ""], [5, 3, "S 2"], [9, 2, "S 1"]]
    assert binary.read_brainvision_markers(spark, str(tmp_path)).count() == 4
    with pytest.raises(ValueError):
        binary.read_raw(spark, "x.edf", [])


def mat(**variables):
    def element(kind, raw):
        return struct.pack("<II", kind, len(raw)) + raw + b"\0" * (-len(raw) % 8)

    def matrix(name, v):
        head = lambda cls, shape: element(6, struct.pack("<II", cls, 0)) + element(5, struct.pack(f"<{len(shape)}i", *shape)) + element(1, name.encode())
        if isinstance(v, str):
            body = head(4, (1, len(v))) + element(4, v.encode("utf-16-le"))
        elif isinstance(v, dict):
            names = b"".join(k.encode().ljust(32, b"\0") for k in v)
            body = head(2, (1, 1)) + element(5, struct.pack("<i", 32)) + element(1, names) + b"".join(matrix("", x) for x in v.values())
        elif isinstance(v, list):
            body = head(1, (1, len(v))) + b"".join(matrix("", x) for x in v)
        else:
            a = np.atleast_2d(np.asarray(v, float))
            body = head(6, a.shape) + element(9, a.tobytes(order="F"))
        return element(14, body)

    return b"MATLAB 5.0".ljust(124) + b"\x00\x01IM" + b"".join(matrix(k, v) for k, v in variables.items())


def test_eeglab_and_fieldtrip(spark, tmp_path):
    x = np.arange(24.0).reshape((2, 4, 3), order="F")
    eeg = {"nbchan": 2, "pnts": 4, "trials": 3, "srate": 4, "xmin": -0.5, "data": "r.fdt", "chanlocs": [{"labels": "Fz", "theta": 0.0, "radius": 0.25}, {"labels": "Cz", "theta": 90.0, "radius": 0.0}], "epoch": [{"eventtype": "b"}, {"eventtype": "a"}, {"eventtype": "b"}]}
    (tmp_path / "r.set").write_bytes(mat(EEG=eeg))
    (tmp_path / "r.fdt").write_bytes(x.astype("<f4").tobytes(order="F"))
    out = binary.read_eeglab(spark, str(tmp_path), ["Cz", "Fz"]).orderBy("epoch", "pos").toPandas()
    assert out["Fz"].tolist() == x[0].T.ravel().tolist() and out["time"][1] == -0.25 and set(out["kind"]) == {"epochs"}
    assert out["triggers_info"].tolist()[::4] == ["b", "a", "b"]
    t = binary.eeglab_tables(binary.read_mat((tmp_path / "r.set").read_bytes()), (tmp_path / "r.fdt").read_bytes())
    assert t["layout"] == [("Fz", 45.0, 90.0), ("Cz", 0.0, 0.0)]
    (tmp_path / "f.mat").write_bytes(mat(data={"label": ["Fz", "Cz"], "trial": [x[:, :, 0], x[:, :, 1]], "time": [np.arange(4) / 4.0, np.arange(4) / 4.0]}))
    ft = binary.read_fieldtrip(spark, str(tmp_path / "f.mat"), ["Fz"]).orderBy("epoch", "pos").toPandas()
    assert ft["Fz"].tolist() == [*x[0, :, 0], *x[0, :, 1]]


def test_text_sources_and_store(spark, tmp_path):
    (tmp_path / "l.csv").write_text("label,inc,azi\nFp1,-92,-72\nCz,0,0\n")
    assert {tuple(r) for r in tables.read_layout(spark, str(tmp_path / "l.csv")).collect()} == {("Fp1", -92.0, -72.0), ("Cz", 0.0, 0.0)}
    (tmp_path / "e.csv").write_text("trial,time,A\n" + "".join(f"{t},{i / 100},{t * i}\n" for t in (1, 2) for i in range(4)))
    e = tables.read_epochs_csv(spark, str(tmp_path / "e.csv"))
    assert e.first()["rate"] == 100 and e.count() == 8
    df = synthetic.trials(spark, n_epochs=2, n=4, participants=2, conditions=(1, 2))
    tables.write_store(df, str(tmp_path / "store"))
    assert tables.read_store(spark, str(tmp_path / "store"), [1], [2]).count() == 8
    tables.write_csv(df, str(tmp_path / "csv"))
    assert tables.list_files(spark, str(tmp_path / "l.csv"), "l").count() == 1
    assert tables.output_name("o", "a/b_1.bdf", "_clean") == "o/b_1_clean.parquet"


def test_config():
    c = config.read_config(text="[preprocess]\nreference = 'mastoid'\n[preprocess.highpass]\ncutoff = 1\n")
    assert c["preprocess"]["reference"] == "mastoid" and c["preprocess"]["highpass"]["cutoff"] == 1.0
    assert config.read_config(text=config.template()) == config.defaults()
    for bad in ("[preprocess.lowpass]\nmethod = 'x'\n", "[ica]\npercentage = 200.0\n", "[ica]\napply = 3\n"):
        with pytest.raises(ValueError):
            config.read_config(text=bad)


def test_preprocess(spark):
    df = synthetic.with_triggers(spark, {300: 1, 500: 1, 700: 1, 850: 1}, rate=1000.0)
    for k, n in enumerate("BCDE"):
        df = df.withColumn(n, F.sin(F.col("time") * (40 + 7 * k)) * (1 + k))
    df = df.withColumn("A", F.when(F.col("sample").between(690, 700), 400.0).otherwise(F.sin(F.col("time") * 33)))
    pos = spark.createDataFrame([("A", 0.0, 0.0), ("B", 0.1, 0.0), ("C", 0.0, 0.1), ("D", 0.1, 0.1), ("E", 0.9, 0.9)], "label string, x2 double, y2 double")
    c = config.defaults()
    c["preprocess"] |= {"epoch_start": -0.1, "epoch_end": 0.1, "reference": "none", "neighbour_criterion": 0.12}
    out = preprocess(df, list("ABCDE"), pos, [EpochCondition("go", ((1,),))], 1000.0, c)
    assert out.epochs.select("epoch").distinct().count() == 4
    row = out.comparison.first()
    assert (row["before"], row["after"], row["repaired"]) == (1, 0, 1)
    assert out.erps.first()["n_epochs"] == 4


def test_streaming_epochs(spark, tmp_path):
    rows = spark.range(100).select(F.lit(1).alias("participant"), F.timestamp_micros(F.col("id") * 100000).alias("ts"), F.when(F.col("id") == 20, 5).otherwise(0).alias("triggers"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df in (("ep", epoching.stream_epochs(stream, [5])), ("tc", epoching.stream_trigger_counts(stream))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append" if name == "ep" else "update").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    got = sorted(r["time"] for r in spark.table("ep").collect())
    assert got[0] == -0.5 and got[-1] == 1.0 and len(got) == 16
    assert spark.table("tc").first()["count"] == 1
