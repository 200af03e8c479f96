"""Corpus operators doing their whole job, against hand-made cases and brute force."""

import hashlib

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from samplewright.llm import exact_dedup, langid, mixing, oracles, queries


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_unknown_languages_are_rejected(spark, documents):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = langid.train(documents.filter(~held))
    clean = documents.filter(held & F.col("text").rlike("[a-z]"))
    assert langid.known_language(clean, model).count() == clean.count() > 20
    odd = ["asdf jkl; qwerty uiop zxcv", "猫坐在屋顶上看着我们", "Привет, как дела сегодня утром", "xkcd vvv", "12 34"]
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    assert langid.known_language(rows, model).count() == 0


def test_without_labels_a_letter_is_enough(documents):
    bare = documents.withColumn("lang", F.lit(None).cast("string"))
    got = langid.known_language(bare)
    assert got.columns == bare.columns
    assert {r[0] for r in got.select("doc_id").collect()} == {r["doc_id"] for r in documents.collect() if any(c.isalpha() for c in r["text"] or "")}


def test_mixing_gives_each_document_its_training_position(spark, sf_dir):
    got = queries.op3_mixing(spark, sf_dir)
    assert compare(got, connect(sf_dir), oracles.ORACLES["op3_mixing"]) == ""
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [position" in plan and "SQRT" in plan and "Sort [position" in plan
    source = dict(connect(sf_dir).sql("SELECT doc_id, source FROM documents").fetchall())
    text = dict(connect(sf_dir).sql("SELECT doc_id, text FROM documents").fetchall())
    rows, names = got.toPandas(), sorted(set(source.values()))
    at = rows.position.dropna()
    assert at.is_monotonic_increasing and len(at) > len(rows) / 2 and rows.position[len(at) :].isna().all()
    assert rows.position[rows.taken > 0].notna().all()
    rows["source"] = rows.doc_id.map(source)
    rows["key"] = [hashlib.md5(f"mix:{i}:{hashlib.md5((text[i] or '').encode()).hexdigest()}".encode()).hexdigest() for i in rows.doc_id]
    for rank, name in enumerate(names):
        own = rows[rows.source == name].sort_values(["key", "doc_id", "size"])
        start = own["size"].cumsum() - own["size"]
        share = start / own.target
        assert (own.position.isna() == (start >= np.floor(own.target))).all()
        fine = np.linspace(0, 1, 20001)
        t, weight = zip(*(mixing.FADE_OUT, mixing.FADE_IN, mixing.FADE_IN)[rank % 3], strict=True)
        w = np.interp(fine, t, weight)
        done = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(fine))])
        assert np.abs(np.interp(share, done / done[-1], fine) - own.position)[own.position.notna()].max() < 1e-3


def test_an_index_keeps_its_bucket_count(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    one = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    assert exact_dedup.decide(one, exact_dedup.DigestIndex(spark, path, 4)).filter("kept").count() == 200
    index = exact_dedup.DigestIndex(spark, path, 7)
    assert index.buckets == 4
    assert exact_dedup.decide(one, index).filter("kept").count() == 0 and index.read().count() == 200


EXTRA = ["_size", "_d", "_tk", "_id", "_p", "c0", "key", "order_key", "rank", "first", "pass", "copies", "kept_id", "kept_key", "own_digest", "nearest", "score", "rep", "row", "digest", "of", "in", "node", "start"]


def odd_documents(spark):
    base = "the cat sat on the mat and the dog lay by the door while rain fell on the roof of the old house by the river "
    rows = [
        (1, None, "en", "a", None), (2, "", None, "a", 0), (3, "12 34", "en", None, 5), (None, base + "one", "en", "b", 1), (None, base + "one", "en", "b", 1), (None, None, None, None, None),
        (4, base.upper() + "ONE", "en", "b", 1), (5, base * 300, "en", None, 9), (6, base * 300 + "end", None, None, 9), (7, "der hund und die katze liegen vor dem haus und schlafen", "de", "a", 2), (7, "der hund und die katze liegen vor dem haus und schlafen", "de", "a", 2),
        (8, "le chat et le chien dorment devant la maison avec la souris", "fr", "c", 3), (8, "ein anderer text mit derselben nummer und anderen worten darin", "de", "c", 3), (9, base + "two", "en", "c", 4),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_every_stage_on_odd_documents(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, and extra columns with names the stages might use themselves."""
    import corpus_pipeline as cp

    now = odd_documents(spark).select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)])
    sizes = {}
    for name, stage in cp.STAGES:
        stage(spark, now, "").write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or out.columns == now.columns
        sizes[name] = out.count()
        now = out
        if name == "near_dedup":
            rows = now.collect()
            assert all([r[c] for c in EXTRA] == list(range(len(EXTRA))) for r in rows)
            kept = sorted(r["text"] for r in rows)
    assert sizes["language"] == 10  # not the null and empty texts, nor the one without a letter
    assert sizes["exact_dedup"] == 7 and sizes["near_dedup"] == len(set(kept)) == 4  # all with the English base are one class: 20 of 25 runs and more
    assert 0 < sizes["mixing"] <= 15 and sizes["packing"] > 0


def test_every_stage_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline as cp

    now = odd_documents(spark).filter("false")
    for name, stage in cp.STAGES:
        out = stage(spark, now, "")
        assert out.count() == 0
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))


def test_mixing_ties_do_not_change_places(spark):
    """Rows of one id, source and size, told apart by their texts alone: the same ones are taken however they lie."""
    rows = [(7 if i % 3 else None, f"w{i} x y", "ab"[i % 2]) for i in range(400)] + [(7, "same same same", "a")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [mixing.mix(x).collect() for x in (docs, docs.repartition(5), docs.orderBy("text"))]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) > 300
