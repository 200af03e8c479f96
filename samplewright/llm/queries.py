"""The corpus operators' queries: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fingerprints, html_text, langid, mixing, near_join, packing, pseudonyms, token_counts, url_filter
from .common import read_table


#: For these queries alone: a key that is written down protects nobody.
QUERY_KEY = "not a secret"


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(read_table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(read_table(spark, sf_dir, "documents"))
    # A document that starts at or after its source's last word has no copy, so no position: it comes last.
    plan = plan.withColumn("position", F.when(F.col("start") < F.floor("target"), F.col("position")))
    return mixing.in_order(plan, F.col("position").asc_nulls_last(), "start").select("doc_id", "size", "source_size", "target", "taken", "position")


def op4_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_duplicates(read_table(spark, sf_dir, "documents")).drop("text_key")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages")).drop("component")


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(read_table(spark, sf_dir, "documents"), QUERY_KEY)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = langid.train(docs.filter(~held_out))
    return langid.identify(docs, model, ["doc_id", held_out.alias("held_out")])


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(read_table(spark, sf_dir, "documents"), exact_dedup.new_index(spark))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_html_text, op3_mixing, op4_near_join, op5_url_filter, op6_pseudonyms, op7_language, op8_packing, op9_token_counts, op10_exact_dedup, pipeline)}
