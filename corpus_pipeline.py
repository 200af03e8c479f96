"""Corpus pipeline: language, exact and near duplicates, mixing, packing.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of documents.

Cases, for all stages: an empty table gives an empty result; null doc_id, lang,
source and n_chars are kept as they are; a null or empty text has no letter, so the
first stage drops it; further columns, with any names, are kept up to packing; of
rows equal in text one stays from the second stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from samplewright.llm import exact_dedup, langid, mixing, near_join, packing
from samplewright.llm.common import read_table, shared_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: no letter in the text, or no landmark of the model near it (langid.MIN_NEAREST)."""
    return langid.known_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the largest doc_id of texts equal but for the case of A-Z; a null doc_id is the least."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each class of near duplicates (five-word Jaccard of 0.8 or more); a null doc_id is the largest."""
    return near_join.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents, some of them several times, by source weights 5, 2, 1, in training order; a null source comes last."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document's tokens into sequences of at most 2048, in which sources come as in the mixing stage's curriculum."""
    return packing.pack(docs, schedules=mixing.SCHEDULES)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]

#: Tokens, kernels and MinHash have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
