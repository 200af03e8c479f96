"""The driver tables as recordings, trials and multichannel trials.

recording  one row per sample of a participant: participant, sample, time, triggers, value
trials     one row per sample of a single-channel trial: participant, condition, epoch, pos, time, value
patterns   one row per trial: condition, epoch, pattern (array of channel values)
multich    one row per sample: participant, condition, epoch, pos, Q, P, D, T (four channels)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CODES = {"click": 1, "error": 2, "purchase": 3, "signup": 4}
CHANNELS = ("Q", "P", "D", "T")
WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    code = F.lit(0)
    for name, value in CODES.items():
        code = F.when(F.col("event_type") == name, value).otherwise(code)
    sample = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return events.select(
        F.col("user_id").alias("participant"), sample.cast("long").alias("sample"), (sample - 1).cast("double").alias("time"), code.cast("long").alias("triggers"), "value"
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    long = vectors.select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    return long.select(
        (F.col("vec_id") % 10).alias("participant"),
        F.col("label").alias("condition"),
        F.col("vec_id").alias("epoch"),
        (F.col("i") + 1).alias("pos"),
        (F.col("i") / F.lit(float(WIDTH))).alias("time"),
        F.col("x").cast("double").alias("value"),
    )


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("condition"), F.col("vec_id").alias("epoch"), F.transform("embedding", lambda x: x.cast("double")).alias("pattern")
    )


def multich(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        (F.col("l_suppkey") % 10).alias("participant"),
        F.concat("l_returnflag", "l_linestatus").alias("condition"),
        F.col("l_orderkey").alias("epoch"),
        F.row_number().over(order).alias("pos"),
        F.col("l_quantity").alias("Q"),
        F.col("l_extendedprice").alias("P"),
        F.col("l_discount").alias("D"),
        F.col("l_tax").alias("T"),
    )
