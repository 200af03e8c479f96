"""Text and Parquet sources and sinks: layouts, exported trials, stores, file lists."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.select import participant_of


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """label, inc, azi in degrees from a CSV file with or without a header."""
    raw = spark.read.schema("label string, inc string, azi string").csv(path, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    rows = raw.select("label", F.expr("try_cast(inc as double)").alias("inc"), F.expr("try_cast(azi as double)").alias("azi"))
    return rows.filter("inc is not null and azi is not null")


def read_epochs_csv(spark: SparkSession, path: str, condition: int = 1, condition_name: str = "csv_data", rate: float | None = None) -> DataFrame:
    """Trials exported as trial, time, channels...: adds condition, pos, and the sample rate from the first trial's median step."""
    header = spark.read.text(path).limit(1).first()[0].split(",")
    schema = ", ".join(f"`{c.strip()}` {'long' if i == 0 else 'double'}" for i, c in enumerate(header))
    rows = spark.read.schema(schema).csv(path, header=True)
    trial, time = rows.columns[:2]
    w = Window.partitionBy(trial).orderBy(time)
    if rate is None:
        steps = rows.filter(F.col(trial) == 1).select((F.col(time) - F.lag(time).over(w)).alias("d"))
        rate = float(round(1 / steps.agg(F.median("d")).first()[0]))
    return rows.withColumnsRenamed({trial: "epoch", time: "time"}).select(
        F.lit(condition).alias("condition"), F.lit(condition_name).alias("condition_name"), "epoch", F.row_number().over(Window.partitionBy("epoch").orderBy("time")).alias("pos"), F.lit(rate).alias("rate"), "time", *rows.columns[2:]
    )


def read_store(spark: SparkSession, path: str, participants: Sequence | None = None, conditions: Sequence | None = None) -> DataFrame:
    """A Parquet store; participant and condition select its partitions."""
    out = spark.read.parquet(path)
    if participants is not None:
        out = out.filter(F.col("participant").isin(list(participants)))
    return out.filter(F.col("condition").isin(list(conditions))) if conditions is not None else out


def write_store(df: DataFrame, path: str, by: Sequence[str] = ("participant", "condition"), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*[c for c in by if c in df.columns]).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def list_files(spark: SparkSession, path: str, pattern: str = "", participants: Sequence[int] | None = None) -> DataFrame:
    """path and participant of files whose name contains the pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    files = files.filter(F.regexp_extract("path", r"([^/]*)$", 1).contains(pattern)).withColumn("participant", participant_of("path"))
    return files.filter(F.col("participant").isin(list(participants))) if participants is not None else files


def output_name(folder: str, source: str, suffix: str, extension: str = ".parquet") -> str:
    stem = re.sub(r"\.[^.]*$", "", os.path.basename(source))
    return f"{folder}/{stem}{suffix}{extension}"
