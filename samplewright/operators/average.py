"""Averages over trials and participants, and contrasts of conditions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def average_epochs(df: DataFrame, keys: Sequence[str], names: Sequence[str], pos: str = "pos", time: str = "time") -> DataFrame:
    """Mean over trials at each position; n_epochs counts the trials."""
    return df.groupBy(*keys, pos).agg(F.min(time).alias(time), *[F.avg(n).alias(n) for n in names], F.count(F.lit(1)).alias("n_epochs"))


def grand_average(erps: DataFrame, names: Sequence[str], condition: str = "condition", pos: str = "pos", time: str = "time", participant: str = "participant") -> DataFrame:
    """Unweighted mean over participants, where there are two or more; n_epochs are summed."""
    out = erps.groupBy(condition, pos).agg(F.min(time).alias(time), *[F.avg(n).alias(n) for n in names], F.sum("n_epochs").alias("n_epochs"), F.countDistinct(participant).alias("n_participants"))
    return out.filter("n_participants >= 2").withColumn("condition_name", F.concat(F.lit("grand_avg_"), F.col(condition).cast("string")))


def jackknife(erps: DataFrame, names: Sequence[str], keys: Sequence[str] = ("condition", "pos"), participant: str = "participant") -> DataFrame:
    """For each participant the mean of all others, from sums: linear in the number of participants."""
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    means = {c: F.when(n > 1, (F.sum(c).over(w) - F.col(c)) / F.nullif(n - 1, F.lit(0))) for c in names}
    return erps.withColumns(means | ({"n_epochs": F.sum("n_epochs").over(w) - F.col("n_epochs")} if "n_epochs" in erps.columns else {}))


def condition_combine(df: DataFrame, groups: Sequence[Sequence], condition: str = "condition") -> DataFrame:
    """Trials of the listed conditions under the group's number; a condition may be in several groups."""
    named = F.array(*[F.struct(F.lit(i).alias("g"), F.lit("_".join(map(str, g))).alias("name"), F.col(condition).isin(list(g)).alias("has")) for i, g in enumerate(groups, 1)])
    out = df.withColumn("_g", F.explode(F.filter(named, lambda x: x["has"])))
    return out.withColumn(condition, F.col("_g.g")).withColumn("condition_name", F.col("_g.name")).drop("_g")


def condition_difference(erps: DataFrame, pairs: Sequence[tuple], names: Sequence[str], keys: Sequence[str] = ("participant", "pos"), condition: str = "condition", time: str = "time") -> DataFrame:
    """First minus second of each pair where both exist; n_epochs is the lesser. One aggregate per pair, no join."""
    parts = []
    for i, (a, b) in enumerate(pairs, 1):
        rows = erps.filter(F.col(condition).isin(a, b)).groupBy(*keys)
        is_a, is_b = F.col(condition) == a, F.col(condition) == b
        out = rows.agg(
            F.min(time).alias(time),
            *[(F.max(F.when(is_a, F.col(n))) - F.max(F.when(is_b, F.col(n)))).alias(n) for n in names],
            F.min("n_epochs").alias("n_epochs"),
            F.countDistinct(condition).alias("_both"),
        )
        parts.append(out.filter("_both = 2").drop("_both").withColumn(condition, F.lit(i)).withColumn("condition_name", F.lit(f"difference_{a}_{b}")))
    return reduce(DataFrame.unionByName, parts)


def lateral_pairs(names: Sequence[str]) -> list[tuple[str, str]]:
    """Letters with an odd number and the same letters with the next even one."""
    have, out = set(names), []
    for n in names:
        m = re.fullmatch(r"([A-Za-z]+)(\d+)", n)
        if m and int(m[2]) % 2 and (other := f"{m[1]}{int(m[2]) + 1}") in have:
            out.append((n, other))
    return out


def lateralised(erps: DataFrame, pairs: Sequence[tuple], names: Sequence[str], keys: Sequence[str] = ("participant", "pos"), condition: str = "condition", time: str = "time") -> DataFrame:
    """Double subtraction for (left, right) response conditions over lateral channel pairs."""
    sides, parts = lateral_pairs(names), []
    for i, (left, right) in enumerate(pairs, 1):
        v = lambda n, c: F.max(F.when(F.col(condition) == c, F.col(n)))  # noqa: E731,B023
        cols = []
        for a, b in sides:
            cols.append((0.5 * ((v(a, right) - v(b, right)) + (v(b, left) - v(a, left)))).alias(a))
            cols.append((0.5 * ((v(b, left) - v(a, left)) * -1 + (v(a, right) - v(b, right)) * -1)).alias(b))
        out = erps.filter(F.col(condition).isin(left, right)).groupBy(*keys).agg(F.min(time).alias(time), *cols, F.countDistinct(condition).alias("_both"))
        parts.append(out.filter("_both = 2").drop("_both").withColumn(condition, F.lit(i)))
    return reduce(DataFrame.unionByName, parts)


def epochs_table(df: DataFrame, cleaned: DataFrame | None = None, keys: Sequence[str] = ("participant", "condition")) -> DataFrame:
    """Trials per key; with the cleaned trials also their number and percentage, to one decimal."""
    counts = df.groupBy(*keys).agg(F.countDistinct("epoch").alias("n_epochs"))
    if cleaned is None:
        return counts
    left = cleaned.groupBy(*keys).agg(F.countDistinct("epoch").alias("n_clean"))
    out = counts.join(left, list(keys), "left").withColumn("n_clean", F.coalesce("n_clean", F.lit(0)))
    return out.withColumn("percentage", F.bround(F.col("n_clean") * 100.0 / F.col("n_epochs"), 1))


def file_summary(table: DataFrame, file: str = "participant") -> DataFrame:
    return table.groupBy(file).agg(F.bround(F.avg("percentage"), 1).alias("percentage"))


def merge_summaries(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """old without the rows of files in new, then new."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def group_by_condition(df: DataFrame, condition: str = "condition") -> list:
    return [r[0] for r in df.select(condition).distinct().sort(condition).collect()]


def same_structure(df: DataFrame, keys: Sequence[str], time: str = "time") -> DataFrame:
    """One row: whether all series have the same length and times."""
    each = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("lo"), F.max(time).alias("hi"))
    return each.agg(((F.min("n") == F.max("n")) & (F.max("lo") - F.min("lo") < 1e-9) & (F.max("hi") - F.min("hi") < 1e-9)).alias("same"))
