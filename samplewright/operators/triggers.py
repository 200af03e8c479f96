"""Trigger channels: onsets, counts and sequence search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANY = "any"
#: A sequence element: a code, a range of codes, or ANY.
Element = int | range | str


def _order(keys: Sequence[str], by: str):
    return Window.partitionBy(*keys).orderBy(by)


def clean(df: DataFrame, keys: Sequence[str] = ("participant",), by: str = "sample", column: str = "triggers", out: str = "triggers") -> DataFrame:
    """Keeps a value only where it rises over the sample before it; others become 0."""
    before = F.lag(column, 1, 0).over(_order(keys, by))
    return df.withColumn(out, F.when(F.col(column) > before, F.col(column)).otherwise(F.lit(0)))


def count(df: DataFrame, keys: Sequence[str] = (), column: str = "triggers", info: str | None = None, by: str = "sample", ignore: Sequence[int] = ()) -> DataFrame:
    """Non-zero codes with their number of samples, and the first text seen."""
    rows = df.filter((F.col(column) != 0) & ~F.col(column).isin(list(ignore)))
    aggs = [F.count(F.lit(1)).alias("count")] + ([F.min_by(info, by).alias(info)] if info else [])
    return rows.groupBy(*keys, F.col(column).alias("trigger")).agg(*aggs)


def count_raw_and_clean(df: DataFrame, keys: Sequence[str] = ("participant",), by: str = "sample", column: str = "triggers") -> DataFrame:
    both = clean(df, keys, by, column, "_clean").filter(F.col(column) != 0)
    return both.groupBy(F.col(column).alias("trigger")).agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("_clean") != 0).alias("cleaned"))


def _fits(code: Column, element: Element) -> Column:
    if element == ANY:
        return F.lit(True)
    if isinstance(element, range):
        return code.between(element.start, element.stop - 1)
    return code == element


def search(df: DataFrame, sequence: Sequence[Element] | Element, keys: Sequence[str] = ("participant",), by: str = "sample", column: str = "triggers") -> DataFrame:
    """Samples at which the sequence starts: keys, start.

    The first element must be an onset (the sample before has another code).
    Later elements are the next non-zero samples; a held code counts once per
    sample. A sequence of ranges only means an onset of any code in them.
    """
    sequence = list(sequence) if isinstance(sequence, (list, tuple)) else [sequence]
    if sequence[0] == ANY:
        raise ValueError("the first element must be a code or a range")
    w = _order(keys, by)
    rows = df.select(*keys, by, column).withColumn("_before", F.lag(column).over(w))
    if all(isinstance(e, range) for e in sequence):
        hit = F.lit(False)
        for e in sequence:
            hit = hit | _fits(F.col(column), e)
        hit = hit & (F.col("_before").isNull() | (F.col("_before") != F.col(column))) & (F.col(column) != 0)
        return rows.filter(hit).select(*keys, F.col(by).alias("start"))
    rows = rows.withColumn("_index", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    rows = rows.filter(F.col(column) != 0)
    hit = _fits(F.col(column), sequence[0]) & (F.col("_before").isNull() | (F.col("_before") != F.col(column))) & (F.col("_index") <= F.col("_n") - len(sequence) + 1)
    for k, e in enumerate(sequence[1:], 1):
        rows = rows.withColumn(f"_next{k}", F.lead(column, k).over(w))
        hit = hit & F.col(f"_next{k}").isNotNull() & _fits(F.col(f"_next{k}"), e)
    return rows.filter(hit).select(*keys, F.col(by).alias("start"))


def search_any(df: DataFrame, sequences: Sequence[Sequence[Element]], keys: Sequence[str] = ("participant",), by: str = "sample", column: str = "triggers") -> DataFrame:
    """Starts of any of several sequences, each once."""
    out = search(df, sequences[0], keys, by, column)
    for s in sequences[1:]:
        out = out.unionByName(search(df, s, keys, by, column))
    return out.distinct()


def intervals(df: DataFrame, keys: Sequence[str] = ("participant",), time: str = "time", column: str = "triggers") -> DataFrame:
    """Non-zero samples with the seconds since the one before."""
    rows = df.filter(F.col(column) != 0)
    return rows.select(*keys, time, column, (F.col(time) - F.lag(time).over(_order(keys, time))).alias("interval"))


def markers_to_codes(markers: DataFrame, keys: Sequence[str], value: str = "description", sample: str = "position", n_samples: int | None = None) -> DataFrame:
    """Marker texts as codes by sorted distinct text (1-based); of two at a sample the later row wins."""
    codes = markers.select(value).distinct().withColumn("triggers", F.row_number().over(Window.orderBy(value)))
    rows = markers.join(codes, value)
    shift = F.when(F.min(sample).over(Window.partitionBy(*keys)) == 0, 1).otherwise(0)
    rows = rows.withColumn("sample", F.col(sample) + shift)
    if n_samples is not None:
        rows = rows.filter(F.col("sample").between(1, n_samples))
    return rows.groupBy(*keys, "sample").agg(F.max_by(F.struct("triggers", F.col(value).alias("triggers_info")), "marker").alias("x")).select(*keys, "sample", "x.triggers", "x.triggers_info")
