"""Channel statistics: summaries, correlations, joint probability, field power."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .select import melt


def zscore(column: str | Column, keys: Sequence[str] = ()) -> Column:
    """(x - mean) / sample standard deviation; 0 where that is 0."""
    c = F.col(column) if isinstance(column, str) else column
    w = Window.partitionBy(*keys)
    sd = F.stddev_samp(c).over(w)
    return F.when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise((c - F.avg(c).over(w)) / F.nullif(sd, F.lit(0.0)))


def add_zscores(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return df.withColumns({f"{n}_z": zscore(n, keys) for n in names})


def channel_summary(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Per channel (and key): min, max, std, range, var, and zvar over the channels."""
    long = melt(df, keys, names)
    out = long.groupBy(*keys, "channel").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.stddev_samp("value").alias("std"), (F.max("value") - F.min("value")).alias("range"), F.var_samp("value").alias("var")
    )
    return out.withColumn("zvar", zscore("var", keys))


def correlations(df: DataFrame, rows: Sequence[str], columns: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every row channel with every column channel, in one aggregate: keys, row, column, r."""
    pairs = [(a, b) for a in rows for b in (columns or rows)]
    wide = df.groupBy(*keys).agg(F.array(*[F.struct(F.lit(a).alias("row"), F.lit(b).alias("column"), (F.lit(1.0) if a == b else F.corr(a, b)).alias("r")) for a, b in pairs]).alias("_x"))
    return wide.select(*keys, F.inline("_x"))


def joint_probability(df: DataFrame, names: Sequence[str], keys: Sequence[str] = (), bins: int = 1000, threshold: float = 5.0, normalise: int = 2) -> DataFrame:
    """Per channel: -sum of log p over samples, p from a histogram; normalised over channels
    (1: all, 2: after dropping a tenth at either end), rejected beyond the threshold."""
    long = melt(df, keys, names)
    limits = long.groupBy(*keys, "channel").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n"))
    on = [*keys, "channel"]
    scaled = long.join(limits, on).withColumn("bin", F.coalesce(F.floor((F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * (bins - 1)), F.lit(0)))
    counts = scaled.groupBy(*on, "bin", "n").agg(F.count(F.lit(1)).alias("k"))
    jp = counts.groupBy(*on).agg(F.sum(-F.col("k") * F.log(F.col("k") / F.col("n"))).alias("jp"))
    w = Window.partitionBy(*keys)
    if normalise:
        cut = F.bround(F.count(F.lit(1)).over(w) * 0.1, 0) if normalise == 2 else F.lit(0)
        order = F.row_number().over(w.orderBy("jp", "channel"))
        jp = jp.withColumn("_in", (order > cut) & (order <= F.count(F.lit(1)).over(w) - cut))
        kept = F.when(F.col("_in"), F.col("jp"))
        sd = F.stddev_samp(kept).over(w)
        jp = jp.withColumn("jp", F.when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise((F.col("jp") - F.avg(kept).over(w)) / F.nullif(sd, F.lit(0.0)))).drop("_in")
    return jp.withColumn("rejected", F.abs("jp") > threshold)


def _spread(names: Sequence[str]) -> Column:
    """Population standard deviation across columns."""
    values = F.array(*names)
    n = float(len(names))
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    return F.sqrt(F.aggregate(F.transform(values, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / n)


def gfp(df: DataFrame, names: Sequence[str], keys: Sequence[str] = (), normalise: bool = False, out: str = "gfp") -> DataFrame:
    """Global field power at each sample; normalised to 0..100 per key if asked."""
    df = df.withColumn(out, _spread(names))
    if normalise:
        w = Window.partitionBy(*keys)
        lo, hi = F.min(out).over(w), F.max(out).over(w)
        df = df.withColumn(out, F.when(hi > lo, (F.col(out) - lo) / F.nullif(hi - lo, F.lit(0.0)) * 100).otherwise(0.0))
    return df


def dissimilarity(df: DataFrame, names: Sequence[str], keys: Sequence[str] = (), order: str = "pos", normalise: bool = False, out: str = "dissimilarity") -> DataFrame:
    """Root mean square change of the GFP-scaled map from sample to sample; the first repeats the second."""
    w = Window.partitionBy(*keys).orderBy(order)
    power = _spread(names)
    scaled = F.transform(F.array(*names), lambda x: F.when(F.col("_power") > 0, x / F.nullif(F.col("_power"), F.lit(0.0))).otherwise(0.0))
    df = df.withColumn("_power", power).withColumn("_map", scaled)
    df = df.withColumn("_last", F.lag("_map").over(w))
    change = F.sqrt(F.aggregate(F.zip_with("_map", "_last", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x) / float(len(names)))
    df = df.withColumn(out, change)
    df = df.withColumn(out, F.coalesce(out, F.lead(out).over(w))).drop("_power", "_map", "_last")
    if normalise:
        u = Window.partitionBy(*keys)
        lo, hi = F.min(out).over(u), F.max(out).over(u)
        df = df.withColumn(out, F.when(hi > lo, (F.col(out) - lo) / F.nullif(hi - lo, F.lit(0.0)) * 100).otherwise(0.0))
    return df


def gfp_and_dissimilarity(df: DataFrame, names: Sequence[str], keys: Sequence[str] = (), order: str = "pos", normalise: bool = False) -> DataFrame:
    return dissimilarity(gfp(df, names, keys, normalise), names, keys, order, normalise)


def regions_of(df: DataFrame, flag: str, keys: Sequence[str], order: str = "sample", time: str = "time") -> DataFrame:
    """Runs of true: keys, start and end times."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_i", F.row_number().over(w)).filter(F.col(flag))
    rows = rows.withColumn("_island", F.col("_i") - F.row_number().over(w))
    return rows.groupBy(*keys, "_island").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("n")).drop("_island")


def average_summary(summary: DataFrame, value: str, by: Sequence[str] = ("channel",)) -> DataFrame:
    """Mean of a summary column over other keys, with a 95 % interval's half width."""
    return summary.groupBy(*by).agg(F.avg(value).alias("mean"), (1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))).alias("half_width"))
