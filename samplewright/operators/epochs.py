"""Cutting recordings into trials around trigger sequences."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import triggers as trg


@dataclass(frozen=True)
class EpochCondition:
    """A trigger pattern: sequences (any of them), the element that is time zero, and restrictions."""

    name: str
    trigger_sequences: tuple[tuple[trg.Element, ...], ...]
    reference_index: int = 1
    timing_pairs: tuple[tuple[int, int], ...] = ()
    min_interval: float | None = None
    max_interval: float | None = None
    after: int | None = None
    before: int | None = None
    extra: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        n = len(self.trigger_sequences[0]) if self.trigger_sequences else 0
        if not n:
            raise ValueError("a condition needs a trigger sequence")
        if not 1 <= self.reference_index <= n:
            raise ValueError("reference_index is outside the sequence")
        if self.after is not None and self.before is not None:
            raise ValueError("after and before exclude each other")
        if self.timing_pairs and (self.min_interval is None or self.max_interval is None or self.min_interval >= self.max_interval):
            raise ValueError("timing pairs need min_interval < max_interval")
        if any(not 1 <= a < b <= n for a, b in self.timing_pairs):
            raise ValueError("timing pairs must be ordered and within the sequence")


def parse_conditions(config: dict) -> list[EpochCondition]:
    """From the [[epochs.conditions]] tables of a TOML configuration."""

    def element(x):
        if isinstance(x, str):
            if x in ("any", ":any", "*"):
                return trg.ANY
            a, b = x.replace("-", ":").split(":")
            return range(int(a), int(b) + 1)
        return int(x)

    out = []
    for c in config.get("epochs", {}).get("conditions", []):
        pairs = tuple((int(a), int(b)) for a, b in c.get("timing_pairs", []))
        out.append(
            EpochCondition(
                c["name"], tuple(tuple(element(x) for x in s) for s in c["trigger_sequences"]), int(c.get("reference_index", 1)), pairs, c.get("min_interval"), c.get("max_interval"), c.get("after"), c.get("before")
            )
        )
    return out


def zero_points(df: DataFrame, condition: EpochCondition, rate: float, keys: Sequence[str] = ("participant",), by: str = "sample", column: str = "triggers") -> DataFrame:
    """keys, epoch (in order of the starts), start, zero: the samples at time zero of the condition's matches.

    The reference element and timing pairs count samples from the start.
    """
    found = trg.search_any(df, condition.trigger_sequences, keys, by, column)
    length = len(condition.trigger_sequences[0])
    if condition.after is not None or condition.before is not None:
        w = Window.partitionBy(*keys).orderBy(by)
        marks = df.select(*keys, by, column)
        if condition.after is not None:
            seen = F.max(F.when(F.col(column) == condition.after, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
        else:
            seen = F.max(F.when(F.col(column) == condition.before, 1).otherwise(0)).over(w.rowsBetween(length, Window.unboundedFollowing))
        marks = marks.withColumn("_seen", seen).select(*keys, F.col(by).alias("start"), "_seen")
        found = found.join(marks, [*keys, "start"]).filter(F.col("_seen") == 1).drop("_seen")
    for a, b in condition.timing_pairs:  # offsets in samples are fixed, so the test is on the rate
        gap = (b - a) / rate
        if not condition.min_interval <= gap <= condition.max_interval:
            found = found.filter(F.lit(False))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("start"))
    return found.withColumn("epoch", number).withColumn("zero", F.col("start") + condition.reference_index - 1)


def _span_join(samples: DataFrame, windows: DataFrame, keys: Sequence[str], width: int, by: str = "sample") -> DataFrame:
    """Range join lo <= sample <= hi as a hash join on blocks of samples, one or two per window."""
    width = max(width, 1)
    windows = windows.withColumn("_block", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    samples = samples.withColumn("_block", F.floor(F.col(by) / width))
    return samples.join(windows, [*keys, "_block"]).filter(F.col(by).between(F.col("lo"), F.col("hi"))).drop("_block")


def mark_windows(df: DataFrame, zeros: DataFrame, window: tuple[float, float], rate: float, keys: Sequence[str] = ("participant",), out: str = "epoch_window", by: str = "sample") -> DataFrame:
    """Flags samples within [zero + a, zero + b]."""
    lo, hi = round(window[0] * rate), round(window[1] * rate)
    spans = zeros.select(*keys, (F.col("zero") + lo).alias("lo"), (F.col("zero") + hi).alias("hi"))
    hits = _span_join(df.select(*keys, by), spans, keys, hi - lo + 1, by).select(*keys, by).distinct().withColumn("_hit", F.lit(True))
    return df.join(hits, [*keys, by], "left").withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_hit")


def mark_trigger_windows(df: DataFrame, codes: Sequence[int], window: tuple[float, float], rate: float, keys: Sequence[str] = ("participant",), out: str = "epoch_window", by: str = "sample", column: str = "triggers") -> DataFrame:
    """Flags samples around every sample that has one of the codes."""
    return mark_windows(df, df.filter(F.col(column).isin(list(codes))).select(*keys, F.col(by).alias("zero")), window, rate, keys, out, by)


def extract(df: DataFrame, conditions: Sequence[EpochCondition], window: tuple[float, float], rate: float, keys: Sequence[str] = ("participant",), by: str = "sample", column: str = "triggers") -> DataFrame:
    """Trials: df's columns plus condition, condition_name, epoch, pos and time from zero.

    Windows that leave the recording are skipped, and their epoch numbers with
    them. The start must not be after zero.
    """
    if window[0] > 0:
        raise ValueError("the window must start at or before time zero")
    before, after = round(-window[0] * rate), round(window[1] * rate)
    ends = df.groupBy(*keys).agg(F.min(by).alias("_first"), F.max(by).alias("_last"))
    spans = None
    for i, c in enumerate(conditions, 1):
        z = zero_points(df, c, rate, keys, by, column).withColumn("condition", F.lit(i)).withColumn("condition_name", F.lit(c.name))
        spans = z if spans is None else spans.unionByName(z)
    spans = spans.select(*keys, "condition", "condition_name", "epoch", "zero", (F.col("zero") - before).alias("lo"), (F.col("zero") + after).alias("hi"))
    spans = spans.join(ends, list(keys)).filter((F.col("lo") >= F.col("_first")) & (F.col("hi") <= F.col("_last"))).drop("_first", "_last")
    out = _span_join(df, spans, keys, before + after + 1, by)
    out = out.withColumn("pos", (F.col(by) - F.col("lo") + 1).cast("long")).withColumn("time", (F.col(by) - F.col("zero")) / F.lit(float(rate)))
    return out.drop("lo", "hi", "zero")


def realign(df: DataFrame, by: str, keys: Sequence[str] = ("participant", "condition"), epoch: str = "epoch", time: str = "time", pos: str = "pos") -> DataFrame:
    """Moves time zero to the per-trial time in column `by`, crops to the window all trials share."""
    each = Window.partitionBy(*keys, epoch)
    rows = df.withColumn(time, F.col(time) - F.col(by)).withColumn(by, F.lit(0.0))
    rows = rows.withColumn("_lo", F.min(time).over(each)).withColumn("_hi", F.max(time).over(each)).withColumn("_n", F.count(F.lit(1)).over(each))
    shared = rows.groupBy(*keys).agg(F.max("_lo").alias("_start"), F.min("_hi").alias("_end"), F.min((F.col("_hi") - F.col("_lo")) / (F.col("_n") - 1)).alias("_dt"))
    rows = rows.drop("_lo", "_hi", "_n").join(shared, list(keys))
    half = F.col("_dt") / 2
    rows = rows.filter((F.col(time) > F.col("_start") - half) & (F.col(time) <= F.col("_end") + half))
    rows = rows.withColumn(pos, F.row_number().over(each.orderBy(time)))
    rows = rows.withColumn("_count", F.max(pos).over(each))
    least = rows.groupBy(*keys).agg(F.min("_count").alias("_keep"))
    rows = rows.join(least, list(keys)).filter(F.col(pos) <= F.col("_keep"))
    return rows.withColumn(time, F.col("_start") + (F.col(pos) - 1) * F.col("_dt")).drop("_start", "_end", "_dt", "_count", "_keep")


def _dealt(df: DataFrame, keys: Sequence[str], part_bytes: int = 2 << 20, most: int = 20_000) -> DataFrame:
    """df by keys in partitions whose number grows with its size, which adaptive execution does not join again: a task sorts no more on larger tables."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = min(most, -(-size // part_bytes)) if size < 2**60 else 0  # a larger size means that it is not known
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def mirror(df: DataFrame, keys: Sequence[str], side: str = "both", time: str = "time", pos: str = "pos") -> DataFrame:
    """Reflects each series before, after, or on both sides, the edge sample not repeated."""
    w = Window.partitionBy(*keys)
    rows = _dealt(df, keys).withColumn("_n", F.max(pos).over(w)).withColumn("_dt", (F.max(time).over(w) - F.min(time).over(w)) / (F.max(pos).over(w) - 1))
    shift = F.when(F.lit(side in ("pre", "both")), F.col("_n") - 1).otherwise(0)
    to = [F.col(pos) + shift]
    if side in ("pre", "both"):
        to.append(F.when(F.col(pos) > 1, F.col("_n") + 1 - F.col(pos)))
    if side in ("post", "both"):
        to.append(F.when(F.col(pos) < F.col("_n"), shift + 2 * F.col("_n") - F.col(pos)))
    out = rows.select("*", F.posexplode(F.array(*to)).alias("_i", "_p")).filter("_i = 0 OR _p IS NOT NULL")
    out = out.withColumn(time, F.when(F.col("_p") - shift == F.col(pos), F.col(time)).otherwise(F.col(time) + (F.col("_p") - shift - F.col(pos)) * F.col("_dt")))
    return out.withColumn(pos, F.col("_p")).drop("_i", "_p", "_n", "_dt")


def unmirror(df: DataFrame, keys: Sequence[str], side: str = "both", pos: str = "pos") -> DataFrame:
    """The inverse of mirror."""
    rows = df.withColumn("_m", F.max(pos).over(Window.partitionBy(*keys)))
    n = F.floor((F.col("_m") + (2 if side == "both" else 1)) / (3 if side == "both" else 2))
    shift = n - 1 if side in ("pre", "both") else F.lit(0)
    return rows.filter(F.col(pos).between(shift + 1, shift + n)).withColumn(pos, (F.col(pos) - shift).cast("long")).drop("_m")


def resample(df: DataFrame, factor: int, keys: Sequence[str], by: str = "sample", triggers: str | None = "triggers") -> DataFrame:
    """Every factor-th row; non-zero triggers move to their nearest kept row, the later one winning."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(by)))
    kept = rows.filter((F.col("_i") - 1) % factor == 0).withColumn("_k", (F.floor((F.col("_i") - 1) / factor) + 1).cast("long"))
    if triggers:
        last = F.floor((F.count(F.lit(1)).over(w) - 1) / factor) + 1
        moved = rows.withColumn("_k", F.least(last, F.greatest(F.lit(1), F.bround(F.col("_i") / factor, 0))).cast("long")).filter(F.col(triggers) != 0)
        moved = moved.groupBy(*keys, "_k").agg(F.max_by(triggers, "_i").alias("_t"))
        kept = kept.join(moved, [*keys, "_k"], "left").withColumn(triggers, F.coalesce("_t", F.lit(0))).drop("_t")
    return kept.withColumn(by, F.col("_k")).select(*df.columns)


