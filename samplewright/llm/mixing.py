"""Mixing sources to target weights by a time-varying curriculum [DataFrame operations only].

Each source has a weight schedule over training time 0..1. Its integral is the
source's share of all words (its target, at most `max_epochs` passes over the
source; the excess is reshared by weight). A source's documents, in a fixed
pseudo-random order, are laid end to end; the word at which a copy of a document
starts, as a share of the target, is sent through the inverse of the source's
cumulative schedule to give its training position, and the result is
range-sorted by position.

The order of a source's documents is that of a digest of seed, doc_id and text, so
rows differ in it unless they agree in both. No source is ever one group of a shuffle: sources are split into hash ranges,
sums per range are combined in a small table, and running sums are taken within
ranges.

Cases: null text counts as empty (size 0, nothing taken); null sources form one
source, sorted last; repeated rows count each and may change places; with no words
all targets are 0; an empty table gives no rows; other columns, with any names, are
ignored by `plan_mix` and kept by `mix`. `weights` and `schedules` may differ in
length: each repeats by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, spread, word_count

#: (time, weight factor) knots: sources whose turn in the weight cycle comes first fade out, the others fade in. Both integrate to 1.
FADE_OUT = ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5))
FADE_IN = ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))
SCHEDULES = (FADE_OUT, FADE_IN, FADE_IN)


def _order_key(doc_id: Column, text: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def areas(knots: Sequence[tuple[float, float]]) -> list[float]:
    """Integral of a schedule up to each of its knots."""
    out = [0.0]
    for (a, u), (b, v) in zip(knots, knots[1:], strict=False):
        out.append(out[-1] + (b - a) * (u + v) / 2)
    return out


def source_targets(sizes: DataFrame, weights: Sequence[float], max_epochs: float, schedules: Sequence[Sequence[tuple[float, float]]]) -> DataFrame:
    """(source, source_size) -> + rank, target: water-filling under the cap of max_epochs passes.

    One row per source: small tables, so their windows need no split.
    """
    totals = [areas(s)[-1] for s in schedules]
    pick = lambda values, k: F.element_at(F.array(*[F.lit(float(x)) for x in values]), (k % len(values) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", pick(weights, F.col("rank")) * pick(totals, F.col("rank"))).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    # Walking sources by cap/weight, all before the first uncapped one are at their caps.
    level = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("rate", F.col("left") / F.col("weights_left"))
        .withColumn("fits", F.col("rate") * F.col("weight") <= F.col("cap"))
    )
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = level.withColumn("rate", F.first(F.when(F.col("fits"), F.col("rate")), ignorenulls=True).over(whole))
    return level.select("source", "source_size", "rank", F.least(F.col("cap"), F.coalesce(F.col("rate") * F.col("weight"), F.col("cap"))).alias("target"))


def _invert(u: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Time at which the schedule's integral reaches share u of its total: a quadratic per piece."""
    done = areas(knots)
    y, out = u * F.lit(done[-1]), F.lit(float(knots[-1][0]))
    for i in reversed(range(len(knots) - 1)):
        (a, w), (b, v) = knots[i], knots[i + 1]
        slope, z = (v - w) / (b - a), y - F.lit(done[i])
        root = z / F.lit(w) if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), F.lit(w * w) + F.lit(2 * slope) * z)) - F.lit(w)) / F.lit(slope)
        out = F.when(y < F.lit(done[i + 1]), F.lit(a) + root).otherwise(out)
    return F.least(F.greatest(out, F.lit(float(knots[0][0]))), F.lit(float(knots[-1][0])))


def _position(word: Column, schedules: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """Training time of a word on its source's line, of the columns target and rank."""
    share, out = F.when(F.col("target") > 0, F.least(F.lit(1.0), word / F.col("target"))).otherwise(0.0), F.lit(None).cast("double")
    for i, knots in reversed(list(enumerate(schedules))):
        out = F.when(F.col("rank") % len(schedules) == i, _invert(share, knots)).otherwise(out)
    return out


def plan_mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    max_epochs: float = 3.0,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    seed: str = "mix",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, start, position, order_key.

    `weights` and `schedules` go to sources in order of their names, repeating.
    `taken` counts the words of full passes and of the last, partial one, so a
    source's taken words equal its target rounded down. `start` is the document's
    first word on its source's line, `position` the training time of its first copy.
    """
    spark = docs.sparkSession
    ranges = max(64, 2 * spread(spark))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), _order_key(F.col(doc_id), F.col(text), seed).alias("order_key"))
    rows = cut(rows.withColumn("slice", F.floor(F.conv(F.substring("order_key", 1, 6), 16, 10).cast("double") * ranges / 16**6).cast("int")), "sizes")
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    slices = cut(slices, "slices")
    targets = source_targets(slices.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs, schedules)
    base = slices.withColumn("base", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    base = base.join(targets, base["source"].eqNullSafe(targets["source"])).select(base["source"].alias("of"), F.col("slice").alias("piece"), "base", "source_size", "rank", "target")
    inside = Window.partitionBy("source", "slice").orderBy("order_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(base, rows["source"].eqNullSafe(F.col("of")) & (F.col("slice") == F.col("piece")))
    rows = rows.withColumn("start", F.col("base") + F.col("inner"))
    goal, size = F.floor("target").cast("long"), F.col("source_size")
    passes = F.when(size > 0, F.floor(goal / size)).otherwise(0).cast("long")
    taken = passes * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), goal - passes * size - F.col("start")))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "start", _position(F.col("start"), schedules).alias("position"), "rank", "order_key")


def in_order(rows: DataFrame, *by: str | Column) -> DataFrame:
    """rows range-sorted by training position, and by what breaks its ties."""
    return rows.repartitionByRange(spread(rows.sparkSession), *by).sortWithinPartitions(*by)


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: str = "mix", **kw) -> DataFrame:
    """docs as the mix takes them, range-sorted by training position; same columns.

    A document appears once for each pass in which its middle word is within the
    target, so whole documents are kept and a source's words are within half a
    document of its target. Texts move in the join that brings positions to them (by
    order key) and, once per copy, in the range sort. Equal rows follow each other on
    their source's line, so one entry stands for all of them.
    """
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    at = {c: k for k, c in names.items()}
    plan = plan_mix(docs, text=text, source=source, doc_id=doc_id, seed=seed, **kw)
    plan = plan.groupBy("order_key", F.col("source").alias("of")).agg(F.min("start").alias("first"), *[F.first(c).alias(c) for c in ("size", "source_size", "target", "rank")])
    rows = docs.toDF(*names).withColumn("key", _order_key(F.col(at[doc_id]), F.col(at[text]), seed))
    out = rows.join(plan, (F.col("key") == F.col("order_key")) & F.col(at[source]).eqNullSafe(F.col("of")))
    plain = [c for c, kind in docs.toDF(*names).dtypes if not kind.startswith(("map", "variant"))]
    equal = F.row_number().over(Window.partitionBy("order_key", "of").orderBy(F.xxhash64(*plain))) - 1
    out = out.withColumn("start", F.col("first") + equal * F.col("size"))
    copies = F.when(F.col("source_size") > 0, F.ceil((F.col("target") - F.col("start") - F.col("size") / 2) / F.col("source_size"))).otherwise(1)
    out = out.withColumn("copies", copies.cast("int")).filter("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    out = out.withColumn("position", _position(F.col("start") + F.col("pass") * F.col("source_size"), kw.get("schedules", SCHEDULES)))
    return in_order(out, "position", "order_key", "pass").select(*[F.col(k).alias(c) for k, c in names.items()])
