"""Column roles, projections and row subsets of wide sample tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Roles:
    """Which columns are metadata, channels and extra; kept beside the table, never guessed from order later."""

    meta: tuple[str, ...]
    channels: tuple[str, ...]
    extra: tuple[str, ...] = ()

    @classmethod
    def of(cls, df: DataFrame, labels: Iterable[str]) -> Roles:
        """From layout labels: columns before the first channel are metadata, after the last extra."""
        labels = set(labels)
        at = [i for i, c in enumerate(df.columns) if c in labels]
        if not at:
            return cls(tuple(df.columns), ())
        cols = df.columns
        between = [c for c in cols[at[0] : at[-1] + 1] if c not in labels]
        return cls(tuple(cols[: at[0]]), tuple(cols[i] for i in at), tuple(between) + tuple(cols[at[-1] + 1 :]))

    def select(self, df: DataFrame, *groups: str) -> DataFrame:
        return df.select(*[c for g in groups for c in getattr(self, g)])


Selector = Callable[[Sequence[str]], list[str]]


def channels(*wanted) -> Selector:
    """Names, 1-based numbers, ranges or a predicate on names; nothing means all. Keeps the order asked for."""

    def pick(names: Sequence[str]) -> list[str]:
        if not wanted:
            return list(names)
        out: list[str] = []
        for w in wanted:
            if callable(w):
                out += [n for n in names if w(n)]
            elif isinstance(w, range):
                out += [names[i - 1] for i in w if 0 < i <= len(names)]
            elif isinstance(w, int):
                out += [names[w - 1]] if 0 < w <= len(names) else []
            elif isinstance(w, str):
                out += [w] if w in names else []
            else:
                out += pick_each(w, names)
        return list(dict.fromkeys(out))

    def pick_each(items, names):
        return channels(*items)(names)

    return pick


def channels_not(*wanted) -> Selector:
    inner = channels(*wanted)
    return lambda names: [n for n in names if n not in set(inner(names))] if wanted else []


def select_channels(df: DataFrame, roles: Roles, which: Selector | None = None, include_meta: bool = True, include_extra: bool = True) -> DataFrame:
    names = [*roles.channels, *(roles.extra if include_extra else ())]
    return df.select(*(roles.meta if include_meta else ()), *(which or channels())(names))


def interval(time: str = "time", between: tuple[float, float] | None = None) -> Column:
    """Closed interval of seconds; None is everything."""
    return F.lit(True) if between is None else F.col(time).between(*between)


def flags(names: Sequence[str], how: str = "and") -> Column:
    """Boolean columns combined row by row: and, or, nand, nor."""
    cols = [F.coalesce(F.col(n), F.lit(False)) for n in names]
    joined = reduce(lambda a, b: a & b, cols) if how in ("and", "nand") else reduce(lambda a, b: a | b, cols)
    if how not in ("and", "or", "nand", "nor"):
        raise ValueError(f"unknown operation {how}")
    return ~joined if how in ("nand", "nor") else joined


def combine_flags(df: DataFrame, names: Sequence[str], how: str = "and", out: str = "combined_flags") -> DataFrame:
    return df.withColumn(out, flags(names, how))


def numbered(df: DataFrame, column: str, keys: Sequence[str] = (), out: str = "number") -> DataFrame:
    """Adds the 1-based position of `column` among its distinct values within keys."""
    return df.withColumn(out, F.dense_rank().over(Window.partitionBy(*keys).orderBy(column)))


def subset(
    df: DataFrame,
    between: tuple[float, float] | None = None,
    samples: Column | None = None,
    epochs: Iterable[int] | None = None,
    conditions: Iterable | None = None,
    participants: Iterable | None = None,
    columns: Sequence[str] | None = None,
    time: str = "time",
) -> DataFrame:
    """All given restrictions at once, as one filter that reaches the scan."""
    test = interval(time, between)
    for name, values in (("epoch", epochs), ("condition", conditions), ("participant", participants)):
        if values is not None:
            test = test & F.col(name).isin(list(values))
    if samples is not None:
        test = test & samples
    out = df.filter(test)
    return out.select(*columns) if columns else out


def rename_channels(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """All at once, so swaps are safe; two columns of one name are an error."""
    out = [names.get(c, c) for c in df.columns]
    if len(set(out)) < len(out):
        raise ValueError("two columns would have one name")
    return df.toDF(*out)


def drop_channels(df: DataFrame, *names: str) -> DataFrame:
    missing = set(names) - set(df.columns)
    if missing:
        raise ValueError(f"no such channels: {sorted(missing)}")
    return df.drop(*names)


def row_mean(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(n) for n in names]) / F.lit(float(len(names)))


def channel_average(df: DataFrame, groups: Sequence[Sequence[str]], labels: Sequence[str] | None = None, all_channels: Sequence[str] = (), reduce_to: Sequence[str] | None = None) -> DataFrame:
    """Row means of channel groups as new columns, `avg` for all channels, else the names joined by _."""
    labels = labels or ["avg" if set(g) == set(all_channels) else "_".join(g) for g in groups]
    new = [row_mean(g).alias(n) for g, n in zip(groups, labels, strict=True)]
    return df.select(*(reduce_to if reduce_to is not None else df.columns), *new)


def channel_difference(df: DataFrame, first: Sequence[str], second: Sequence[str], out: str = "diff") -> DataFrame:
    return df.withColumn(out, row_mean(first) - row_mean(second))


def eog_channels(df: DataFrame, vertical: tuple[Sequence[str], Sequence[str]], horizontal: tuple[Sequence[str], Sequence[str]]) -> DataFrame:
    return df.withColumns({"vEOG": row_mean(vertical[0]) - row_mean(vertical[1]), "hEOG": row_mean(horizontal[0]) - row_mean(horizontal[1])})


def head(df: DataFrame, n: int = 5, by: Sequence[str] = ("sample",)) -> DataFrame:
    return df.orderBy(*by).limit(n)


def tail(df: DataFrame, n: int = 5, by: Sequence[str] = ("sample",)) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in by]).limit(n).orderBy(*by)


def melt(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Wide to long: keys, channel, value."""
    return df.unpivot(list(keys), list(names), "channel", "value")


def widen(df: DataFrame, keys: Sequence[str], names: Sequence[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys).pivot("channel", list(names)).agg(F.first(value))


def value_limits(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: least and greatest value over the columns."""
    low, high = [F.min(n) for n in names], [F.max(n) for n in names]
    return df.agg((F.least(*low) if len(low) > 1 else low[0]).alias("low"), (F.greatest(*high) if len(high) > 1 else high[0]).alias("high"))


def detrend(df: DataFrame, keys: Sequence[str], x: str = "time", y: str = "value", out: str = "detrended") -> DataFrame:
    """y minus its least-squares line over x, per key."""
    w = Window.partitionBy(*keys)
    slope = F.coalesce(F.when(F.var_pop(x).over(w) * F.count(x).over(w) >= 1e-15, F.regr_slope(y, x).over(w)), F.lit(0.0))
    return df.withColumn(out, F.col(y) - (F.avg(y).over(w) + slope * (F.col(x) - F.avg(x).over(w))))


def consecutive(df: DataFrame, keys: Sequence[str], order: str, column: str, step: int = 1, how: Callable[[Column, Column], Column] = lambda a, b: a - b, out: str = "change") -> DataFrame:
    """how(value `step` rows later, value)."""
    return df.withColumn(out, how(F.lead(column, step).over(Window.partitionBy(*keys).orderBy(order)), F.col(column)))


def split_groups(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Runs of consecutive integers: keys, first, last."""
    island = F.col(column) - F.row_number().over(Window.partitionBy(*keys).orderBy(column))
    return df.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(column).alias("first"), F.max(column).alias("last")).drop("_island")


def index_range(df: DataFrame, keys: Sequence[str], between: tuple[float, float], time: str = "time", pos: str = "pos") -> DataFrame:
    """First position at or after the start and last at or before the end."""
    return df.groupBy(*keys).agg(F.min(F.when(F.col(time) >= between[0], F.col(pos))).alias("start"), F.max(F.when(F.col(time) <= between[1], F.col(pos))).alias("end"))


def nearest(df: DataFrame, keys: Sequence[str], wanted: Sequence[float], time: str = "time", pos: str = "pos") -> DataFrame:
    """The sample nearest to each requested time within the range, the earlier one on ties: keys, wanted, pos, time."""
    aggs = [
        F.when((F.min(time) <= t) & (F.max(time) >= t), F.min(F.struct(F.abs(F.col(time) - t).alias("d"), F.col(pos).alias("pos"), F.col(time).alias("time")))).alias(f"w{i}")
        for i, t in enumerate(wanted)
    ]
    found = df.groupBy(*keys).agg(*aggs)
    long = found.select(*keys, F.explode(F.array(*[F.struct(F.lit(float(t)).alias("wanted"), F.col(f"w{i}").alias("hit")) for i, t in enumerate(wanted)])).alias("x"))
    return long.filter(F.col("x.hit").isNotNull()).select(*keys, "x.wanted", "x.hit.pos", "x.hit.time").withColumn(
        "_prev", F.lag("pos").over(Window.partitionBy(*keys).orderBy("wanted"))
    ).filter(F.col("_prev").isNull() | (F.col("_prev") != F.col("pos"))).drop("_prev")


def in_regions(time: str, regions: Sequence[tuple[float, float]]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(time).between(a, b) for a, b in regions], F.lit(False))


def natural_key(column: str | Column) -> Column:
    """Digit runs padded to ten digits, so that names sort by number."""
    column = F.col(column) if isinstance(column, str) else column
    parts = F.regexp_extract_all(column, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$") & (F.length(p) < 10), F.lpad(p, 10, "0")).otherwise(p)), "")


def participant_of(path: str | Column) -> Column:
    """The last run of digits in a file's stem, else a number from its hash."""
    path = F.col(path) if isinstance(path, str) else path
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    runs = F.regexp_extract_all(stem, F.lit(r"(\d+)"), F.lit(1))
    return F.when(F.size(runs) > 0, F.element_at(runs, -1).cast("long")).otherwise(F.pmod(F.xxhash64(stem), F.lit(10000)))


def extract_int(text: str) -> int | None:
    digits = re.sub(r"\D", "", text)
    return int(digits) if digits else None


def parse_ints(text: str) -> list[int]:
    """ "1,3:5;8" -> [1, 3, 4, 5, 8]."""
    if "." in text:
        raise ValueError("whole numbers only")
    out: set[int] = set()
    for part in re.split(r"[,;\s]+", text.strip()):
        if ":" in part:
            a, b = part.split(":")
            out |= set(range(int(a), int(b) + 1))
        elif part:
            out.add(int(part))
    return sorted(out)
