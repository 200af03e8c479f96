"""Per-row and per-series transforms: baseline, reference, moving means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .select import row_mean


def baseline(df: DataFrame, keys: Sequence[str], names: Sequence[str], between: tuple[float, float] | None, time: str = "time") -> DataFrame:
    """Subtracts each series' mean over a closed interval (None: over all of it)."""
    w = Window.partitionBy(*keys)
    inside = F.lit(True) if between is None else F.col(time).between(*between)
    return df.withColumns({n: F.col(n) - F.avg(F.when(inside, F.col(n))).over(w) for n in names})


def rereference(df: DataFrame, reference: str | Sequence[str], layout_channels: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """Subtracts the row mean of reference channels: "avg" (all), "mastoid" (M1, M2), "none", or a list."""
    names = list(names or layout_channels)
    if reference == "none":
        return df
    ref = list(layout_channels) if reference == "avg" else ["M1", "M2"] if reference == "mastoid" else [reference] if isinstance(reference, str) else list(reference)
    missing = set(ref) - set(df.columns)
    if missing:
        raise ValueError(f"no such reference channels: {sorted(missing)}")
    mean = row_mean(ref)
    new = {n: (F.col(n) - mean) for n in names}
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def linear_map(df: DataFrame, names: Sequence[str], matrix: Sequence[Sequence[float]], offset: Sequence[float] | None = None) -> DataFrame:
    """x' = M x + c over channel columns, in one projection; reference, repair and component removal are such maps."""
    out = {}
    for i, n in enumerate(names):
        terms = [F.col(c) * F.lit(float(w)) for c, w in zip(names, matrix[i], strict=True) if w != 0]
        total = F.lit(float(offset[i]) if offset is not None else 0.0)
        for t in terms:
            total = total + t
        out[n] = total
    return df.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])


def moving_mean(df: DataFrame, keys: Sequence[str], order: str, names: Sequence[str], window: int) -> DataFrame:
    """Mean over `window` // 2 rows on either side, truncated at the ends."""
    h = window // 2
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-h, h)
    return df.withColumns({n: F.avg(n).over(w) for n in names})
