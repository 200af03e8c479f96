"""Electrode layouts: coordinates, neighbours, spherical splines."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cartesian_2d(layout: DataFrame, radius: float = 1.0, keep_radial: bool = True) -> DataFrame:
    """inc, azi in degrees -> x2, y2: in units where inc of 90 is `radius`, or scaled to the largest."""
    inc, azi = F.radians("inc"), F.radians("azi")
    x, y = inc * F.cos(azi), inc * F.sin(azi)
    if keep_radial:
        scale = F.lit(2 / np.pi * radius)
    else:
        most = F.max(F.sqrt(x * x + y * y)).over(Window.partitionBy())
        scale = F.lit(radius) / F.nullif(most, F.lit(0.0))
    return layout.withColumns({"x2": x * scale, "y2": y * scale})


def cartesian_3d(layout: DataFrame) -> DataFrame:
    """inc, azi in degrees -> x3, y3, z3: on the unit sphere, centred, scaled by half the largest range."""
    inc, azi = F.radians("inc"), F.radians("azi")
    rows = layout.withColumns({"x3": F.sin(inc) * F.cos(azi), "y3": F.sin(inc) * F.sin(azi), "z3": F.cos(inc)})
    w = Window.partitionBy()
    lo, hi = {c: F.min(c).over(w) for c in ("x3", "y3", "z3")}, {c: F.max(c).over(w) for c in ("x3", "y3", "z3")}
    half = F.greatest(*[hi[c] - lo[c] for c in lo]) / 2
    return rows.withColumns({c: (F.col(c) - (lo[c] + hi[c]) / 2) / F.nullif(half, F.lit(0.0)) for c in lo})


def neighbours(layout: DataFrame, criterion: float, coordinates: Sequence[str] = ("x2", "y2"), label: str = "label") -> DataFrame:
    """(channel, neighbour, distance, weight) of pairs within the criterion; weights are inverse distances, summing to 1.

    Layouts are small dimension tables, so the pairs come from a theta join on a grid of the criterion's width.
    """
    a = layout.select(F.col(label).alias("channel"), *[F.col(c).cast("double").alias(f"_a{c}") for c in coordinates], F.floor(F.col(coordinates[0]) / criterion).alias("_cell"))
    b = layout.select(F.col(label).alias("neighbour"), *[F.col(c).cast("double").alias(f"_b{c}") for c in coordinates], F.explode(F.array(*[F.floor(F.col(coordinates[0]) / criterion) + i for i in (-1, 0, 1)])).alias("_cell"))
    total = F.lit(0.0)
    for c in coordinates:
        total = total + (F.col(f"_a{c}") - F.col(f"_b{c}")) * (F.col(f"_a{c}") - F.col(f"_b{c}"))
    pairs = a.join(b, "_cell").filter("channel <> neighbour").withColumn("distance", F.sqrt(total)).filter(F.col("distance") <= criterion)
    inverse = 1 / F.greatest(F.col("distance"), F.lit(1e-6))
    return pairs.select("channel", "neighbour", "distance", (inverse / F.sum(inverse).over(Window.partitionBy("channel"))).alias("weight"))


def mean_neighbours(edges: DataFrame, layout: DataFrame, label: str = "label") -> DataFrame:
    each = layout.select(F.col(label).alias("channel")).join(edges, "channel", "left").groupBy("channel").agg(F.count("neighbour").alias("n"))
    return each.agg(F.avg("n").alias("mean_neighbours"))


def weight_map(edges: DataFrame) -> dict[str, dict[str, float]]:
    """Neighbour weights on the driver; a layout has at most some hundred electrodes."""
    out: dict[str, dict[str, float]] = {}
    for r in edges.orderBy("channel", "neighbour").collect():
        out.setdefault(r["channel"], {})[r["neighbour"]] = r["weight"]
    return out


def neighbours_toml(edges: DataFrame) -> str:
    """The neighbour lists as TOML text: channels, distances and weights per electrode."""
    out = []
    rows = edges.orderBy("channel", "distance", "neighbour").collect()
    for name in dict.fromkeys(r["channel"] for r in rows):
        mine = [r for r in rows if r["channel"] == name]
        out.append(f'["{name}"]')
        out.append("channels = [" + ", ".join(f'"{r["neighbour"]}"' for r in mine) + "]")
        out += [f"{k}s = [" + ", ".join(f"{r[k]:.6g}" for r in mine) + "]" for k in ("distance", "weight")]
    return "\n".join(out) + "\n"


def subset_layout(layout: DataFrame, labels: Sequence[str], label: str = "label") -> DataFrame:
    return layout.filter(F.col(label).isin(list(labels)))


def rename_in_layout(layout: DataFrame, names: dict[str, str], label: str = "label") -> DataFrame:
    new = F.col(label)
    for a, b in names.items():
        new = F.when(F.col(label) == a, F.lit(b)).otherwise(new)
    return layout.withColumn(label, new)


def _legendre(x: np.ndarray, m: int, terms: int) -> np.ndarray:
    """Sum over n of (2n + 1) / (n (n + 1))^m P_n(x), over 4 pi."""
    p0, p1, out = np.ones_like(x), x.copy(), np.zeros_like(x)
    for n in range(1, terms + 1):
        out += (2 * n + 1) / (n * (n + 1)) ** m * p1
        p0, p1 = p1, ((2 * n + 1) * x * p1 - n * p0) / (n + 1)
    return out / (4 * np.pi)


def spherical_weights(source: np.ndarray, target: np.ndarray, m: int = 4, smoothing: float = 1e-5, terms: int = 50) -> np.ndarray:
    """Perrin's spherical-spline interpolation matrix: target rows from source columns."""
    unit = lambda p: p / np.linalg.norm(p, axis=1, keepdims=True)
    s, t = unit(np.asarray(source, float)), unit(np.asarray(target, float))
    g = _legendre(np.clip(s @ s.T, -1, 1), m, terms) + smoothing * np.eye(len(s))
    n = len(s)
    c = np.block([[g, np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    to = np.hstack([_legendre(np.clip(t @ s.T, -1, 1), m, terms), np.ones((len(t), 1))])
    return (to @ np.linalg.pinv(c))[:, :n]


def topography_grid(values: Sequence[float], points: np.ndarray, scale: int = 50, method: str = "thin_plate") -> np.ndarray:
    """Interpolates channel values on a square grid: thin_plate, inverse_distance, nearest or spherical (3-D points)."""
    side = np.linspace(-1, 1, scale)
    gx, gy = np.meshgrid(side, side)
    grid, v = np.column_stack([gx.ravel(), gy.ravel()]), np.asarray(values, float)
    p = np.asarray(points, float)
    if method == "spherical":
        r = np.clip(np.hypot(*grid.T), 1e-12, None)
        inc = r * np.pi / 2
        target = np.column_stack([np.sin(inc) * grid[:, 0] / r, np.sin(inc) * grid[:, 1] / r, np.cos(inc)])
        return (spherical_weights(p, target) @ v).reshape(scale, scale)
    d = np.linalg.norm(grid[:, None] - p[None, :, :2], axis=2)
    if method == "nearest":
        return v[d.argmin(axis=1)].reshape(scale, scale)
    if method == "inverse_distance":
        w = 1 / np.maximum(d, 1e-9) ** 2
        return ((w @ v) / w.sum(axis=1)).reshape(scale, scale)
    kernel = lambda r: np.where(r > 0, r * r * np.log(np.maximum(r, 1e-300)), 0)
    a = np.hstack([np.ones((len(p), 1)), p[:, :2]])
    k = np.block([[kernel(np.linalg.norm(p[:, None, :2] - p[None, :, :2], axis=2)), a], [a.T, np.zeros((3, 3))]])
    w = np.linalg.lstsq(k, np.concatenate([v, np.zeros(3)]), rcond=None)[0]
    return (kernel(d) @ w[:-3] + np.hstack([np.ones((len(grid), 1)), grid]) @ w[-3:]).reshape(scale, scale)


def best_rectangle(n: int) -> tuple[int, int]:
    """Rows and columns of the squarest grid that holds n cells."""
    rows = max(1, int(np.floor(np.sqrt(n))))
    return rows, -(-n // rows)
