"""Analysis settings applied as one chain: filters, reference, repair, regions, components."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from . import artifacts, filters, ica, process, select


@dataclass(frozen=True)
class Settings:
    highpass: float | None = None
    lowpass: float | None = None
    reference: str | Sequence[str] = "none"
    repaired: tuple[str, ...] = ()
    repair_method: str = "neighbour_interpolation"
    regions: tuple[tuple[float, float], ...] = ()
    removed_components: tuple[int, ...] = ()
    extra: dict = field(default_factory=dict, compare=False)


def apply_settings(
    df: DataFrame,
    settings: Settings,
    names: Sequence[str],
    rate: float,
    keys: Sequence[str] = ("participant",),
    by: str = "sample",
    weights: dict[str, dict[str, float]] | None = None,
    positions: dict[str, tuple[float, float, float]] | None = None,
    model: ica.Ica | None = None,
) -> DataFrame:
    """High pass, low pass, reference, channel repair, flagged regions, component removal, in that order.

    Samples in the regions are marked in `is_selected_region`, not dropped.
    """
    if settings.highpass is not None:
        df = filters.highpass(df, settings.highpass, rate, keys, names, by=by)
    if settings.lowpass is not None:
        df = filters.lowpass(df, settings.lowpass, rate, keys, names, by=by)
    df = process.rereference(df, settings.reference, list(names))
    if settings.repaired:
        if settings.repair_method == "spherical_spline":
            df = artifacts.repair_spherical(df, list(names), list(settings.repaired), positions or {})
        else:
            df = artifacts.repair_neighbours(df, list(names), list(settings.repaired), weights or {})
    if settings.regions:
        df = df.withColumn("is_selected_region", select.in_regions("time", settings.regions))
    if settings.removed_components:
        if model is None:
            raise ValueError("removing components needs a model")
        df = ica.remove_components(df, model, settings.removed_components)[0]
    return df
