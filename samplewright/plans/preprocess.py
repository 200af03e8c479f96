"""Raw recordings to cleaned trials and averages, for all files in one plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import artifacts, average, channels, epochs, filters, ica, layout, process, select
from ..sources import config as cfg


@dataclass(frozen=True)
class Preprocessed:
    continuous: DataFrame
    epochs: DataFrame
    clean_epochs: DataFrame
    erps: DataFrame
    bad_channels: DataFrame
    rejected: DataFrame
    comparison: DataFrame
    summary: DataFrame


def preprocess(
    recording: DataFrame,
    names: Sequence[str],
    positions: DataFrame,
    conditions: Sequence[epochs.EpochCondition],
    rate: float,
    config: dict | None = None,
    key: str = "participant",
    from_raw: bool = True,
) -> Preprocessed:
    """Reference, filters, EOG, extreme samples, bad channels, components, epochs, two rejections with repair between.

    `positions` is a layout with x2 and y2. `from_raw` is off for recordings that
    are referenced and filtered already. Each transform covers all recordings; components
    are fitted, identified and removed for each recording by itself.
    """
    c = config or cfg.defaults()
    p, names, keys = c["preprocess"], list(names), [key]
    x = recording
    if from_raw:
        x = process.rereference(x, p["reference"], names)
        if p["highpass"]["apply"]:
            x = filters.highpass(x, p["highpass"]["cutoff"], rate, keys, names, p["highpass"]["order"])
        if p["lowpass"]["apply"]:
            x = filters.lowpass(x, p["lowpass"]["cutoff"], rate, keys, names, p["lowpass"]["order"], p["lowpass"]["method"])
    eog = p["eog"]
    has_eog = all(eog["vertical"]) and all(eog["horizontal"])

    def with_eog(df):
        return select.eog_channels(df, tuple(eog["vertical"]), tuple(eog["horizontal"])) if has_eog else df

    x = with_eog(x)
    if has_eog:
        x = artifacts.eog_onsets(x, "vEOG", eog["vertical_criterion"], rate, keys, "is_vEOG")
        x = artifacts.eog_onsets(x, "hEOG", eog["horizontal_criterion"], rate, keys, "is_hEOG")
    x = artifacts.extreme_values(x, names, p["extreme_value"], out="is_extreme_value")
    good = x.filter(~F.col("is_extreme_value"))
    summary = channels.channel_summary(good, names, keys)
    joint = channels.joint_probability(good, names, keys)
    bad = summary.filter(F.abs("zvar") > 3).select(key, "channel").union(joint.filter("rejected").select(key, "channel")).distinct()
    edges = layout.neighbours(positions, p["neighbour_criterion"])
    bad = artifacts.repairable(bad, edges, keys)
    if c["ica"]["apply"]:
        models = ica.fit_each(good, names, keys, ("sample",), percentage=c["ica"]["percentage"], eog=("vEOG", "hEOG") if has_eog else (), rate=rate)
        x = with_eog(ica.remove_each(x, models, names, keys))
    weights = layout.weight_map(edges)
    x = artifacts.repair_epochs(x, names, bad.filter("repairable").select(key, "channel"), weights, keys)
    x = artifacts.extreme_values(with_eog(x), names, p["extreme_value"], out="is_extreme_value")
    cut = epochs.extract(x, conditions, (p["epoch_start"], p["epoch_end"]), rate, keys)
    trial = [key, "condition"]
    cut = process.baseline(cut, [*trial, "epoch"], names, None)
    first = artifacts.bad_epochs(cut, names, p["z_criterion"], p["artifact_value"], keys=trial)
    fixable = artifacts.repairable(first.select(*trial, "epoch", "channel"), edges, [*trial, "epoch"]).filter("repairable")
    repaired = artifacts.repair_epochs(cut, names, fixable.select(*trial, "epoch", "channel"), weights, [*trial, "epoch"])
    second = artifacts.bad_epochs(repaired, names, p["z_criterion"], p["artifact_value"], keys=trial)
    clean = artifacts.reject(repaired, second, [*trial, "epoch"])
    erps = average.average_epochs(clean, [*trial, "condition_name"], names)
    return Preprocessed(x, cut, clean, erps, bad, second, artifacts.compare_rejections(first, second, trial), average.epochs_table(cut, clean, trial))
