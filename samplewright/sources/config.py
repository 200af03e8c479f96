"""Typed configuration: defaults, a user's TOML file over them, validation, and a template."""

from __future__ import annotations

import tomllib
from copy import deepcopy
from dataclasses import dataclass


@dataclass(frozen=True)
class Parameter:
    default: object
    about: str
    choices: tuple = ()
    least: float | None = None
    most: float | None = None


PARAMETERS: dict[str, Parameter] = {
    "files.input.directory": Parameter(".", "where recordings are"),
    "files.input.labels": Parameter([], "channels to read"),
    "files.output.directory": Parameter("./out", "where results go"),
    "preprocess.epoch_start": Parameter(-0.5, "seconds before time zero", most=0.0),
    "preprocess.epoch_end": Parameter(1.0, "seconds after time zero", least=0.0),
    "preprocess.reference": Parameter("avg", "avg, mastoid, none or channel names"),
    "preprocess.highpass.apply": Parameter(True, "whether to high-pass"),
    "preprocess.highpass.cutoff": Parameter(0.1, "Hz", least=0.0),
    "preprocess.highpass.order": Parameter(1, "filter order", least=1),
    "preprocess.lowpass.apply": Parameter(False, "whether to low-pass"),
    "preprocess.lowpass.cutoff": Parameter(30.0, "Hz", least=0.0),
    "preprocess.lowpass.order": Parameter(3, "filter order", least=1),
    "preprocess.lowpass.method": Parameter("iir", "filter kind", ("iir", "fir")),
    "preprocess.eog.vertical": Parameter([[], []], "two lists of channels"),
    "preprocess.eog.horizontal": Parameter([[], []], "two lists of channels"),
    "preprocess.eog.vertical_criterion": Parameter(50.0, "jump that counts as an onset", least=0.0),
    "preprocess.eog.horizontal_criterion": Parameter(30.0, "jump that counts as an onset", least=0.0),
    "preprocess.extreme_value": Parameter(500.0, "absolute value of an extreme sample", least=0.0),
    "preprocess.artifact_value": Parameter(100.0, "absolute value that rejects a trial", least=0.0),
    "preprocess.z_criterion": Parameter(0.0, "z-score that rejects a trial; 0 is off", least=0.0),
    "preprocess.neighbour_criterion": Parameter(0.5, "distance of neighbours", least=0.0),
    "ica.apply": Parameter(False, "whether to remove components"),
    "ica.percentage": Parameter(100.0, "share of samples to fit on", least=0.0, most=100.0),
}


def defaults() -> dict:
    out: dict = {}
    for name, p in PARAMETERS.items():
        at = out
        *path, last = name.split(".")
        for k in path:
            at = at.setdefault(k, {})
        at[last] = deepcopy(p.default)
    return out


def merge(base: dict, over: dict) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def get(config: dict, name: str):
    for k in name.split("."):
        config = config[k]
    return config


def validate(config: dict) -> dict:
    for name, p in PARAMETERS.items():
        v = get(config, name)
        if isinstance(p.default, float) and isinstance(v, int) and not isinstance(v, bool):
            v = float(v)
            at = config
            *path, last = name.split(".")
            for k in path:
                at = at[k]
            at[last] = v
        if name != "preprocess.reference" and type(v) is not type(p.default):
            raise ValueError(f"{name} must be {type(p.default).__name__}, not {v!r}")
        if p.choices and v not in p.choices:
            raise ValueError(f"{name} must be one of {p.choices}")
        if (p.least is not None and v < p.least) or (p.most is not None and v > p.most):
            raise ValueError(f"{name} is out of range: {v}")
    return config


def read_config(path: str | None = None, text: str | None = None) -> dict:
    """Defaults with a file's (or a text's) settings over them."""
    user: dict = {}
    if path:
        with open(path, "rb") as f:
            user = tomllib.load(f)
    elif text:
        user = tomllib.loads(text)
    return validate(merge(defaults(), user))


def _toml(v) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return "[" + ", ".join(map(_toml, v)) + "]" if isinstance(v, (list, tuple)) else repr(v)


def template() -> str:
    """A TOML file with every parameter at its default."""
    out, section = [], None
    for name, p in sorted(PARAMETERS.items(), key=lambda kv: kv[0].rsplit(".", 1)[0]):
        head, last = name.rsplit(".", 1)
        if head != section:
            out += ["", f"[{head}]"]
            section = head
        out.append(f"{last} = {_toml(p.default)}  # {p.about}")
    return "\n".join(out).strip() + "\n"
