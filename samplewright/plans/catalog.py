"""All of the engine's queries and their SQL twins."""

from __future__ import annotations

from . import q_analysis, q_averages, q_signals, q_tables  # noqa: F401  (they register themselves)
from .registry import ORACLES, QUERIES

FLAGSHIP = "mean_amplitude"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
