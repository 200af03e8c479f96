"""Grouped Arrow kernels: one numpy function per series.

Series are rows of (keys, order, channels). Each group is one series, a unit of
recording or trial, so groups stay small however many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_shipped: set[str] = set()


def ship(df: DataFrame) -> None:
    """Sends this package to the executors' Python workers, once per application."""
    import tempfile
    import zipfile

    sc = df.sparkSession.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="samplewright-")) / "samplewright_engine.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, f"samplewright/{path.relative_to(root)}")
    sc.addPyFile(str(target))


def map_series(df: DataFrame, keys: Sequence[str], order: str, names: Sequence[str], kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Replaces the channel columns of each series by kernel(samples x channels); other columns stay."""
    ship(df)
    names = list(names)

    def run(table):
        import pyarrow as pa

        table = table.sort_by(order)
        x = np.column_stack([table.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names])
        y = kernel(x)
        for i, n in enumerate(names):
            table = table.set_column(table.schema.get_field_index(n), n, pa.array(y[:, i], pa.float64()))
        return table

    schema = T.StructType([T.StructField(f.name, T.DoubleType()) if f.name in names else f for f in df.schema])
    if not keys:
        raise ValueError("series need a key")
    return df.groupBy(*keys).applyInArrow(run, schema)


def reduce_series(df: DataFrame, keys: Sequence[str], order: str, names: Sequence[str], kernel: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], out: str) -> DataFrame:
    """One small table per series: kernel(order values, samples x channels) -> columns `out` (a DDL string)."""
    ship(df)
    names, keys = list(names), list(keys)
    types = {f.name: f for f in df.schema}
    fields = T.StructType.fromDDL(out).fields
    schema = T.StructType([types[k] for k in keys] + fields)

    def run(table):
        import pyarrow as pa

        table = table.sort_by(order)
        x = np.column_stack([table.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names])
        got = kernel(table.column(order).to_numpy(zero_copy_only=False), x)
        n = len(next(iter(got.values())))
        cols = {k: pa.array([table.column(k)[0].as_py()] * n, table.schema.field(k).type) for k in keys}
        return pa.table(cols | {f.name: pa.array(got[f.name], pa.float64() if isinstance(f.dataType, T.DoubleType) else None) for f in fields})

    return df.select(*keys, *([order] if order not in keys else []), *[n for n in names if n not in keys]).groupBy(*keys).applyInArrow(run, schema)
