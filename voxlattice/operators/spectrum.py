"""Fourier transforms of grids, one axis at a time: each grid line is a row, lines of an axis run in parallel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def _lines(rows: DataFrame, axis: str, size: str, fields: list[str], keys: list[str], inverse: bool) -> DataFrame:
    """Transform along one axis. Each field is a pair of columns <field>_re and <field>_im; absent places are zero."""
    parts = [f"{f}_{p}" for f in fields for p in ("re", "im")]
    kept = [*keys, *[a for a in AXES if a != axis]]
    lines = rows.groupBy(*kept).agg(F.collect_list(F.struct(axis, *parts)).alias("cells"))
    lines = lines.select(*kept, F.col(f"cells.{axis}").alias("at"), *[F.col(f"cells.{p}").alias(p) for p in parts])
    kind = {f.name: f.dataType.simpleString() for f in lines.schema}
    schema = ", ".join(f"{k} {kind[k]}" for k in kept) + ", " + ", ".join(f"{p} array<double>" for p in parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[kept].copy()
            made: dict[str, list] = {p: [] for p in parts}
            for f in fields:
                for n, at, re, im in zip(b[size], b["at"], b[f"{f}_re"], b[f"{f}_im"]):
                    v = np.zeros(int(n), complex)
                    v[np.asarray(at, int)] = np.asarray(re, float) + 1j * np.asarray(im, float)
                    v = np.fft.ifft(v) if inverse else np.fft.fft(v)
                    made[f"{f}_re"].append(v.real)
                    made[f"{f}_im"].append(v.imag)
            yield out.assign(**made)

    dense = lines.mapInPandas(run, schema).select(*kept, F.posexplode(F.arrays_zip(*parts)).alias(axis, "c"))
    return dense.select(*kept, F.col(axis).cast("long").alias(axis), *[F.col(f"c.{p}").alias(p) for p in parts])


def transform(rows: DataFrame, fields: list[str], keys: list[str], inverse: bool = False) -> DataFrame:
    """The discrete transform of every key's grid: rows (keys, z, y, x, <field>_re, <field>_im) with places from 0.

    The keys hold the grid's sizes as columns nz, ny and nx. No task holds more of a grid than some of its lines.
    """
    for axis in AXES:
        rows = _lines(rows, axis, f"n{axis}", fields, keys, inverse)
    return rows


def lag(axis: str):
    """The signed lag that a place along an axis stands for."""
    n = F.col(f"n{axis}")
    return F.when(2 * F.col(axis) > n, F.col(axis) - n).otherwise(F.col(axis))
