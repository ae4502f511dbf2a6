"""How precise a subset's fitted displacement is: normal equations summed over its voxels, and what grey-value noise makes of them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement as pairs

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

#: The twelve parameters: component a of the displacement times coordinate b (x, y, z), then the three displacements.
PARAMETERS = [(a, b) for a in range(3) for b in range(3)] + [(a, 3) for a in range(3)]
_GG, _QQ = list(pairs(range(3), 2)), list(pairs(range(4), 2))


def normal_equations(voxels: DataFrame, grey: str, gradient: tuple[str, str, str], offset: tuple[str, str, str], *keys: str) -> DataFrame:
    """(keys, n, mean, contrast, products): a subset's voxels summed up in one aggregate.

    A voxel's row of the Jacobian is gradient a times (offset x, y, z or 1), so of the 144 sums only the 6 products of
    gradients times the 10 products of offsets differ: `products` holds those 60. Voxels with a null grey value or
    gradient are left out; `contrast` is the root of the summed squared deviations.
    """
    q = [*map(F.col, offset), F.lit(1.0)]
    rows = voxels.where(F.col(grey).isNotNull() & F.col(gradient[0]).isNotNull() & F.col(gradient[1]).isNotNull() & F.col(gradient[2]).isNotNull())
    sums = [F.sum(F.col(gradient[a]) * F.col(gradient[c]) * q[b] * q[d]) for a, c in _GG for b, d in _QQ]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(grey).alias("mean"), F.sqrt(F.var_pop(grey) * F.count("*")).alias("contrast"), F.array(*sums).alias("products"))


def entry(i: int, j: int, products: str = "products") -> Column:
    """Entry (i, j) of the 12 x 12 matrix as a column."""
    (a, b), (c, d) = PARAMETERS[i], PARAMETERS[j]
    return F.col(products)[_GG.index((min(a, c), max(a, c))) * len(_QQ) + _QQ.index((min(b, d), max(b, d)))]


def moments(half: Column, stride: Column) -> tuple[Column, Column]:
    """Along one axis: how many places -half, -half + stride, ... up to half there are, and the sum of their squares."""
    n = F.floor(2 * half / stride).cast("long") + 1
    return n, n * half * half - half * stride * n * (n - 1) + stride * stride * (n - 1) * n * (2 * n - 1) / 6


def _pattern(half: tuple[int, int, int], stride: int) -> np.ndarray:
    """What white noise of variance one in the gradients adds to the matrix, for a whole subset."""
    axes = [np.arange(-h, h + 1, stride, dtype=float) for h in half]
    q = np.stack([*(g.ravel() for g in np.meshgrid(*axes, indexing="ij")), np.ones(int(np.prod([len(a) for a in axes])))])
    return np.array([[float(q[b] @ q[d]) if a == c and b == d else 0.0 for c, d in PARAMETERS] for a, b in PARAMETERS])


def displacement_deviation(sums: DataFrame, zncc: str, half: tuple[int, int, int], stride: int = 1, gain: float = 2 * (0.75**2 + 0.15**2 + 1 / 60**2), corrected: bool = True) -> DataFrame:
    """Rows of normal_equations with a correlation get su, sv, sw: standard deviations of the displacement in voxels.

    Noise in both volumes lowers the correlation and, through the gradients, inflates the matrix; `gain` is what the gradient's
    stencil makes of a unit variance (the seven-point stencil by default). With `corrected` the inflation is taken off, a
    tenth of the displacements' diagonal being left at least, and the noise of the gradients itself is added. Subsets with 14
    voxels or fewer, without a correlation or without texture in some direction get null; where so much noise is taken off that
    a variance would be negative, the deviation is 0 and says nothing.
    """
    pattern = _pattern(half, stride)
    names = ["su", "sv", "sw"]
    index = np.array([[_GG.index((min(a, c), max(a, c))) * len(_QQ) + _QQ.index((min(b, d), max(b, d))) for c, d in PARAMETERS] for a, b in PARAMETERS])
    schema = StructType([*sums.schema.fields, *(StructField(c, DoubleType()) for c in names), StructField("defined", BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.full((len(b), 3), np.nan)
            n, z = b["n"].to_numpy(float), b[zncc].to_numpy(float)
            for k in np.flatnonzero((n > 14) & np.isfinite(z)):
                h = np.asarray(b["products"].iloc[k], float)[index]
                lost = max(1 - z[k], 0.0) * float(b["contrast"].iloc[k]) ** 2
                per_voxel, noise = lost / n[k], gain * pattern * (n[k] / pattern[9, 9])
                if corrected:
                    inflated = per_voxel * noise
                    bound = [0.9 * h[i, i] / inflated[i, i] for i in (9, 10, 11) if inflated[i, i] > 0]
                    h = h - min([1.0, *bound]) * inflated
                scale = np.sqrt(np.abs(np.diag(h)))
                if not (scale > 0).all() or np.linalg.cond(h / np.outer(scale, scale)) > 1e12:
                    continue
                inverse = np.linalg.inv(h)
                variance = 2 * lost / (n[k] - 12) * np.diag(inverse)
                if corrected:
                    variance = variance + per_voxel**2 * np.diag(inverse @ noise @ inverse)
                out[k] = np.sqrt(np.maximum(variance[9:], 0.0))
            yield b.assign(**dict(zip(names, out.T)), defined=~np.isnan(out[:, 0]))

    done = sums.mapInPandas(run, schema)
    return done.withColumns({c: F.when(F.col("defined"), F.col(c)) for c in names}).drop("defined")
