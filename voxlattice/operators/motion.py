"""Rigid and affine motions of displacement fields: one aggregate of moments, a 3x3 fit on each aggregated row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

_X, _U = ("x", "y", "z"), ("u", "v", "w")
LEAST = {"translation": 1, "rigid": 3, "affine": 4}


def fit(field: DataFrame, kind: str, *keys: str) -> DataFrame:
    """(keys, n, c1..c3, t1..t3, a11..a33): the motion x -> A (x - c) + c + t of each key's rows with all components.

    A key with fewer rows than the fit needs gives nulls. Rigid motions never mirror.
    """
    moved = {f"q{i}": F.col(a) + F.col(b) for i, (a, b) in enumerate(zip(_X, _U))}
    rows = field.dropna(subset=[*_X, *_U]).withColumns(moved)
    agg = [F.count("*").alias("n")]
    agg += [F.avg(a).alias(f"c{i}") for i, a in enumerate(_X)] + [F.avg(f"q{i}").alias(f"d{i}") for i in range(3)]
    agg += [F.covar_pop(f"q{i}", a).alias(f"m{i}{j}") for i in range(3) for j, a in enumerate(_X)]
    agg += [F.covar_pop(a, b).alias(f"p{i}{j}") for i, a in enumerate(_X) for j, b in enumerate(_X)]
    moments = rows.groupBy(*keys).agg(*agg)
    names = [f"c{i}" for i in (1, 2, 3)] + [f"t{i}" for i in (1, 2, 3)] + [f"a{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in moments.schema if f.name in keys) + ", n long, " + ", ".join(f"{c} double" for c in names)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[[*keys, "n"]].copy()
            q, p = (b[[f"{k}{i}{j}" for i in range(3) for j in range(3)]].to_numpy().reshape(-1, 3, 3) for k in "mp")
            c, d = (b[[f"{k}{i}" for i in range(3)]].to_numpy() for k in "cd")
            if kind == "rigid":
                left, _, right = np.linalg.svd(q)
                flip = np.sign(np.linalg.det(left @ right))
                left[:, :, 2] *= np.where(flip == 0, 1, flip)[:, None]
                a = left @ right
            elif kind == "affine":
                a = q @ np.linalg.pinv(p)
            else:
                a = np.broadcast_to(np.eye(3), q.shape)
            values = np.hstack([c, d - c, a.reshape(-1, 9)])
            values[b["n"].to_numpy() < LEAST[kind]] = np.nan
            out[names] = values
            yield out

    fitted = moments.mapInPandas(solve, schema)
    return fitted.select(*keys, "n", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in names])


def remove(field: DataFrame, motions: DataFrame, kind: str, *keys: str) -> DataFrame:
    """The field without each key's motion: rigid ones by the inverse motion of the moved points, others by subtraction."""
    j = field.join(motions.drop("n"), list(keys)) if keys else field.crossJoin(F.broadcast(motions.drop("n")))
    off = [F.col(a) - F.col(f"c{i}") for i, a in enumerate(_X, 1)]
    if kind == "rigid":
        moved = [o + F.col(b) - F.col(f"t{i}") for i, (o, b) in enumerate(zip(off, _U), 1)]
        new = [sum((F.col(f"a{k}{i}") * moved[k - 1] for k in (1, 2, 3)), F.lit(0.0)) - off[i - 1] for i in (1, 2, 3)]
    else:
        new = [F.col(b) - F.col(f"t{i}") - (sum((F.col(f"a{i}{k}") * off[k - 1] for k in (1, 2, 3)), F.lit(0.0)) - off[i - 1]) for i, b in enumerate(_U, 1)]
    return j.withColumns(dict(zip(_U, new))).select(*field.columns)


def residual(field: DataFrame, kind: str, *keys: str) -> DataFrame:
    """(keys, rms): what a fitted motion leaves."""
    left = remove(field, fit(field, kind, *keys), kind, *keys)
    return left.groupBy(*keys).agg(F.sqrt(F.avg(F.col("u") * F.col("u") + F.col("v") * F.col("v") + F.col("w") * F.col("w"))).alias("rms"))


def angles(rows: DataFrame, name: str = "a") -> DataFrame:
    """Rows with a rotation <name>11..<name>33 get its rotation vector rv1..rv3, its angle rotation_deg and its Euler angles
    about x, then y, then z (fixed axes) ex, ey, ez, all in degrees.

    A half turn, whose axis may point either way, has its largest component positive; where y turns by a right angle and x
    and z turn about one axis, z is 0.
    """
    a = lambda i, j: F.col(f"{name}{i}{j}")
    axial = [(a(3, 2) - a(2, 3)) / 2, (a(1, 3) - a(3, 1)) / 2, (a(2, 1) - a(1, 2)) / 2]
    sine = F.sqrt(sum((x * x for x in axial), F.lit(0.0)))
    cosine = (a(1, 1) + a(2, 2) + a(3, 3) - 1) / 2
    angle = F.atan2(sine, cosine)
    half = (sine < 1e-7) & (cosine < 0)
    size = [F.sqrt(F.greatest((a(i, i) + 1) / 2, F.lit(0.0))) for i in (1, 2, 3)]
    top = F.when((size[0] >= size[1]) & (size[0] >= size[2]), 1).when(size[1] >= size[2], 2).otherwise(3)
    other = lambda k, i: size[i - 1] if k == i else (a(k, i) + a(i, k)) / 4 / size[k - 1]
    turned = [F.when(top == 1, other(1, i)).when(top == 2, other(2, i)).otherwise(other(3, i)) for i in (1, 2, 3)]
    vector = [F.degrees(F.when(half, t * angle).when(sine > 0, x / sine * angle).otherwise(x)) for x, t in zip(axial, turned)]
    lock = F.abs(a(3, 1)) > 1 - 1e-12
    euler = [
        F.when(lock, F.atan2(-F.signum(a(3, 1)) * a(1, 2), a(2, 2))).otherwise(F.atan2(a(3, 2), a(3, 3))),
        -F.asin(F.greatest(F.least(a(3, 1), F.lit(1.0)), F.lit(-1.0))),
        F.when(lock, 0.0).otherwise(F.atan2(a(2, 1), a(1, 1))),
    ]
    out = {f"rv{i}": v for i, v in enumerate(vector, 1)} | {"rotation_deg": F.degrees(angle)}
    return rows.withColumns(out | {f"e{x}": F.degrees(e) for x, e in zip("xyz", euler)})


def polar(rows: DataFrame) -> DataFrame:
    """Rows with a gradient a11..a33 get its rotation r11..r33 and right stretch s11..s33 (A = R S), null where it is incomplete."""
    names = [f"{k}{i}{j}" for k in "rs" for i in (1, 2, 3) for j in (1, 2, 3)]
    schema = StructType([*rows.schema.fields, *(StructField(n, DoubleType()) for n in names)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            g = b[[f"a{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]].to_numpy(dtype=float).reshape(-1, 3, 3)
            ok = np.isfinite(g).all(axis=(1, 2))
            left, size, right = np.linalg.svd(np.where(ok[:, None, None], g, np.eye(3)))
            r = left @ right
            s = right.transpose(0, 2, 1) @ (size[:, :, None] * right)
            values = np.hstack([r.reshape(-1, 9), s.reshape(-1, 9)])
            values[~ok] = np.nan
            yield pd.concat([b.reset_index(drop=True), pd.DataFrame(values, columns=names)], axis=1)

    out = rows.mapInPandas(run, schema)
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})
