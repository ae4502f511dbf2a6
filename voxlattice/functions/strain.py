"""Strain measures of a displacement gradient H = [[h11, h12, h13], ...] as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Tensor = list[list[Column]]


def tensor(names: str = "h") -> Tensor:
    return [[F.col(f"{names}{i}{j}") for j in (1, 2, 3)] for i in (1, 2, 3)]


def _eye(i: int, j: int) -> Column:
    return F.lit(1.0 if i == j else 0.0)


def deformation(h: Tensor) -> Tensor:
    return [[h[i][j] + _eye(i, j) for j in range(3)] for i in range(3)]


def det(m: Tensor) -> Column:
    return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])


def inverse(m: Tensor) -> Tensor:
    d = det(m)
    cofactor = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    return [[cofactor(j, i) / d for j in range(3)] for i in range(3)]


def _product(a: Tensor, b: Tensor) -> Tensor:
    return [[sum((a[i][k] * b[k][j] for k in range(3)), F.lit(0.0)) for j in range(3)] for i in range(3)]


def transpose(m: Tensor) -> Tensor:
    return [[m[j][i] for j in range(3)] for i in range(3)]


def infinitesimal(h: Tensor) -> Tensor:
    return [[(h[i][j] + h[j][i]) * 0.5 for j in range(3)] for i in range(3)]


def green_lagrange(h: Tensor) -> Tensor:
    f = deformation(h)
    c = _product(transpose(f), f)
    return [[(c[i][j] - _eye(i, j)) * 0.5 for j in range(3)] for i in range(3)]


def euler_almansi(h: Tensor) -> Tensor:
    f = deformation(h)
    b = inverse(_product(f, transpose(f)))
    return [[(_eye(i, j) - b[i][j]) * 0.5 for j in range(3)] for i in range(3)]


def volumetric(e: Tensor) -> Column:
    return e[0][0] + e[1][1] + e[2][2]


def von_mises(e: Tensor) -> Column:
    m = volumetric(e) / 3
    dev = [[e[i][j] - (m if i == j else F.lit(0.0)) for j in range(3)] for i in range(3)]
    return F.sqrt(sum((dev[i][j] * dev[i][j] for i in range(3) for j in range(3)), F.lit(0.0)) * (2.0 / 3.0))


def principal(e: Tensor) -> list[Column]:
    """Eigenvalues in falling order, by the trigonometric closed form."""
    m = volumetric(e) / 3
    d = [[e[i][j] - (m if i == j else F.lit(0.0)) for j in range(3)] for i in range(3)]
    p = F.sqrt(sum((d[i][j] * d[i][j] for i in range(3) for j in range(3)), F.lit(0.0)) / 6)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(p > 0, det(d) / (p * p * p) / 2).otherwise(1.0)))
    phi = F.acos(r) / 3
    return [m + p * 2 * F.cos(phi), m + p * 2 * F.cos(phi + 4 * math.pi / 3), m + p * 2 * F.cos(phi + 2 * math.pi / 3)]
