"""Regions of the volume as column predicates."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLANES = {"xy": ("x", "y", "z"), "xz": ("x", "z", "y"), "yz": ("y", "z", "x")}


def _c(name: str) -> Column:
    return F.col(name)


@dataclass(frozen=True)
class Box:
    lo: tuple[float, float, float]
    hi: tuple[float, float, float]

    def contains(self) -> Column:
        out = F.lit(True)
        for axis, a, b in zip("xyz", self.lo, self.hi):
            out = out & _c(axis).between(a, b)
        return out


@dataclass(frozen=True)
class Sphere:
    centre: tuple[float, float, float]
    radius: float

    def contains(self) -> Column:
        d2 = sum(((_c(a) - c) * (_c(a) - c) for a, c in zip("xyz", self.centre)), F.lit(0.0))
        return F.sqrt(d2) <= self.radius


@dataclass(frozen=True)
class Slab:
    axis: str
    lo: float
    hi: float

    def contains(self) -> Column:
        return _c(self.axis).between(self.lo, self.hi)


@dataclass(frozen=True)
class Cylinder:
    axis: str
    centre: tuple[float, float, float]
    radius: float
    lo: float
    hi: float

    def contains(self) -> Column:
        a, b = [(n, self.centre["xyz".index(n)]) for n in "xyz" if n != self.axis]
        return (F.hypot(_c(a[0]) - a[1], _c(b[0]) - b[1]) <= self.radius) & _c(self.axis).between(self.lo, self.hi)


@dataclass(frozen=True)
class Prism:
    """An outline (rect, ellipse or polygon) in a plane, between two depths across it."""

    plane: str
    outline: str
    points: tuple[tuple[float, float], ...]
    lo: float
    hi: float

    def __post_init__(self):
        need = 3 if self.outline == "polygon" else 2
        if self.plane not in _PLANES or len(self.points) < need or self.hi < self.lo:
            raise ValueError(f"a {self.outline} in {self.plane} needs {need} points and lo <= hi")

    def contains(self) -> Column:
        a, b, n = (_c(x) for x in _PLANES[self.plane])
        inside = n.between(self.lo, self.hi)
        if self.outline == "polygon":
            crossings = F.lit(0)
            for (a0, b0), (a1, b1) in zip(self.points, self.points[1:] + self.points[:1]):
                if b0 == b1:
                    continue
                at = (b - b0) * ((a1 - a0) / (b1 - b0)) + a0
                crossings = crossings + F.when(((F.lit(b0) > b) != (F.lit(b1) > b)) & (a < at), 1).otherwise(0)
            return inside & (crossings % 2 == 1)
        (a0, a1), (b0, b1) = (sorted(p[k] for p in self.points[:2]) for k in (0, 1))
        if self.outline == "rect":
            return inside & a.between(a0, a1) & b.between(b0, b1)
        ra, rb = max((a1 - a0) / 2, 1e-12), max((b1 - b0) / 2, 1e-12)
        p, q = (a - (a0 + a1) / 2) / ra, (b - (b0 + b1) / 2) / rb
        return inside & (p * p + q * q <= 1.0)


def parse(shape: str, params: dict):
    """A region from its stored form; raises ValueError naming what is wrong."""
    kinds = {"box": Box, "sphere": Sphere, "slab": Slab, "cylinder": Cylinder, "prism": Prism}
    if shape not in kinds:
        raise ValueError(f"unknown region shape {shape!r}")
    made = kinds[shape](**{k: tuple(map(tuple, v)) if k == "points" else tuple(v) if isinstance(v, list) else v for k, v in params.items()})
    for k, v in vars(made).items():
        for x in v if isinstance(v, tuple) else (v,):
            if isinstance(x, float) and not math.isfinite(x):
                raise ValueError(f"{shape}: {k} is not finite")
    if getattr(made, "radius", 1) <= 0 or (shape == "box" and any(h < l for l, h in zip(made.lo, made.hi))):
        raise ValueError(f"{shape}: empty")
    return made
