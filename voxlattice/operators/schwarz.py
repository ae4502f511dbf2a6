"""Grid systems solved box by box: boxes overlap, so that what a box doesn't know yet has died out before it reaches the box's own nodes.

A box is a cube of grid places with the places within a reach around it. Each round gives a box its nodes in one group; boxes are
named by their edge's multiples, so a node goes to few of them, however large the grid is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .stencil import AXES
from .store import discard, write

_BOX = [f"_box_{a}" for a in AXES]

#: Edge of a box and how far it reaches into the boxes around.
SIZE, OVERLAP = 64, 16

#: (product of a dense box, its diagonal) from the box's dense columns; `there` is true where a node is.
Local = Callable[[dict[str, np.ndarray]], tuple[Callable[[np.ndarray], np.ndarray], np.ndarray]]


class Box:
    """The nodes of one box: dense columns over their bounding cuboid, and how far each lies outside of the box."""

    def __init__(self, frame: pd.DataFrame, corner: np.ndarray, size: int, columns: Iterable[str]):
        places = frame[list(AXES)].to_numpy(np.int64)
        low = places.min(0)
        self.shape = tuple(int(n) for n in places.max(0) - low + 1)
        self.at = np.ravel_multi_index(tuple((places - low).T), self.shape)
        self.outside = np.maximum(np.maximum(corner - places, places - (corner + size - 1)), 0).max(1)
        self.own = self.outside == 0
        self.columns = {"there": self.dense(np.ones(len(frame), bool))}
        self.columns |= {c: self.dense(frame[c].to_numpy()) for c in columns}

    def dense(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape, bool if values.dtype == bool else float)
        out.ravel()[self.at] = values
        return out


def boxed(rows: DataFrame, keys: list[str], size: int, reach: int, columns: Iterable[str], work: Callable[[pd.DataFrame, Box], pd.DataFrame], schema: StructType) -> DataFrame:
    """work(frame, box) of every key's boxes that hold a node of their own, with the nodes within reach around."""
    columns = list(columns)
    whole = rows.agg(*[F.floor(f(a) / size).alias(f"_{k}{a}") for a in AXES for f, k in ((F.min, "lo"), (F.max, "hi"))])  # beyond them no box has nodes
    near = rows.crossJoin(F.broadcast(whole))
    for a, c in zip(AXES, _BOX):
        first, last = (f(F.floor((F.col(a) + k * reach) / size), F.col(f"_{e}{a}")) for f, k, e in ((F.greatest, -1, "lo"), (F.least, 1, "hi")))
        near = near.withColumn(c, F.explode(F.sequence(first, last)))
    near = near.select(*rows.columns, *_BOX)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        box = Box(frame, np.array(key[-3:], np.int64) * size, size, columns)
        return work(frame, box) if box.own.any() else pd.DataFrame({f.name: [] for f in schema})

    return near.groupBy(*keys, *_BOX).applyInPandas(run, schema)


def around(p: np.ndarray) -> np.ndarray:
    """At every place the sum of the six places beside it; nothing beyond the borders."""
    out = np.zeros(p.shape)
    for a in range(3):
        lo, hi = (tuple(s if k == a else slice(None) for k in range(3)) for s in (slice(None, -1), slice(1, None)))
        out[lo] += p[hi]
        out[hi] += p[lo]
    return out


def solve_box(product: Callable, diagonal: np.ndarray, free: np.ndarray, b: np.ndarray, x: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """(x with its free places solved, the residual it came with): conjugate gradients, other places held."""
    first = np.where(free, b - product(x), 0.0)
    scale = np.where(free & (diagonal > 0), 1.0 / np.where(diagonal > 0, diagonal, 1.0), 0.0)
    r, x = first.copy(), x.copy()
    limit = tolerance * max(np.linalg.norm(b[free]), np.linalg.norm(r))
    z = r * scale
    p, rz = z, float((r * z).sum())
    best, since = np.linalg.norm(r), 0
    while best > limit and since < 100 and rz > 0:
        ap = np.where(free, product(p), 0.0)
        pap = float((p * ap).sum())
        if not pap > 0:
            break
        x += rz / pap * p
        r -= rz / pap * ap
        z = r * scale
        rz, before = float((r * z).sum()), rz
        p = z + rz / before * p
        left = np.linalg.norm(r)
        best, since = (left, 0) if left < best else (best, since + 1)
    return x, first


def solve(rows: DataFrame, keys: list[str], local: Local, fields: Iterable[str], systems: Iterable[str], tolerance: float, finish: Callable[[DataFrame], DataFrame], size: int = SIZE, overlap: int = OVERLAP, slow: float = 0.5) -> DataFrame:
    """rows (keys, ix, iy, iz, node_id, fields, b_<system>) with x_<system>, and each key's largest `residual` over its systems.

    All systems of a key share the matrix that `local` makes of the fields. In a round a box solves for its nodes and those
    within the overlap, the nodes one further held at the round before, and keeps its own. Rounds end when every key's residual
    is within the tolerance of its b. Where a round leaves more than `slow` of the residual, which long reaching systems do,
    finish(rows with x_<system>) goes on from there and gives the result.
    """
    fields, systems = list(fields), list(systems)
    xs, bs, rs = ([f"{k}_{s}" for s in systems] for k in ("x", "b", "_r"))
    kept = [*keys, "node_id", *AXES, *fields, *bs]
    state = rows.select(*kept).withColumns({x: F.lit(0.0) for x in xs})
    schema = StructType([*state.schema.fields, *(StructField(r, DoubleType()) for r in rs)])

    def work(frame: pd.DataFrame, box: Box) -> pd.DataFrame:
        product, diagonal = local({k: box.columns[k] for k in ("there", *fields)})
        free = box.dense(box.outside <= overlap)
        out = frame.loc[box.own, kept].copy()
        for x, b, r in zip(xs, bs, rs):
            found, first = solve_box(product, diagonal, free, box.columns[b], box.columns[x], tolerance / 20)
            out[x], out[r] = found.ravel()[box.at[box.own]], first.ravel()[box.at[box.own]]
        return out

    state, last, before = write(state), float("inf"), None
    while True:
        after = write(boxed(state, keys, size, overlap + 1, [*fields, *bs, *xs], work, schema))
        norm = lambda r, b: F.when(F.sum(F.col(b) * F.col(b)) > 0, F.sqrt(F.sum(F.col(r) * F.col(r)) / F.sum(F.col(b) * F.col(b)))).otherwise(0.0)
        left = after.groupBy(*keys).agg(F.greatest(*[norm(r, b) for r, b in zip(rs, bs)], F.lit(0.0)).alias("residual")) if keys else after.agg(F.greatest(*[norm(r, b) for r, b in zip(rs, bs)], F.lit(0.0)).alias("residual"))
        left = write(left)
        worst = left.agg(F.max("residual")).first()[0] or 0.0
        if worst <= tolerance:  # of the round before
            return state.join(F.broadcast(left), keys) if keys else state.crossJoin(F.broadcast(left))
        if worst > slow * last and last < float("inf"):
            return finish(after.select(*kept, *xs))
        last = worst
        discard(state, left)
        state = after.select(*kept, *xs)


def laplace(off: float) -> Local:
    """diagonal * p - off * (sum of p around), with the diagonal as a field."""
    return lambda box: (lambda p: box["diagonal"] * p - off * around(p), box["diagonal"])
