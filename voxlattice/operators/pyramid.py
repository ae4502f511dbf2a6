"""Whole-voxel matching at the nodes of a grid: wider rounds for clipped nodes, and from coarse copies of the volume to fine ones.

`bricks` has bz, by, bx and the arrays `ref` and `def` (see operators/blocks); `nodes` has node_id, ix, iy, iz and the whole
voxels z, y, x of its centre. Shifts are z, y, x in voxels of the level they are searched on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import KEY
from .graphs import harmonic_fills
from .reach import fluctuation, reachable
from .stencil import AXES, at
from .store import discard, write

# The share of clipped nodes up to which no wider round follows, the least half width and radius of a coarse
# level, what is added to a radius scaled to it, and the radius around the estimate of the level above.
CLIPPED_SHARE = 0.05
LEAST_HALF = 4
LEAST_RADIUS = 2
RADIUS_MARGIN = 1
FINE_RADIUS = 2

_FROM, _TO = ["rz", "ry", "rx"], ["dz", "dy", "dx"]


def peak(a: np.ndarray, g: np.ndarray) -> tuple[tuple[int, int, int] | None, float]:
    """Where in the box g the subset a has its greatest zero-mean normalised correlation (the first of equal ones), and that."""
    if a.size == 0 or np.isnan(a).any() or any(n < k for n, k in zip(g.shape, a.shape)):
        return None, np.nan
    # windows with absent voxels don't count, so the box shrinks to where voxels are
    there, first = ~np.isnan(g), []
    for axis in range(3):
        held = np.flatnonzero(there.any(axis=tuple(k for k in range(3) if k != axis)))
        if len(held) == 0:
            return None, np.nan
        first.append(int(held[0]))
        g = g[tuple(slice(held[0], held[-1] + 1) if k == axis else slice(None) for k in range(3))]
    if any(n < k for n, k in zip(g.shape, a.shape)):
        return None, np.nan
    a = a - a.mean()
    power = (a * a).sum()
    count = [n - k + 1 for n, k in zip(g.shape, a.shape)]
    at = lambda v, d: v[tuple(slice(p, p + n) for p, n in zip(d, count))]
    sums, squares = _windows(g, a.shape), _windows(g * g, a.shape)
    # every window adds up in the same order, so that equal windows stay equal
    cross, part = np.zeros(count), np.empty(count)
    for d in np.ndindex(a.shape):
        np.multiply(at(g, d), a[d], out=part)
        cross += part
    spread = squares - sums * sums / a.size
    flat = ~(spread > 1e-12 * squares) | ~(power > 0)  # also windows with absent voxels
    score = np.where(flat, -np.inf, cross / np.sqrt(np.where(flat, 1.0, spread) * max(power, 1e-300)))
    best = int(np.argmax(score))
    if not np.isfinite(score.flat[best]):
        return None, np.nan
    return tuple(int(k) + f for k, f in zip(np.unravel_index(best, score.shape), first)), float(score.flat[best])


def _windows(v: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of every window of that shape, axis by axis."""
    for axis, k in enumerate(shape):
        n = v.shape[axis] - k + 1
        v = sum(np.moveaxis(v, axis, 0)[i : i + n] for i in range(k))
        v = np.moveaxis(v, 0, axis)
    return v


def _box(pieces: pd.DataFrame, lo: np.ndarray, side: int, edge: int) -> np.ndarray:
    """The cube from voxel lo on, NaN where no brick covers it."""
    out = np.full((side,) * 3, np.nan)
    for z, y, x, raw in zip(pieces["bz"], pieces["by"], pieces["bx"], pieces["data"]):
        first = np.array([z, y, x]) * edge - lo
        a, b = np.maximum(first, 0), np.minimum(first + edge, side)
        if (b > a).all():
            out[tuple(slice(*p) for p in zip(a, b))] = np.asarray(raw, float).reshape((edge,) * 3)[tuple(slice(*p) for p in zip(a - first, b - first))]
    return out


def search(bricks: DataFrame, edge: int, nodes: DataFrame, half: int, radius: int) -> DataFrame:
    """(node_id, tz, ty, tx, zncc, clipped): each node's best shift within the radius of its start sz, sy, sx.

    Nodes are grouped by the cube of bricks, some 32 voxels an edge, of their centre and the cube of where they start; a group
    gets the bricks around the two, so that its memory doesn't depend on how far things moved. A subset or a whole search without voxels gives a null
    correlation. `clipped`: the best shift lies on the search's border.
    """
    side = max(1, 32 // edge)
    span = side * edge
    whole = lambda a: F.floor(F.col(a) / span).cast("long")
    moved = lambda a: F.floor((F.col(a) + F.col(f"s{a}")) / span).cast("long")
    placed = nodes.select("node_id", *"zyx", "sz", "sy", "sx", *[whole(a).alias(f"r{a}") for a in "zyx"], *[moved(a).alias(f"d{a}") for a in "zyx"])

    def touched(kind: str, origin: list[str], halo: int) -> DataFrame:
        """The bricks that the cube `origin`, grown by the halo, touches."""
        r, out = -(-halo // edge), around.select(*groups, F.lit(kind).alias("kind"))
        for o, b in zip(origin, KEY):
            out = out.withColumn(b, F.explode(F.sequence(F.col(o) * side - r, F.col(o) * side + side - 1 + r)))
        return out

    groups = [*_FROM, *_TO]
    around = placed.select(*groups).distinct()
    wanted = touched("ref", _FROM, half).union(touched("def", _TO, half + radius))
    # a merge join: the planner knows neither how many bricks a group touches nor how long their arrays are, and would broadcast either
    pieces = wanted.hint("merge").join(bricks, KEY).select(*groups, "kind", *KEY, F.when(F.col("kind") == "ref", F.col("ref")).otherwise(F.col("def")).alias("data"))

    def run(key: tuple, pieces: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        where = np.array(key, dtype=int)
        start, aim = where[:3] * span - half, where[3:] * span - half - radius
        f = _box(pieces[pieces["kind"] == "ref"], start, span + 2 * half, edge)
        g = _box(pieces[pieces["kind"] == "def"], aim, span + 2 * (half + radius), edge)
        out = []
        for ident, centre, s in zip(rows["node_id"], rows[["z", "y", "x"]].to_numpy(int), rows[["sz", "sy", "sx"]].to_numpy(int)):
            cut = lambda v, lo, reach, c: v[tuple(slice(p - reach, p + reach + 1) for p in c - lo)]
            found, zncc = peak(cut(f, start, half, centre), cut(g, aim, half + radius, centre + s))
            t = s if found is None else s + np.array(found) - radius
            out.append((ident, *map(int, t), None if found is None else zncc, found is not None and any(k in (0, 2 * radius) for k in found)))
        return pd.DataFrame(out, columns=["node_id", "tz", "ty", "tx", "zncc", "clipped"])

    kind = nodes.schema["node_id"].dataType.simpleString()
    own = placed.withColumnsRenamed({c: f"{c}_" for c in groups})  # other names than the pieces', which come from the same rows
    return pieces.groupBy(*groups).cogroup(own.groupBy(*[f"{c}_" for c in groups])).applyInPandas(run, f"node_id {kind}, tz long, ty long, tx long, zncc double, clipped boolean")


def expanding_search(bricks: DataFrame, edge: int, nodes: DataFrame, half: int, radius: int, most: int = 3) -> DataFrame:
    """The search with `radius` and `rounds`: while more than a twentieth of the found nodes are clipped, those alone are searched
    again with twice the radius, up to `most` times. A node whose wider search finds nothing keeps what it had."""
    found = write(search(bricks, edge, nodes, half, radius).withColumns({"radius": F.lit(radius), "rounds": F.lit(1)}))
    for _ in range(most):
        counts = found.where("zncc is not null").agg(F.count("*").alias("n"), F.count_if("clipped").alias("c")).first()
        if not counts["n"] or counts["c"] <= CLIPPED_SHARE * counts["n"]:
            break
        radius *= 2
        left = nodes.join(found.where("clipped").select("node_id"), "node_id", "left_semi")
        again = search(bricks, edge, left, half, radius).where("zncc is not null")
        again = again.select("node_id", F.struct("tz", "ty", "tx", "zncc", "clipped", F.lit(radius).alias("radius")).alias("again"))
        merged = found.join(again, "node_id", "left").withColumn("rounds", F.col("rounds") + F.col("clipped").cast("int"))
        merged = merged.withColumns({c: F.when(F.col("again").isNotNull(), F.col(f"again.{c}")).otherwise(F.col(c)) for c in ("tz", "ty", "tx", "zncc", "clipped", "radius")})
        before, found = found, write(merged.drop("again"))
        discard(before)
    return found


def halve(bricks: DataFrame, edge: int) -> DataFrame:
    """Bricks of the same edge with means of 2x2x2 voxels; eight bricks become one, NaN where one of them is absent."""
    half = edge // 2
    if edge % 2:
        raise ValueError("only bricks with an even edge can be halved")

    def mean(batches):
        for b in batches:
            yield b.assign(**{c: [np.asarray(v, float).reshape(half, 2, half, 2, half, 2).mean(axis=(1, 3, 5)).ravel() for v in b[c]] for c in ("ref", "def")})

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        whole = {c: np.full((edge,) * 3, np.nan) for c in ("ref", "def")}
        for z, y, x, *data in zip(*(rows[k] for k in (*KEY, "ref", "def"))):
            part = tuple(slice(k % 2 * half, k % 2 * half + half) for k in (z, y, x))
            for c, v in zip(("ref", "def"), data):
                whole[c][part] = np.asarray(v, float).reshape((half,) * 3)
        return pd.DataFrame([(*map(int, key), *(whole[c].ravel() for c in ("ref", "def")))], columns=[*KEY, "ref", "def"])

    schema = "bz long, by long, bx long, ref array<double>, def array<double>"
    small = bricks.select(*[F.col(k).cast("long").alias(k) for k in KEY], *[F.col(c).cast("array<double>").alias(c) for c in ("ref", "def")]).mapInPandas(mean, schema)
    return small.groupBy(*[F.expr(f"{k} div 2").alias(f"_{k}") for k in KEY]).applyInPandas(join, schema)


def clean(nodes: DataFrame, threshold: float = 2.0) -> DataFrame:
    """tz, ty, tx of nodes without a correlation, or beyond the median test's threshold, are filled in from the nodes around."""
    flagged = nodes.withColumns({c: F.when(F.col("zncc").isNotNull(), F.col(c).cast("double")) for c in ("tz", "ty", "tx")})
    flagged = flagged.withColumns({f"ok_{a}": at(F.lit(1), a, 1).isNotNull() for a in AXES})
    flagged = reachable(flagged)
    for c in ("tz", "ty", "tx"):
        flagged = fluctuation(flagged, c).withColumnRenamed("fluctuation", f"_{c}")
    apart = F.sqrt(sum((F.col(f"_{c}") * F.col(f"_{c}") for c in ("tz", "ty", "tx")), F.lit(0.0)))
    kept = write(flagged.withColumns({c: F.when(apart <= threshold, F.col(c)) for c in ("tz", "ty", "tx")}).select("node_id", *AXES, "tz", "ty", "tx"))
    if not kept.where("tz is null").limit(1).count():
        return kept
    filled = harmonic_fills(kept, ["tz", "ty", "tx"]).select(F.col("node").alias("node_id"), *[F.col(c).alias(f"_{c}") for c in ("tz", "ty", "tx")])
    return write(kept.join(filled, "node_id", "left").select("node_id", *AXES, *[F.coalesce(c, f"_{c}", F.lit(0.0)).alias(c) for c in ("tz", "ty", "tx")]))


def pyramid_search(bricks: DataFrame, edge: int, nodes: DataFrame, half: int, radius: int, levels: int, threshold: float = 2.0) -> DataFrame:
    """(node_id, u, v, w, zncc, radius, rounds): shifts found on the coarsest of `levels` halvings first, then level by level
    within a small radius of twice what the level above gives, cleaned in between and at the end.

    u, v, w are the cleaned shifts in x, y, z; zncc is the last search's, null for nodes that were filled in for want of one.
    """
    pyramid = [bricks]
    for _ in range(levels):
        pyramid.append(write(halve(pyramid[-1], edge)))
    estimate = nodes.select("node_id", *[F.lit(0.0).alias(f"t{a}") for a in "zyx"])
    for level in range(levels, -1, -1):
        scale = 2**level
        near = max(LEAST_RADIUS, -(-radius // scale) + RADIUS_MARGIN) if level and level == levels else FINE_RADIUS if level < levels else radius
        starts = nodes.join(estimate, "node_id").select("node_id", *AXES, *[F.round(F.col(a) / scale).cast("long").alias(a) for a in "zyx"], *[F.round(F.col(f"t{a}") / scale).cast("long").alias(f"s{a}") for a in "zyx"])
        found = expanding_search(pyramid[level], edge, starts, half if not level else min(half, max(LEAST_HALF, half // scale)), near)
        cleaned = clean(found.join(nodes.select("node_id", *AXES), "node_id"), threshold)
        estimate = cleaned.select("node_id", *[(F.col(f"t{a}") * scale).alias(f"t{a}") for a in "zyx"])
    return estimate.join(found.select("node_id", "zncc", "radius", "rounds"), "node_id").select("node_id", F.col("tx").alias("u"), F.col("ty").alias("v"), F.col("tz").alias("w"), "zncc", "radius", "rounds")
