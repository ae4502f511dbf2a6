"""Jobs over bricks of a volume: each brick with its halo, by an equi join on the bricks it touches.

A brick table has bz, by, bx and `data`, the brick's grey values in z, y, x order as an array of floats; absent bricks are
outside the volume (NaN).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["bz", "by", "bx"]


def with_halo(bricks: DataFrame, edge: int, halo: int) -> DataFrame:
    """(tz, ty, tx, bz, by, bx, data): every brick that the box of brick t, grown by the halo, touches."""
    r = -(-halo // edge)
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in range(-r, r + 1) for b in range(-r, r + 1) for c in range(-r, r + 1)])
    targets = bricks.select(*[F.col(k).alias(f"t{k[1]}") for k in KEY])
    spread = bricks.select(*KEY, "data", F.explode(near).alias("d")).select(*[(F.col(k) + F.col(f"d.{x}")).alias(f"t{k[1]}") for k, x in zip(KEY, "abc")], *KEY, "data")
    return spread.join(targets, ["tz", "ty", "tx"], "left_semi")


def assemble(frame: pd.DataFrame, edge: int, halo: int, data: str = "data") -> np.ndarray:
    """The grown box of one brick as an array, NaN where there is no brick."""
    t = frame[["tz", "ty", "tx"]].iloc[0].to_numpy(dtype=int)
    side = edge + 2 * halo
    out = np.full((side,) * 3, np.nan)
    for z, y, x, raw in zip(frame["bz"], frame["by"], frame["bx"], frame[data]):
        at = (np.array([z, y, x], dtype=int) - t) * edge + halo
        lo, hi = np.maximum(at, 0), np.minimum(at + edge, side)
        if (hi > lo).all():
            src = np.asarray(raw, dtype=np.float64).reshape((edge,) * 3)
            out[lo[0] : hi[0], lo[1] : hi[1], lo[2] : hi[2]] = src[tuple(slice(a, b) for a, b in zip(lo - at, hi - at))]
    return out


def map_cubes(bricks: DataFrame, edge: int, halo: int, work: Callable[[np.ndarray, np.ndarray, dict[str, np.ndarray], pd.DataFrame], pd.DataFrame], schema: str, volumes: tuple[str, ...] = ("data",), extra: str | None = None) -> DataFrame:
    """Apply work(brick places, first voxels, {volume: array}, rows) to cubes of bricks, some 32 voxels an edge: the bricks of a cube by
    place and by where each one's grown box begins in the cube's grown arrays, and their rows of the table.

    A brick goes to the few cubes it touches and not to every brick around.
    """
    side, reach = max(1, 32 // edge), -(-halo // edge)
    near = bricks.select(*[F.col(k).cast("long").alias(k) for k in KEY], *volumes, *([extra] if extra else []))
    groups = [f"g{k[1]}" for k in KEY]
    for k, g in zip(KEY, groups):
        near = near.withColumn(g, F.explode(F.sequence(F.floor((F.col(k) - reach) / side), F.floor((F.col(k) + reach) / side))))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        places = frame[KEY].to_numpy(np.int64)
        first = np.array(key, np.int64) * side
        own = ((places >= first) & (places < first + side)).all(1)
        if not own.any():
            return pd.DataFrame()
        span = side * edge + 2 * halo
        held = {v: np.full((span,) * 3, np.nan) for v in volumes}
        for i, at in enumerate((places - first) * edge + halo):
            lo, hi = np.maximum(at, 0), np.minimum(at + edge, span)
            if (hi > lo).all():
                for v in volumes:
                    raw = np.asarray(frame[v].iloc[i], dtype=np.float64).reshape((edge,) * 3)
                    held[v][tuple(map(slice, lo, hi))] = raw[tuple(map(slice, lo - at, hi - at))]
        return work(places[own], (places[own] - first) * edge, held, frame[own])

    return near.groupBy(*groups).applyInPandas(run, schema)


def map_blocks(bricks: DataFrame, edge: int, halo: int, work: Callable[[tuple, dict[str, np.ndarray]], pd.DataFrame], schema: str, volumes: tuple[str, ...] = ("data",), extra: str | None = None) -> DataFrame:
    """Apply work(brick key, {volume: grown box}) to every brick, cube by cube; `extra` names an array of the brick's own that work
    gets as a third argument."""

    def each(places: np.ndarray, lows: np.ndarray, held: dict[str, np.ndarray], rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i, (place, low) in enumerate(zip(places, lows)):
            boxes = {v: held[v][tuple(slice(a, a + edge + 2 * halo) for a in low)].copy() for v in volumes}
            args = [np.asarray(rows[extra].iloc[i], dtype=float)] if extra else []
            out.append(work(tuple(map(int, place)), boxes, *args))
        return pd.concat([f for f in out if len(f)] or out[:1], ignore_index=True)

    return map_cubes(bricks, edge, halo, each, schema, volumes, extra)


# ---- matching one volume to another ----


#: Values of subsets that are worked on at once.
AT_ONCE = 200_000
#: The corners around a peak, and the least squares quadratic through them: constant, z, y, x, zy, zx, yx, zz, yy, xx.
_AROUND = np.array(list(np.ndindex(3, 3, 3))) - 1
_QUADRATIC = np.linalg.pinv(np.column_stack([np.ones(27), _AROUND, _AROUND[:, 0] * _AROUND[:, 1], _AROUND[:, 0] * _AROUND[:, 2], _AROUND[:, 1] * _AROUND[:, 2], _AROUND**2]))


def _sample(box: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Trilinear values at points (..., 3); NaN where a corner is outside or absent."""
    i = np.floor(p).astype(int)
    t = p - i
    inside = ((i >= 0) & (i + 1 < np.array(box.shape))).all(-1)
    i = np.where(inside[..., None], i, 0)
    flat = (i[..., 0] * box.shape[1] + i[..., 1]) * box.shape[2] + i[..., 2]
    steps, values = (box.shape[1] * box.shape[2], box.shape[2], 1), box.ravel()
    out = np.zeros(p.shape[:-1])
    for c in np.ndindex(2, 2, 2):
        share = [t[..., k] if c[k] else 1 - t[..., k] for k in range(3)]
        out += share[0] * share[1] * share[2] * values[np.minimum(flat + sum(k * s for k, s in zip(c, steps)), values.size - 1)]
    return np.where(inside, out, np.nan)


def _subsets(box: np.ndarray, starts: np.ndarray, side: int) -> np.ndarray:
    """The values (n, side^3) of cubes that begin at these voxels."""
    return np.lib.stride_tricks.sliding_window_view(box, (side,) * 3)[tuple(starts.T)].reshape(len(starts), -1)


def correlation_maps(f: np.ndarray, g: np.ndarray, centres: np.ndarray, half: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, shifts): zero-mean normalised correlation at every shift, z slowest; NaN where a subset lacks voxels; and where one is flat."""
    side, shifts = 2 * half + 1, list(np.ndindex((2 * radius + 1,) * 3))
    maps, flat = np.full((len(centres), len(shifts)), np.nan), np.zeros((len(centres), len(shifts)), bool)
    for at in range(0, len(centres), max(1, AT_ONCE // side**3)):
        n = slice(at, at + max(1, AT_ONCE // side**3))
        a = _subsets(f, centres[n] - half, side)
        squares = (a * a).sum(1)
        a = a - a.mean(1, keepdims=True)
        power = (a * a).sum(1)
        for k, d in enumerate(shifts):
            b = _subsets(g, centres[n] + d - radius - half, side)
            whole = (b * b).sum(1)
            b = b - b.mean(1, keepdims=True)
            spread = (b * b).sum(1)
            flat[n, k] = (power <= 1e-12 * squares) | (spread <= 1e-12 * whole)
            maps[n, k] = (a * b).sum(1) / np.sqrt(np.where(flat[n, k], 1.0, power * spread))
    return maps, flat


def peaks(maps: np.ndarray, flat: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of correlation maps: the whole shift (n, 3) of the greatest value (the first of equal ones), that value (NaN: none), what the
    quadratic through the 27 values around adds to the shift, the peak's share of the map's energy and whether it lies on the border.

    Flat subsets correlate with nothing: they count as 0 in the energy and the quadratic and are no peak. On a border, or beside
    subsets that lack voxels, there is no quadratic; one whose top is more than a voxel away doesn't count.
    """
    n, side = len(maps), 2 * radius + 1
    score = np.where(np.isnan(maps) | flat, -np.inf, maps)
    best = score.argmax(1)
    zncc = score[np.arange(n), best]
    found = np.isfinite(zncc)
    at = np.stack(np.unravel_index(best, (side,) * 3), 1)
    shift = np.where(found[:, None], at - radius, 0)
    border = found & (np.abs(shift) == radius).any(1)
    values = np.where(flat & ~np.isnan(maps), 0.0, maps)
    lifted = values[found] - np.nanmin(values[found], axis=1, keepdims=True)
    energy = np.nanmean(lifted * lifted, axis=1)
    top = lifted[np.arange(len(lifted)), best[found]]
    pce = np.full(n, np.nan)
    pce[found] = np.where(energy > 1e-30, top * top / np.where(energy > 1e-30, energy, 1.0), 0.0)
    sub, inner = np.zeros((n, 3)), np.flatnonzero(found & ~border)
    if radius and len(inner):
        around = at[inner][:, None] + _AROUND
        c = values[inner[:, None], (around[..., 0] * side + around[..., 1]) * side + around[..., 2]] @ _QUADRATIC.T
        h = np.stack([2 * c[:, 7], c[:, 4], c[:, 5], c[:, 4], 2 * c[:, 8], c[:, 6], c[:, 5], c[:, 6], 2 * c[:, 9]], 1).reshape(-1, 3, 3)
        ok = np.isfinite(c).all(1)
        ok[ok] = np.abs(np.linalg.det(h[ok])) > 1e-12
        s = np.linalg.solve(h[ok], -c[ok, 1:4, None])[..., 0]
        sub[inner[ok]] = np.where((np.abs(s) <= 1).all(1, keepdims=True), s, 0.0)
    return shift, np.where(found, zncc, np.nan), sub, pce, border


def search(f: np.ndarray, g: np.ndarray, centre: np.ndarray, half: int, radius: int) -> tuple[np.ndarray, float, bool]:
    """Integer shift (z, y, x) with the greatest zero-mean normalised correlation, that value, and whether it lies on the border."""
    f, g = (np.pad(v, half + radius, constant_values=np.nan) for v in (f, g))
    shift, zncc, _, _, border = peaks(*correlation_maps(f, g, np.asarray(centre)[None] + half + radius, half, radius), radius)
    return shift[0], float(zncc[0]), bool(border[0])


def _warped(g: np.ndarray, centres: np.ndarray, off: np.ndarray, reach: int) -> np.ndarray:
    """Values (n, points) beside the centres; NaN more than `reach` voxels away, so that they don't depend on what is held beside."""
    near = (np.floor(off) >= -reach).all(-1) & (np.floor(off) + 1 <= reach).all(-1)
    return np.where(near, _sample(g, centres[:, None] + off), np.nan)


def _offsets(half: int) -> np.ndarray:
    axis = np.arange(-half, half + 1)
    return np.stack(np.meshgrid(axis, axis, axis, indexing="ij"), -1).reshape(-1, 3).astype(float)


def correlation_at(f: np.ndarray, g: np.ndarray, centres: np.ndarray, half: int, u: np.ndarray, reach: int) -> np.ndarray:
    """Zero-mean normalised correlation of subsets at shifts between voxels; NaN where voxels lack or all are equal."""
    d, out = _offsets(half), np.full(len(centres), np.nan)
    for at in range(0, len(centres), max(1, AT_ONCE // len(d))):
        n = slice(at, at + max(1, AT_ONCE // len(d)))
        a, b = _subsets(f, centres[n] - half, 2 * half + 1), _warped(g, centres[n], u[n, None] + d, reach)
        a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
        norm = np.sqrt((a * a).sum(1) * (b * b).sum(1))
        out[n] = np.where(norm > 0, (a * b).sum(1) / np.where(norm > 0, norm, 1.0), np.nan)
    return out


def refine(f: np.ndarray, g: np.ndarray, centres: np.ndarray, half: int, start: np.ndarray, reach: int, steps: int = 30, tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gauss-Newton for displacements (n, 3) and their gradients (12 parameters) of subsets: (u, H, correlation, iterations).

    A subset's own gradient gives a constant normal matrix; each step solves for the update of the reference subset
    and composes its inverse onto the warp. The correlation is NaN for subsets that lack voxels or structure, and where the warp
    leaves the voxels within `reach` of the centre.
    """
    d, n, side = _offsets(half), len(centres), 2 * half + 1
    u, h, score, count = np.array(start, float), np.zeros((n, 3, 3)), np.full(n, np.nan), np.zeros(n, int)
    for at in range(0, n, max(1, AT_ONCE // len(d))):
        ids = np.arange(at, min(n, at + max(1, AT_ONCE // len(d))))
        cut = lambda ids, e=0: _subsets(f, centres[ids] - half + e, side)
        a, grad = cut(ids), np.stack([(cut(ids, e) - cut(ids, -e)) / 2 for e in np.eye(3, dtype=int)], -1)
        there = ~(np.isnan(a).any(1) | np.isnan(grad).any((1, 2)))
        ids, a, grad = ids[there], a[there], grad[there]
        jac = np.concatenate([grad, (grad[..., :, None] * d[:, None, :]).reshape(len(ids), len(d), 9)], -1)
        a0 = a - a.mean(1, keepdims=True)
        na = np.sqrt((a0 * a0).sum(1))
        normal = jac.transpose(0, 2, 1) @ jac
        there = (na > 0) & (np.linalg.cond(normal) <= 1e14)
        ids, a0, na, jac, normal = (v[there] for v in (ids, a0, na, jac, normal))
        for k in range(1, steps + 1):
            if not len(ids):
                break
            b = _warped(g, centres[ids], u[ids][:, None] + d @ (np.eye(3) + h[ids]).transpose(0, 2, 1), reach)
            lost = ~np.isfinite(b).all(1)
            count[ids] = k
            score[ids[lost]] = np.nan
            ids, a0, na, jac, normal, b = (v[~lost] for v in (ids, a0, na, jac, normal, b))
            b0 = b - b.mean(1, keepdims=True)
            nb = np.sqrt((b0 * b0).sum(1))
            score[ids] = np.where(nb > 0, (a0 * b0).sum(1) / (na * np.where(nb > 0, nb, 1.0)), np.nan)
            rest = a0 - b0 * (na / np.maximum(nb, 1e-12))[:, None]
            step = np.linalg.solve(normal, (jac * rest[..., None]).sum(1)[..., None])[..., 0]
            du, dh = step[:, :3], step[:, 3:].reshape(-1, 3, 3)
            back = np.eye(3) - dh  # the step was solved with its sign turned: warp by the inverse of minus it
            lost = ~(np.abs(np.linalg.det(back)) > 1e-12)
            score[ids[lost]] = np.nan
            ids, a0, na, jac, normal, du, dh, back = (v[~lost] for v in (ids, a0, na, jac, normal, du, dh, back))
            h[ids] = (np.eye(3) + h[ids]) @ np.linalg.inv(back) - np.eye(3)
            u[ids] += ((np.eye(3) + h[ids]) @ du[..., None])[..., 0]
            more = ~(np.linalg.norm(du, axis=1) + half * np.linalg.norm(dh, axis=(1, 2)) < tolerance)
            ids, a0, na, jac, normal = (v[more] for v in (ids, a0, na, jac, normal))
    return u, h, score, count


def correlate(bricks: DataFrame, edge: int, half: int, radius: int) -> DataFrame:
    """One node at each brick's centre: shift from `ref` to `def`, correlation, iterations, whether the search was clipped, the peak's
    share of the map's energy (pce) and whether the node was found at all (ok).

    The search's whole shift is refined by the quadratic through the correlations around it, and what comes out by Gauss-Newton.
    Each refinement stands where the subset correlates there as well as before; n_iter is 0 where Gauss-Newton's doesn't, and beside absent
    voxels, where it has no gradient.
    """
    reach = half + radius + 3

    def work(places: np.ndarray, lows: np.ndarray, held: dict[str, np.ndarray], _: pd.DataFrame) -> pd.DataFrame:
        centres = lows + reach + edge // 2
        shift, zncc, sub, pce, clipped = peaks(*correlation_maps(held["ref"], held["def"], centres, half, radius), radius)
        moved, count, found = shift.astype(float), np.zeros(len(places), int), np.flatnonzero(~np.isnan(zncc))

        def keep(ids: np.ndarray, u: np.ndarray, fine: np.ndarray, n: np.ndarray | int = 0) -> None:
            better = fine >= zncc[ids] - 1e-6
            moved[ids[better]], zncc[ids[better]], count[ids[better]] = u[better], fine[better], n[better] if np.ndim(n) else n

        between = np.flatnonzero(sub.any(1))
        keep(between, (shift + sub)[between], correlation_at(held["ref"], held["def"], centres[between], half, (shift + sub)[between], reach))
        u, _, fine, n = refine(held["ref"], held["def"], centres[found], half, moved[found], reach)
        keep(found, u, fine, n)
        out = {**dict(zip(KEY, places.T)), **dict(zip("uvw", moved.T[::-1])), "zncc": zncc, "n_iter": count, "clipped": clipped, "pce": pce, "ok": ~np.isnan(zncc)}
        frame = pd.DataFrame(out)
        return frame.astype({"zncc": object, "pce": object}).where(frame.notna(), None)

    return map_cubes(bricks, edge, reach, work, "bz long, by long, bx long, u double, v double, w double, zncc double, n_iter long, clipped boolean, pce double, ok boolean", ("ref", "def"))


def autocovariance(bricks: DataFrame, edge: int, reach: int, mean: float) -> DataFrame:
    """(hz, hy, hx, s, pairs): sums of products and pair counts at every lag up to reach; each brick owns its left voxels."""

    def work(key, boxes):
        own = boxes["data"][(slice(reach, reach + edge),) * 3] - mean
        rows = []
        for d in np.ndindex((2 * reach + 1,) * 3):
            b = boxes["data"][tuple(slice(k, k + edge) for k in d)] - mean
            ok = ~np.isnan(b) & ~np.isnan(own)
            rows.append((*(k - reach for k in d), float((own * b)[ok].sum()), int(ok.sum())))
        return pd.DataFrame(rows, columns=["hz", "hy", "hx", "s", "pairs"])

    parts = map_blocks(bricks, edge, reach, work, "hz long, hy long, hx long, s double, pairs long")
    return parts.groupBy("hz", "hy", "hx").agg(F.sum("s").alias("s"), F.sum("pairs").alias("pairs"))
