"""Operators of fields and bricks against NumPy and analytic truth."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlattice.operators import blocks, graphs, motion, regions, stencil, texture
from voxlattice.functions import strain as st


def speckle(shape, seed=3):
    """Smooth noise between 0 and 1."""
    x = np.random.default_rng(seed).standard_normal(shape)
    for axis in range(3):
        k = np.fft.fftfreq(shape[axis])
        s = [1, 1, 1]
        s[axis] = -1
        x = np.fft.ifft(np.fft.fft(x, axis=axis) * np.exp(-2 * (math.pi * k * 2) ** 2).reshape(s), axis=axis).real
    return (x - x.min()) / np.ptp(x)


def brick_table(spark, edge, **volumes):
    shape = next(iter(volumes.values())).shape
    rows = []
    for b in np.ndindex(tuple(n // edge for n in shape)):
        cut = tuple(slice(k * edge, (k + 1) * edge) for k in b)
        rows.append((*map(int, b), *(v[cut].ravel().tolist() for v in volumes.values())))
    return spark.createDataFrame(rows, "bz long, by long, bx long, " + ", ".join(f"{k} array<double>" for k in volumes))


def test_block_matching_recovers_affine_motion(spark):
    f = speckle((32, 32, 32))
    grid = np.stack(np.meshgrid(*[np.arange(32.0)] * 3, indexing="ij"), -1)
    shift = np.array([0.6, -1.3, 0.4])  # z, y, x
    fx = np.fft.fftn(f)
    phase = sum(np.fft.fftfreq(32).reshape([-1 if a == k else 1 for a in range(3)]) * shift[k] for k in range(3))
    g = np.fft.ifftn(fx * np.exp(-2j * math.pi * phase)).real  # moved by the shift, wrapping
    assert grid.shape == (32, 32, 32, 3)
    got = blocks.correlate(brick_table(spark, 8, ref=f, **{"def": g}), 8, 5, 2).where("bz in (1, 2) and by in (1, 2) and bx in (1, 2)").toPandas()
    assert len(got) == 8 and got["zncc"].min() > 0.97
    for name, want in zip("wvu", shift):
        assert np.abs(got[name] - want).max() < 0.12


def test_many_blocks_are_one_block(spark):
    f = speckle((16, 16, 16))
    small = blocks.autocovariance(brick_table(spark, 4, data=f), 4, 2, float(f.mean())).toPandas().set_index(["hz", "hy", "hx"]).sort_index()
    whole = blocks.autocovariance(brick_table(spark, 16, data=f), 16, 2, float(f.mean())).toPandas().set_index(["hz", "hy", "hx"]).sort_index()
    assert np.allclose(small["s"], whole["s"]) and (small["pairs"] == whole["pairs"]).all()
    d = f - f.mean()
    assert np.isclose(small.loc[(1, 0, 2), "s"], (d[:-1, :, :-2] * d[1:, :, 2:]).sum())


def test_motions(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-50, 50, (200, 3))
    a = math.radians(20)
    r = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    u = x @ r.T + [1.0, -2.0, 0.5] - x
    rows = [(0, *map(float, p), *map(float, q)) for p, q in zip(x, u)] + [(1, 0.0, 0.0, 0.0, 1.0, None, 1.0), (1, 1.0, 0.0, 0.0, 1.0, 2.0, 1.0)]
    field = spark.createDataFrame(rows, "frame int, x double, y double, z double, u double, v double, w double")
    m = {row["frame"]: row for row in motion.fit(field, "rigid", "frame").collect()}
    got = np.array([[m[0][f"a{i}{j}"] for j in (1, 2, 3)] for i in (1, 2, 3)])
    assert np.allclose(got, r) and m[1]["a11"] is None and m[1]["n"] == 1
    assert motion.residual(field.where("frame = 0"), "rigid", "frame").first()["rms"] < 1e-9
    assert motion.residual(field.where("frame = 0"), "affine", "frame").first()["rms"] < 1e-9
    assert motion.residual(field.where("frame = 0"), "translation", "frame").first()["rms"] > 1


def grid(spark, n=6, missing=()):
    rows = [(ix + n * iy + n * n * iz, ix, iy, iz, 0.5 * ix - 0.25 * iy + 2.0 * iz + 1, (ix, iy, iz) not in missing) for ix in range(n) for iy in range(n) for iz in range(n)]
    return spark.createDataFrame(rows, "node_id long, ix long, iy long, iz long, f double, node_valid boolean")


def test_gradient_is_exact_on_linear_fields(spark):
    g = stencil.gradient(grid(spark, missing={(2, 2, 2), (0, 0, 0)}), "f", "node_valid", 1.0).where("node_valid").collect()
    assert all(abs(r["d_ix"] - 0.5) < 1e-12 and abs(r["d_iy"] + 0.25) < 1e-12 and abs(r["d_iz"] - 2) < 1e-12 for r in g)


def test_harmonic_fill_and_components(spark):
    hole = {(2, 2, 2), (2, 3, 2), (4, 4, 4)}
    n = grid(spark, missing=hole).withColumn("g", F.when(F.col("node_valid"), F.col("f")))
    got = {r["node"]: r["filled"] for r in graphs.harmonic_fill(n, "g").collect()}
    want = {r["node_id"]: r["f"] for r in n.where("not node_valid").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)  # linear fields are harmonic
    parts = {r["node"]: r["component"] for r in graphs.grid_components(n.where("not node_valid")).collect()}
    assert len(set(parts.values())) == 2


def test_regions(spark):
    n = grid(spark).select("node_id", F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"), F.col("iz").cast("double").alias("z"))
    tri = regions.Prism("xy", "polygon", ((-0.5, -0.5), (4.7, -0.5), (-0.5, 4.7)), 1, 3)
    assert n.where(tri.contains()).count() == 3 * sum(1 for x in range(6) for y in range(6) if x + y <= 4)
    assert n.where(regions.parse("sphere", {"centre": [2.0, 2.0, 2.0], "radius": 1.0}).contains()).count() == 7
    for shape, params in (("cone", {}), ("sphere", {"centre": [0.0, 0.0, 0.0], "radius": -1.0}), ("box", {"lo": [1.0, 0.0, 0.0], "hi": [0.0, 1.0, 1.0]})):
        with pytest.raises(ValueError):
            regions.parse(shape, params)


def test_crossings(spark):
    cases = {"a": [1, 0.8, 0.5, 0.2], "b": [1, 0.5, 0.5, 0.2], "c": [1, 0.9, 0.8], "d": [0.4, 0.1], "e": [1.0], "f": [1, None, 0.1], "g": [1, 0.6, 0.4]}
    rows = [(k, i, None if y is None else float(y)) for k, v in cases.items() for i, y in enumerate(v)]
    got = {r["box"]: (r["value"], r["status"]) for r in texture.crossings(spark.createDataFrame(rows, "box string, lag int, y double"), (0.5,), "box").collect()}
    assert got["a"] == (2.0, "crossed") and got["b"] == (2.0, "plateau") and got["c"] == (None, "not_crossed")
    assert got["d"] == got["e"] == got["f"] == (None, "invalid") and abs(got["g"][0] - 1.5) < 1e-12


def test_strain_measures(spark):
    rng = np.random.default_rng(2)
    h = rng.normal(0, 0.1, (20, 3, 3))
    df = spark.createDataFrame([tuple(map(float, m.ravel())) for m in h], ", ".join(f"h{i}{j} double" for i in (1, 2, 3) for j in (1, 2, 3)))
    t = st.tensor()
    e = st.infinitesimal(t)
    cols = [c.alias(f"p{k}") for k, c in enumerate(st.principal(e))] + [st.det(st.deformation(t)).alias("det"), st.euler_almansi(t)[0][1].alias("ea"), st.green_lagrange(t)[1][2].alias("gl"), st.von_mises(e).alias("vm")]
    for m, r in zip(h, df.select(*cols).collect()):
        f = m + np.eye(3)
        s = (m + m.T) / 2
        assert np.allclose([r["p0"], r["p1"], r["p2"]], np.linalg.eigvalsh(s)[::-1])
        assert np.isclose(r["det"], np.linalg.det(f)) and np.isclose(r["gl"], ((f.T @ f - np.eye(3)) / 2)[1, 2])
        assert np.isclose(r["ea"], ((np.eye(3) - np.linalg.inv(f @ f.T)) / 2)[0, 1])
        d = s - np.trace(s) / 3 * np.eye(3)
        assert np.isclose(r["vm"], math.sqrt(2 / 3 * (d * d).sum()))


def test_block_matching_takes_every_step(spark):
    """The quadratic through 27 correlations, Gauss-Newton after it, and the peak's share of the energy, against single subsets."""
    f, c, half, radius = speckle((24, 24, 24)), np.array([12, 12, 12]), 3, 2
    shift = np.array([0.4, -0.7, 1.3])
    phase = sum(np.fft.fftfreq(24).reshape([-1 if a == k else 1 for a in range(3)]) * shift[k] for k in range(3))
    g = np.fft.ifftn(np.fft.fftn(f) * np.exp(-2j * math.pi * phase)).real
    cut = lambda v, at: v[tuple(slice(a - half, a + half + 1) for a in at)].ravel()
    want = np.array([np.corrcoef(cut(f, c), cut(g, c + d - radius))[0, 1] for d in np.ndindex(5, 5, 5)])
    maps, flat = blocks.correlation_maps(f, g, c[None], half, radius)
    assert np.allclose(maps[0], want) and not flat.any()
    whole, zncc, sub, pce, border = blocks.peaks(maps, flat, radius)
    assert whole[0].tolist() == (np.array(list(np.ndindex(5, 5, 5))[want.argmax()]) - radius).tolist() and not border[0] and zncc[0] == pytest.approx(want.max())
    assert pce[0] == pytest.approx((want.max() - want.min()) ** 2 / ((want - want.min()) ** 2).mean())
    around = np.array(list(np.ndindex(3, 3, 3))) - 1
    x, y, z = around.T
    c27 = want.reshape(5, 5, 5)[tuple((whole[0] + radius + around).T)]
    a = np.linalg.lstsq(np.stack([np.ones(27), x, y, z, x * x, y * y, z * z, x * y, x * z, y * z], 1), c27, rcond=None)[0]
    top = np.linalg.solve([[2 * a[4], a[7], a[8]], [a[7], 2 * a[5], a[9]], [a[8], a[9], 2 * a[6]]], -a[1:4])
    assert np.allclose(sub[0], top) and np.abs(whole + sub - shift).max() < 0.5
    got = blocks.correlate(brick_table(spark, 8, ref=f, **{"def": g}), 8, half, radius).where("bz = 1 and by = 1 and bx = 1").first()
    assert got["n_iter"] > 0 and got["pce"] == pytest.approx(pce[0]) and got["ok"] and got["zncc"] > zncc[0]
    assert np.abs(np.array([got[k] for k in "wvu"]) - shift).max() < 0.1


def test_block_matching_query_refines_and_recovers_the_shift(spark, sf):
    from voxlattice.catalog import QUERIES

    got = QUERIES["job1_block_matching"](spark, sf).where("ok").toPandas()
    assert (got["n_iter"] > 0).mean() > 0.6 and (got["pce"] > 1).all()
    assert np.abs(got[["u", "v", "w"]] - [1, 0, 0]).to_numpy().max() < 1e-6


def test_flat_subsets_match_nothing(spark):
    f = np.full((16, 16, 16), 0.1)
    got = blocks.correlate(brick_table(spark, 8, ref=f, **{"def": f}), 8, 2, 1).collect()
    assert len(got) == 8 and all(r["zncc"] is None and r["pce"] is None and not r["ok"] and not r["clipped"] and r["n_iter"] == 0 for r in got)
