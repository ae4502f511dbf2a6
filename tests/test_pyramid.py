"""Matching at nodes against a plain search over every shift."""

import numpy as np
from test_operators import brick_table, speckle

from voxlattice.operators import blocks, pyramid
from voxlattice.plans import jobs

MOVE = (5, -6, 7)


def node_table(spark, centres, starts=None):
    rows = [(i, *map(int, c[::-1] // 8), *map(int, c), *map(int, s)) for i, (c, s) in enumerate(zip(centres, starts if starts is not None else np.zeros_like(centres)))]
    return spark.createDataFrame(rows, "node_id long, ix long, iy long, iz long, z long, y long, x long, sz long, sy long, sx long")


def test_search_is_the_plain_search(spark):
    rng = np.random.default_rng(2)
    f, g = rng.normal(size=(2, 16, 24, 16))
    centres = np.stack([rng.integers(0, n, 30) for n in f.shape], 1)
    starts = rng.integers(-6, 7, size=(30, 3))
    got = {r["node_id"]: r for r in pyramid.search(brick_table(spark, 8, ref=f, **{"def": g}), 8, node_table(spark, centres, starts), 2, 3).collect()}
    # the plain search takes its shifts from zero, so the moved volume is cut out around the start
    pad = 24
    wide = [np.pad(v, pad, constant_values=np.nan) for v in (f, g)]
    assert len(got) == 30
    for i, (c, s) in enumerate(zip(centres, starts)):
        shifted = np.roll(wide[1], tuple(-s), axis=(0, 1, 2))
        shift, zncc, clipped = blocks.search(wide[0], shifted, c + pad, 2, 3)
        r = got[i]
        if np.isnan(zncc):
            assert r["zncc"] is None and not r["clipped"]
        else:
            assert (r["tz"], r["ty"], r["tx"]) == tuple(s + shift) and abs(r["zncc"] - zncc) < 1e-9 and r["clipped"] == clipped
    assert 5 < sum(r["zncc"] is None for r in got.values()) < 30


def test_flat_and_absent(spark):
    f = np.ones((8, 8, 8))
    got = pyramid.search(brick_table(spark, 8, ref=f, **{"def": f}), 8, node_table(spark, np.array([[4, 4, 4], [0, 4, 4], [90, 4, 4]])), 2, 1).collect()
    assert sorted(r["node_id"] for r in got) == [0, 1, 2] and all(r["zncc"] is None for r in got)


def test_wider_rounds_for_clipped_nodes_only(spark):
    f = speckle((32, 32, 32))
    g = f.copy()
    g[:, :, 16:] = np.roll(f, 5, axis=0)[:, :, 16:]  # only half of the volume moves far
    centres = np.array([(z, y, x) for z in (12, 16) for y in (12, 20) for x in (8, 24)])
    found = pyramid.expanding_search(brick_table(spark, 8, ref=f, **{"def": g}), 8, node_table(spark, centres), 4, 2).toPandas().sort_values("node_id")
    far = centres[:, 2] == 24
    assert (found["tz"] == np.where(far, 5, 0)).all() and (found["rounds"] == np.where(far, 3, 1)).all() and (found["radius"] == np.where(far, 8, 2)).all()


def test_pyramid_finds_what_no_direct_search_reaches(spark):
    f = speckle((48, 48, 48))
    g = np.roll(f, MOVE, axis=(0, 1, 2))
    centres = np.array([(z, y, x) for z in range(12, 37, 8) for y in range(12, 37, 8) for x in range(12, 37, 8)])
    bricks = brick_table(spark, 8, ref=f, **{"def": g})
    found = pyramid.pyramid_search(bricks, 8, node_table(spark, centres).drop("sz", "sy", "sx"), 4, 8, 1).toPandas()
    assert len(found) == 64
    for name, want in zip("wvu", MOVE):
        assert (found[name].round(6) == want).mean() > 0.95
    small = pyramid.halve(bricks, 8).toPandas()
    for r in small.itertuples():
        cut = tuple(slice(k * 16, k * 16 + 16) for k in (r.bz, r.by, r.bx))
        assert np.allclose(np.reshape(r.ref, (8, 8, 8)), f[cut].reshape(8, 2, 8, 2, 8, 2).mean(axis=(1, 3, 5)))
    assert len(small) == 27


def test_queries(spark, sf):
    out = jobs.job2_expanding_search(spark, sf).toPandas()
    far = out[(out["u"] == 5) & (out["v"] == 0) & (out["w"] == 0)]
    assert len(far) > 20 and (far["zncc"] > 0.999).all() and (far["radius"] == 8).all()
    out = jobs.job2_pyramid_search(spark, sf).toPandas()
    assert ((out["u"] == 4) & (out["v"] == 0) & (out["w"] == 0)).sum() > 20
