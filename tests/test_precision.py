"""Displacement deviations against matrices summed voxel by voxel."""

import numpy as np

from voxlattice.operators import precision
from voxlattice.plans import solids


def deviation(g, o, v, zncc, half, gain, corrected):
    """su, sv, sw of one subset from its voxels' Jacobian; coordinates by the whole subset."""
    n = len(v)
    q = np.hstack([o, np.ones((n, 1))])
    jac = np.hstack([(g[:, :, None] * o[:, None, :]).reshape(n, 9), g])
    h = jac.T @ jac
    axis = [np.arange(-k, k + 1) for k in half]
    full = np.array([(x, y, z, 1) for x in axis[0] for y in axis[1] for z in axis[2]], float)
    m = full.T @ full * n / len(full)
    noise = np.zeros((12, 12))
    for a in range(3):
        own = [3 * a, 3 * a + 1, 3 * a + 2, 9 + a]
        noise[np.ix_(own, own)] = gain * m
    lost = (1 - zncc) * ((v - v.mean()) ** 2).sum()
    s2 = lost / n
    if corrected:
        share = min(1.0, *(0.9 * h[i, i] / (s2 * noise[i, i]) for i in (9, 10, 11)))
        h = h - share * s2 * noise
    inverse = np.linalg.inv(h)
    cov = 2 * lost / (n - 12) * inverse + (s2 * s2 * inverse @ noise @ inverse if corrected else 0)
    return np.sqrt(np.maximum(np.diag(cov)[9:], 0)), q.shape


def test_deviations(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for key, corr in enumerate((0.99, 0.9, 0.999)):
        o = np.array([(x, y, z) for x in range(-2, 3) for y in range(-1, 2) for z in range(-3, 4)], float)
        if key == 1:
            o = o[rng.random(len(o)) < 0.6]
        g, v = rng.normal(size=(len(o), 3)), rng.normal(size=len(o))
        rows += [(key, corr, *map(float, (*g[i], *o[i], v[i]))) for i in range(len(o))]
        want[key] = [deviation(g, o, v, corr, (2, 1, 3), 1.17, c)[0] for c in (False, True)]
    rows += [(5, 0.9, 1.0, 0.0, 0.0, float(i), 0.0, 0.0, 1.0 * i) for i in range(20)] + [(6, 0.9, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0)] * 3 + [(7, None, *map(float, rng.normal(size=7))) for _ in range(40)]
    rows += [(0, 0.99, None, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0), (0, 0.99, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "key long, zncc double, gx double, gy double, gz double, ox double, oy double, oz double, v double")
    sums = precision.normal_equations(df, "v", ("gx", "gy", "gz"), ("ox", "oy", "oz"), "key", "zncc")
    for c in (False, True):
        got = {r["key"]: r for r in precision.displacement_deviation(sums, "zncc", (2, 1, 3), gain=1.17, corrected=c).collect()}
        assert sorted(got) == [0, 1, 2, 5, 6, 7] and all(got[k]["su"] is None for k in (5, 6, 7))
        for k, w in want.items():
            assert np.allclose([got[k][s] for s in ("su", "sv", "sw")], w[c], rtol=1e-9)


def test_query(spark, sf):
    v = solids.subset_voxels(spark, sf).toPandas()
    got = solids.job10_displacement_deviation(spark, sf).toPandas().set_index(["tz", "ty", "tx"])
    seen = 0
    for key, rows in v.groupby(["tz", "ty", "tx"]):
        zncc = np.corrcoef(rows["v"], rows["d"])[0, 1]
        kept = rows.dropna(subset=["gx", "gy", "gz"])
        if key not in got.index:
            assert kept.empty
            continue
        assert got.loc[key, "n"] == len(kept)
        if len(kept) > 40:
            seen += got.loc[key, "su"] > 0
            want, _ = deviation(kept[["gx", "gy", "gz"]].to_numpy(), kept[["ox", "oy", "oz"]].to_numpy(float), kept["v"].to_numpy(), zncc, (3, 3, 3), 2 * (0.75**2 + 0.15**2 + 1 / 60**2), True)
            assert np.allclose(got.loc[key, ["su", "sv", "sw"]].to_numpy(float), want, atol=2e-6)
    assert seen > 3
