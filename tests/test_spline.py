"""Cubic splines on the node grid against a dense solve."""

import itertools

import numpy as np
import pytest

from voxlattice.operators import spline


def dense(f):
    """Coefficients of a line by a dense solve with no curvature at the ends."""
    n = len(f)
    if n < 2:
        return f.copy()
    a, b = np.zeros((n, n)), f * 6
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = 1, 4, 1
    a[0, 0] = a[-1, -1] = 6
    return np.linalg.solve(a, b)


def at(c, g):
    """A line's value at g from its coefficients, continued by odd reflection."""
    n = len(c) - 1
    if n == 0:
        return c[0]
    g = min(max(g, -min(10, n)), n + min(10, n))
    if g < 0:
        return 2 * c[0] - at(c, -g)
    if g > n:
        return 2 * c[n] - at(c, 2 * n - g)
    full = np.concatenate([[2 * c[0] - c[1]], c, [2 * c[n] - c[n - 1]]])
    i = min(int(g), n - 1)
    t = g - i
    w = np.array([(1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, -3 * t**3 + 3 * t**2 + 3 * t + 1, t**3]) / 6
    return w @ full[i : i + 4]


@pytest.mark.parametrize("shape", [(5, 4, 6), (7, 1, 2), (3, 3, 1)])
def test_spline_equals_a_dense_solve(spark, shape):
    rng = np.random.default_rng(3)
    f = rng.normal(size=shape)
    lo = (2, 0, 5)
    nodes = spark.createDataFrame([(*(int(a + b) for a, b in zip(n, lo)), float(f[n])) for n in itertools.product(*map(range, shape))], "ix long, iy long, iz long, f double")
    c = f
    for axis in range(3):
        c = np.apply_along_axis(dense, axis, c)
    points = [(i, *(float(rng.uniform(a - 1.5, a + k + 0.5)) for a, k in zip(lo, shape))) for i in range(40)] + [(90, 2.0, 0.0, 5.0)]
    points += [(91, *(float(a + k - 1) for a, k in zip(lo, shape)))]
    got = {r["pid"]: r["value"] for r in spline.interpolate(spark.createDataFrame(points, "pid long, gx double, gy double, gz double"), nodes, "f").collect()}
    for i, *g in points:
        u = [a - b for a, b in zip(g, lo)]
        plane = np.array([[at(c[x, y], u[2]) for y in range(shape[1])] for x in range(shape[0])])
        line = np.array([at(row, u[1]) for row in plane])
        assert got[i] == pytest.approx(at(line, u[0]), abs=1e-9)
    assert got[90] == pytest.approx(f[0, 0, 0]) and got[91] == pytest.approx(f[-1, -1, -1])


def test_linear_fields_and_gaps(spark):
    nodes = [(x, y, z, 2.0 * x - y + 0.5 * z) for x, y, z in itertools.product(range(5), range(4), range(3))]
    make = lambda rows: spark.createDataFrame(rows, "ix long, iy long, iz long, f double")
    points = spark.createDataFrame([(1, 0.3, 2.7, 1.9), (2, -1.2, 3.4, 2.5), (3, 4.0, 0.0, 0.0)], "pid long, gx double, gy double, gz double")
    got = {r["pid"]: r["value"] for r in spline.interpolate(points, make(nodes), "f").collect()}
    assert got == {1: pytest.approx(0.6 - 2.7 + 0.95), 2: pytest.approx(-2.4 - 3.4 + 1.25), 3: pytest.approx(8.0)}
    holes = [(*n[:3], None if n[:3] == (2, 1, 1) else n[3]) for n in nodes if n[:3] != (0, 3, 2)]
    assert {r["value"] for r in spline.interpolate(points, make(holes), "f").collect()} == {None}


def test_long_lines_go_by_stretches(spark):
    rng = np.random.default_rng(4)
    shape, lo = (3, 1, 1300), (0, 0, -7)
    f = rng.normal(size=shape)
    rows = [(*(int(a + b) for a, b in zip(n, lo)), float(f[n])) for n in itertools.product(*map(range, shape))]
    make = lambda rows: spark.createDataFrame(rows, "ix long, iy long, iz long, f double")
    c = f
    for axis in range(3):
        c = np.apply_along_axis(dense, axis, c)
    border = spline.LINE + lo[2]
    points = [(i, float(rng.uniform(-1, 3)), 0.0, float(z)) for i, z in enumerate([*(border + rng.uniform(-3, 3, 30)), *(lo[2] + rng.uniform(-12, 1312, 40)), border, border - 1, lo[2], lo[2] + 1299])]
    table = spark.createDataFrame(points, "pid long, gx double, gy double, gz double")
    got = {r["pid"]: r["value"] for r in spline.interpolate(table, make(rows), "f").collect()}
    for i, x, _, z in points:
        assert got[i] == pytest.approx(at(np.array([at(line, z - lo[2]) for line in c[:, 0]]), x), abs=1e-9)
    # no row holds a whole line
    s = spline._stretches(make(rows).withColumnRenamed("f", "c"), "iz", lo[2], lo[2] + 1299)
    assert max(len(r["c"]) for r in s.select("c").collect()) <= spline.LINE + 3 and s.count() == 9
    # a gap voids its line from end to end, and no other
    far = spark.createDataFrame([(1, 0.3, 0.0, 100.0), (2, 2.0, 0.0, 100.0)], "pid long, gx double, gy double, gz double")
    got = {r["pid"]: r["value"] for r in spline.interpolate(far, make([n for n in rows if n[:3] != (0, 0, 1200)]), "f").collect()}
    assert got[1] is None and got[2] == pytest.approx(c[2, 0, 107] * 4 / 6 + (c[2, 0, 106] + c[2, 0, 108]) / 6)
