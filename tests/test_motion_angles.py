"""Rotation vectors, Euler angles and stretches of fitted motions against NumPy."""

import numpy as np
import pytest

from voxlattice.operators import motion


def turn(axis, degrees):
    """The rotation about a coordinate axis."""
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    i, j = [(1, 2), (2, 0), (0, 1)][axis]
    r = np.eye(3)
    r[i, i], r[i, j], r[j, i], r[j, j] = c, -s, s, c
    return r


def about(v):
    """The rotation of a rotation vector in degrees."""
    angle = np.radians(np.linalg.norm(v))
    if not angle:
        return np.eye(3)
    x, y, z = v / np.linalg.norm(v)
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def test_angles(spark):
    rng = np.random.default_rng(2)
    eulers = [rng.uniform(-80, 80, 3) for _ in range(20)] + [np.array(e, float) for e in ((0, 0, 0), (180, 0, 0), (0, 0, 180), (30, 90, 0), (30, -90, 0), (1e-9, 0, 0), (170, 20, -160))]
    matrices = [turn(2, z) @ turn(1, y) @ turn(0, x) for x, y, z in eulers]
    names = [f"a{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]
    rows = spark.createDataFrame([(k, *map(float, m.ravel())) for k, m in enumerate(matrices)], "frame int, " + ", ".join(f"{n} double" for n in names))
    for r in motion.angles(rows).collect():
        m = matrices[r["frame"]]
        assert np.allclose(about(np.array([r["rv1"], r["rv2"], r["rv3"]])), m, atol=1e-7)
        assert np.allclose(turn(2, r["ez"]) @ turn(1, r["ey"]) @ turn(0, r["ex"]), m, atol=1e-7)
        assert r["rotation_deg"] == pytest.approx(np.linalg.norm([r["rv1"], r["rv2"], r["rv3"]]), abs=1e-6)
    gradients = [m @ (np.eye(3) + np.diag(rng.uniform(0, 0.3, 3))) for m in matrices]
    rows = spark.createDataFrame([(k, *map(float, g.ravel())) for k, g in enumerate(gradients)] + [(99, *[None] * 9)], "frame int, " + ", ".join(f"{n} double" for n in names))
    for r in motion.polar(rows).collect():
        if r["frame"] == 99:
            assert r["r11"] is None and r["s33"] is None
            continue
        rot, s = (np.array([[r[f"{k}{i}{j}"] for j in (1, 2, 3)] for i in (1, 2, 3)]) for k in "rs")
        assert np.allclose(rot, matrices[r["frame"]], atol=1e-9) and np.allclose(s, s.T, atol=1e-9) and np.allclose(rot @ s, gradients[r["frame"]], atol=1e-9)
