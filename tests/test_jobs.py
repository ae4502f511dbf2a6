"""File sources and sinks, small solves and frame streaming."""

import math

import numpy as np
from pyspark.sql import functions as F

from voxlattice.operators import solve
from voxlattice.sources import volumes
from voxlattice.streaming import frames


def test_volumes_round_trip(spark, tmp_path):
    v = np.random.default_rng(0).normal(size=(5, 6, 7)).astype("f4")
    np.save(tmp_path / "a.npy", v)
    b = volumes.read_volumes(spark, f"{tmp_path}/a.npy", edge=4)
    got = volumes.voxels_of(b, 4)
    back = np.zeros(v.shape)
    for r in got.collect():
        back[r["z"], r["y"], r["x"]] = r["v"]
    assert b.count() == 8 and np.allclose(back, v)
    m = volumes.brick_moments(b).first()
    assert m["n"] == 210 and np.isclose(m["mean"], v.mean(dtype=float)) and np.isclose(m["std"], v.std(dtype=float))


def test_slices(spark):
    import io

    rows = []
    for z in range(5):
        raw = io.BytesIO()
        np.save(raw, np.full((3, 4, 3), float(z)))
        rows.append(("s", z, raw.getvalue()))
    got = volumes.voxels_of(volumes.stack_slices(spark.createDataFrame(rows, "path string, z int, content binary"), 2), 2)
    assert got.count() == 60 and got.where(F.abs(F.col("v") - F.col("z")) > 1e-5).count() == 0


def test_result_tables_and_csv(spark, tmp_path):
    t = spark.createDataFrame([(0, 1.0), (1, float("nan"))], "frame int, u double")
    volumes.write_result({"disp": t}, f"{tmp_path}/r")
    volumes.write_result({"disp": t.where("frame = 1").withColumn("u", F.lit(5.0))}, f"{tmp_path}/r")
    assert sorted(r["u"] for r in volumes.read_result(spark, f"{tmp_path}/r", "disp")["disp"].collect()) == [1.0, 5.0]
    volumes.write_frames_csv(t.withColumn("x", F.lit(8)), f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").where("u is null").count() == 1


def test_rotation_and_hencky(spark):
    a = math.radians(30)
    r = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    h = r @ np.diag([1.2, 1.0, 0.9]) - np.eye(3)
    names = [f"h{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]
    df = spark.createDataFrame([tuple(map(float, h.ravel())), (None,) + (0.0,) * 8], ", ".join(f"{n} double" for n in names))
    got = solve.rotations_and_hencky(df).collect()
    assert abs(got[0]["rotation_deg"] - 30) < 1e-9 and got[1]["rotation_deg"] is None
    assert abs(got[0]["hencky11"] + got[0]["hencky22"] + got[0]["hencky33"] - math.log(1.2 * 0.9)) < 1e-9


def worth_of(at, d, removed):
    """n^2 over the summed correlation of all pairs of nodes, pair by pair, with the rules of mean_confidence."""
    n, var = len(d), (d * d).mean()
    r = np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1))
    lags, where = np.unique((at[:, None] - at[None]).reshape(-1, 3), axis=0, return_inverse=True)
    pairs = np.bincount(where.ravel())
    rho = np.bincount(where.ravel(), weights=np.outer(d, d).ravel()) / pairs / var
    radius = np.sqrt((lags**2).sum(1))
    sure = pairs >= max(1, n / 4)
    means, cut = {}, int(np.floor(radius[sure].max())) + 1
    for k in range(1, cut):
        s = sure & (np.floor(radius) == k)
        means[k] = rho[s].mean() if s.any() else -1
        if means[k] < 0.05:
            cut = k
            break
    near = radius < cut
    total, seen = (pairs * rho)[near].sum(), pairs[near].sum()
    total /= 1 - removed * (seen - total) / n**2
    w, q = solve._decay([(k, v) for k, v in means.items() if v > -1])
    if w > 0:
        total += (pairs * np.exp(-w * radius**q))[~near].sum()
    assert r.shape == (n, n)
    return min(max(n * n / total, 1), n)


def test_intervals(spark):
    assert abs(solve.t_quantile(0.975, 10) - 2.228139) < 1e-4 and abs(solve.t_quantile(0.975, 1000) - 1.962339) < 1e-4
    rng = np.random.default_rng(4)
    noise = rng.normal(size=(12, 12, 12))
    smooth = sum(np.roll(noise, k, axis) for axis in range(3) for k in (-1, 0, 1, 2))
    at = np.array([p for p in np.ndindex(8, 8, 8) if rng.random() < 0.8])
    rows = []
    for key, field in ((0, noise), (1, smooth)):
        rows += [(key, *map(int, p + 5), float(field[tuple(p)] + 0.1 * p[0])) for p in at]
    rows += [(2, 0, 0, 0, 1.5), (3, 0, 0, 0, None), (4, 1, 1, 1, 2.0), (4, 1, 1, 2, 2.0)]
    got = {r["key"]: r for r in solve.mean_confidence(spark.createDataFrame(rows, "key int, ix int, iy int, iz int, u double"), "u", "key").collect()}
    for key, field in ((0, noise), (1, smooth)):
        v = np.array([field[tuple(p)] + 0.1 * p[0] for p in at])
        a = np.column_stack([np.ones(len(at)), at])
        d = v - a @ np.linalg.lstsq(a, v, rcond=None)[0]
        want = worth_of(at, d, 4)
        dof = max(want - 4, 1)
        assert np.isclose(got[key]["n_eff"], want, rtol=1e-6) and got[key]["n"] == len(at)
        assert np.isclose(got[key]["half_width"], solve.t_quantile(0.975, dof) * d.std() / math.sqrt(dof), rtol=1e-6)
    assert got[1]["n_eff"] < 0.6 * got[0]["n_eff"]
    assert got[2]["n_eff"] == 1 and got[2]["half_width"] is None and 3 not in got and got[4]["half_width"] == 0


def test_quantiles_by_brackets(spark):
    from voxlattice.operators import stats

    rng = np.random.default_rng(2)
    rows = [(0, float(v)) for v in rng.lognormal(0, 3, 3000)] + [(1, 4.0)] * 50 + [(2, float(v)) for v in rng.integers(0, 3, 500)] + [(3, 1.0), (3, None), (4, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    probs = {"a": 0.05, "b": 0.5, "c": 0.995}
    for most in (0, 10**6):
        got = {r["k"]: tuple(r)[1:] for r in stats.quantiles(df, "v", probs, "k", most=most).collect()}
        for k in (0, 1, 2, 3):
            assert np.allclose(got[k], np.quantile([v for j, v in rows if j == k and v is not None], list(probs.values())), rtol=1e-12)
        assert 4 not in got
    one, two = (sorted(map(tuple, stats.summarize(df, "v", "k", most=most).collect())) for most in (0, 10**6))
    assert len(one) == 5 and all(a == b or abs(a - b) < 1e-9 * abs(b) for x, y in zip(one, two) for a, b in zip(x, y))


def test_wide_gaps_are_filled_too(spark):
    from voxlattice.operators import graphs

    rng = np.random.default_rng(7)
    known = rng.random((6, 6, 6)) < 0.35
    rows = [(int(x + 6 * y + 36 * z), x, y, z, float(x * x + y - z) if known[x, y, z] else None) for x, y, z in np.ndindex(6, 6, 6)]
    df = spark.createDataFrame(rows, "node_id long, ix int, iy int, iz int, v double")
    one, two = ({r["node"]: r["filled"] for r in graphs.harmonic_fill(df, "v", largest=n).collect()} for n in (20_000, 3))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-8 for k in one) and len(one) == (~known).sum()
    alone = spark.createDataFrame([(1, 0, 0, 0, None), (2, 1, 0, 0, None)], "node_id long, ix int, iy int, iz int, v double")
    assert [[r["filled"] for r in graphs.harmonic_fill(alone, "v", largest=n).collect()] for n in (10, 1)] == [[None, None]] * 2


def test_phase_shift_and_solve(spark):
    f = np.random.default_rng(9).normal(size=(16, 16, 16))
    g = np.roll(f, (1, -2, 3), (0, 1, 2))
    rows = [(0, *map(int, k), float(f[k]), float(g[k])) for k in np.ndindex(f.shape)]
    df = spark.createDataFrame(rows, "pair int, z int, y int, x int, a double, b double")
    assert tuple(solve.phase_shift(df, "a", "b", "pair").first())[1:] == (3, -2, 1)
    nodes = df.where("z < 4 and y < 4 and x < 4").select("pair", (F.col("x") + 4 * F.col("y") + 16 * F.col("z")).cast("long").alias("node_id"), F.col("x").alias("ix"), F.col("y").alias("iy"), F.col("z").alias("iz"), "a")
    s = solve.compatible_field(nodes, "a", 1.5, "pair").collect()
    assert len(s) == 64 and s[0]["residual"] < 1e-9
    assert abs(sum(r["smooth"] for r in s) - sum(r["a"] for r in nodes.collect())) < 1e-6  # the Laplacian keeps the sum


def test_frames_wait_for_parents(spark, tmp_path):
    schedule = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "frame long, ref long")
    pairs = [(3, 7, 0.5), (1, 7, 1.0), (2, 7, 2.0)]
    make = lambda rows: spark.createDataFrame(rows, "frame long, node_id long, u double")
    frames.advance(make(pairs[:1]), schedule, f"{tmp_path}/a")
    assert frames.waiting(spark, f"{tmp_path}/a").count() == 1
    frames.advance(make(pairs[1:]), schedule, f"{tmp_path}/a")
    got = {r["frame"]: r["u_total"] for r in spark.read.parquet(f"{tmp_path}/a/total").collect()}
    assert got == {1: 1.0, 2: 3.0, 3: 3.5}
    # a run that broke off after it wrote what waits, before the pointer moved: nothing is lost, nothing comes twice
    frames.advance(make(pairs[:1]), schedule, f"{tmp_path}/d")
    make([(3, 7, 9.9)]).selectExpr("2L as version", "node_id", "u", "frame").write.mode("append").partitionBy("version").parquet(f"{tmp_path}/d/waiting")
    assert [tuple(r) for r in frames.waiting(spark, f"{tmp_path}/d").collect()] == [(3, 7, 0.5)]
    frames.advance(make([*pairs[1:], (2, 7, 1.5)]), schedule, f"{tmp_path}/d")
    assert {r["frame"]: r["u_total"] for r in spark.read.parquet(f"{tmp_path}/d/total").collect()} == got
    make(pairs).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("frame long, node_id long, u double").parquet(f"{tmp_path}/in")
    frames.follow(stream, schedule, f"{tmp_path}/b", f"{tmp_path}/c").awaitTermination(90)
    assert {r["frame"]: r["u_total"] for r in spark.read.parquet(f"{tmp_path}/b/total").collect()} == got
