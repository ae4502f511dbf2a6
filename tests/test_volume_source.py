"""Volume files as a data source: layouts, partitions, filters, commit; and windows of cut grids against brute force."""

import itertools
import os
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxlattice.operators import reach
from voxlattice.sources import volume_source as vs


def bricks_of(volume, edge):
    rows = []
    for b in np.ndindex(*(-(-n // edge) for n in volume.shape)):
        part = np.ascontiguousarray(volume[tuple(slice(k * edge, (k + 1) * edge) for k in b)], "<f4")
        rows.append(("v", *map(int, b), *map(int, part.shape), bytearray(part.tobytes())))
    return rows


def volume_of(rows, shape, edge):
    out = np.full(shape, np.nan, "<f4")
    for r in rows:
        at = tuple(slice(b * edge, b * edge + n) for b, n in zip((r.bz, r.by, r.bx), (r.nz, r.ny, r.nx)))
        assert np.isnan(out[at]).all()
        out[at] = np.frombuffer(r.data, "<f4").reshape(r.nz, r.ny, r.nx)
    return out


@pytest.fixture(scope="module")
def volume():
    return np.random.default_rng(3).normal(size=(13, 21, 17)).astype("<f4")


@pytest.mark.parametrize("suffix,kind", [(".npy", "<f4"), (".nrrd", "<f8"), (".nii", "<f4"), (".raw", "<f8"), (".npy", "<i2")])
def test_round_trip(spark, tmp_path, volume, suffix, kind):
    want = volume if kind != "<i2" else np.rint(100 * volume).astype("<f4")
    path = f"{tmp_path}/v{suffix}"
    vs.save_volume(spark.createDataFrame(bricks_of(want, 5), vs.BRICKS).repartition(4), path, want.shape, 5, dtype=kind)
    assert os.listdir(tmp_path) == [f"v{suffix}"]
    options = {"shape": "13,21,17", "dtype": kind} if suffix == ".raw" else {}
    for edge, size in ((5, 1), (8, 4000), (64, 1 << 26)):
        got = vs.open_volumes(spark, path, edge, partitionBytes=str(size), **options)
        assert np.array_equal(volume_of(got.collect(), want.shape, edge), want)
    if suffix == ".npy":
        assert np.array_equal(np.load(path), want)


def test_layouts(spark, tmp_path, volume):
    np.save(f"{tmp_path}/f.npy", np.asfortranarray(volume))
    np.save(f"{tmp_path}/t.npy", volume.transpose(2, 1, 0))
    np.save(f"{tmp_path}/big.npy", volume.astype(">f8")[None])
    np.save(f"{tmp_path}/plane.npy", volume[0])
    for name, options, want in (("f", {}, volume), ("t", {"transposed": "true"}, volume), ("big", {}, volume), ("plane", {}, volume[:1])):
        assert np.array_equal(volume_of(vs.open_volumes(spark, f"{tmp_path}/{name}.npy", 6, **options).collect(), want.shape, 6), want)
    head = bytearray(vs._header(".nii", np.dtype("<f4"), volume.shape))
    struct.pack_into("<8h", head, 40, 4, 17, 21, 13, 1, 1, 1, 1)  # four axes, the last of one
    with open(f"{tmp_path}/n.nii", "wb") as f:
        f.write(bytes(head) + volume.tobytes())
    assert vs.layout(f"file://{tmp_path}/n.nii").shape == volume.shape
    with open(f"{tmp_path}/short.npy", "wb") as f:
        f.write(vs._header(".npy", np.dtype("<f4"), volume.shape) + b"1234")
    with pytest.raises(ValueError, match="shorter"):
        vs.layout(f"file://{tmp_path}/short.npy")
    assert [p.rsplit("/", 1)[1] for p in vs.volume_paths(f"{tmp_path}/*b*.npy")] == ["big.npy"]
    assert len(vs.volume_paths(str(tmp_path))) == 6
    with pytest.raises(FileNotFoundError):
        vs.volume_paths(f"{tmp_path}/none*.npy")


def test_filters_decide_what_is_read(spark, tmp_path, volume):
    for k in range(3):
        np.save(f"{tmp_path}/{k}.npy", volume + k)
    every = vs.open_volumes(spark, f"{tmp_path}/*.npy", 4, partitionBytes="1")
    assert every.count() == 3 * 4 * 6 * 5 and every.rdd.getNumPartitions() == 3 * 4 * 6
    crop = every.where("bz >= 1 and bz < 3 and by = 2 and bx > 3").where(F.col("path").endswith("1.npy"))
    rows = crop.collect()
    assert {(r.bz, r.by, r.bx) for r in rows} == {(1, 2, 4), (2, 2, 4)} and rows[0].path.endswith("1.npy")
    assert every.where("bz = 2").rdd.getNumPartitions() == 3 * 6
    assert every.where(f"path = 'file://{tmp_path}/2.npy'").rdd.getNumPartitions() == 4 * 6
    assert every.where("bz = 9").count() == 0


def test_a_partition_holds_one_bar(tmp_path):
    with open(f"{tmp_path}/large.npy", "wb") as f:  # 8 GB, sparse
        head = vs._header(".npy", np.dtype("<f4"), (1024, 1024, 2048))
        f.write(head)
        f.truncate(len(head) + 4 * 1024 * 1024 * 2048)
    reader = vs.VolumeReader({"path": f"{tmp_path}/large.npy", "edge": "64"})
    parts = reader.partitions()
    assert len(parts) == 16 * 16 // 2 and all(p.last - p.first == 1 for p in parts)
    batch = next(reader.read(parts[77]))
    assert batch.num_rows == 32 and {(z, y) for z, y in zip(batch["bz"].to_pylist(), batch["by"].to_pylist())} == {divmod(parts[77].first, 16)}


def test_commit(spark, tmp_path, volume):
    rows = bricks_of(volume, 5)
    some, path = spark.createDataFrame(rows[1:], vs.BRICKS), f"{tmp_path}/v.npy"
    with pytest.raises(Exception, match="voxels came"):
        vs.save_volume(some, path, volume.shape, 5)
    assert os.listdir(tmp_path) == []
    vs.save_volume(some, path, volume.shape, 5, fill="nan")
    assert np.isnan(np.load(path)[:5, :5, :5]).all() and np.array_equal(np.load(path)[5:], volume[5:])
    with pytest.raises(Exception, match="exists"):
        vs.save_volume(some, path, volume.shape, 5, fill="nan")
    vs.save_volume(spark.createDataFrame(rows, vs.BRICKS), path, volume.shape, 5, overwrite=True)
    assert np.array_equal(np.load(path), volume)
    with pytest.raises(Exception, match="doesn't fit"):
        vs.save_volume(spark.createDataFrame(rows, vs.BRICKS), f"{tmp_path}/w.npy", (13, 21, 16), 5)
    assert os.listdir(tmp_path) == ["v.npy"]


# ---- windows of cut grids ----


def grid(rng, shape, cut):
    nodes = list(itertools.product(*(range(n) for n in shape)))
    ok = {(n, a): bool(n[a] + 1 < shape[a] and rng.random() > cut) for n in nodes for a in range(3)}
    return nodes, ok


def flooded(n, ok, direct):
    """Offsets that a node reaches, by search."""
    seen, todo = {(0, 0, 0)}, [(0, 0, 0)]
    while todo:
        d = todo.pop()
        p = tuple(a + b for a, b in zip(n, d))
        for a, s in itertools.product(range(3), (-1, 1)):
            e = tuple(d[k] + s * (k == a) for k in range(3))
            low = p if s == 1 else tuple(p[k] - (k == a) for k in range(3))
            if abs(e[a]) <= 1 and (not direct or d[a] == 0) and ok.get((low, a)) and e not in seen:
                seen.add(e)
                todo.append(e)
    return seen


@pytest.mark.parametrize("shape,cut", [((5, 4, 6), 0.35), ((6, 5, 1), 0.3), ((4, 4, 4), 0.0), ((3, 3, 3), 1.0), ((1, 1, 1), 0.0)])
def test_reachability_and_fits(spark, shape, cut):
    rng = np.random.default_rng(7)
    nodes, ok = grid(rng, shape, cut)
    f = {n: float(rng.normal()) if rng.random() > 0.05 else None for n in nodes}
    valid = {n: bool(rng.random() > 0.15) for n in nodes}
    rows = [(k, *n, f[n], valid[n], *(ok[n, a] for a in range(3))) for k, n in enumerate(nodes)]
    table = spark.createDataFrame(rows, "node_id long, ix long, iy long, iz long, f double, valid boolean, ok_ix boolean, ok_iy boolean, ok_iz boolean")
    held = reach.reachable(table)
    got = {r["node_id"]: r for r in reach.fluctuation(reach.plane_fit(held, "f", "valid", 2.0), "f").collect()}
    near = {n: [v for d in flooded(n, ok, True) - {(0, 0, 0)} if (v := f[tuple(a + b for a, b in zip(n, d))]) is not None] for n in nodes}
    off = {n: abs(f[n] - np.median(near[n])) if near[n] and f[n] is not None else None for n in nodes}
    for k, n in enumerate(nodes):
        reached = flooded(n, ok, False)
        assert got[k]["flood"] == sum(1 << (d[2] + 1) * 9 + (d[1] + 1) * 3 + d[0] + 1 for d in reached)
        used = [(d, f[p]) for d in reached if valid[p := tuple(a + b for a, b in zip(n, d))] and f[p] is not None]
        m = np.array([[1, *d] for d, _ in used], float).reshape(-1, 4)
        if valid[n] and f[n] is not None and len(used) >= 5:
            free = [a for a in range(3) if np.ptp(m[:, 1 + a])]
            if np.linalg.matrix_rank(m) == 1 + len(free):
                c = np.linalg.lstsq(m, np.array([v for _, v in used]), rcond=None)[0]
                assert np.allclose([got[k][f"d_i{a}"] for a in "xyz"], c[1:] / 2, atol=1e-9)
            else:
                assert got[k]["d_ix"] is None
        elif not valid[n] or len(used) < 5:
            assert got[k]["d_ix"] is None
        assert got[k]["complete"] == (valid[n] and len(used) == 27)
        theirs = [v for d in flooded(n, ok, True) - {(0, 0, 0)} if (v := off[tuple(a + b for a, b in zip(n, d))]) is not None]
        want = off[n] / (np.median(theirs) + 0.1) if len(near[n]) >= 6 and off[n] is not None and theirs else 0.0
        assert got[k]["fluctuation"] == pytest.approx(want, abs=1e-9)


def test_linear_fields_are_exact_across_any_cuts(spark):
    rng = np.random.default_rng(1)
    nodes, ok = grid(rng, (4, 5, 4), 0.2)
    rows = [(k, *n, 3.0 * n[0] - 2.0 * n[1] + 0.5 * n[2], True, *(ok[n, a] for a in range(3))) for k, n in enumerate(nodes)]
    table = spark.createDataFrame(rows, "node_id long, ix long, iy long, iz long, f double, valid boolean, ok_ix boolean, ok_iy boolean, ok_iz boolean")
    out = reach.plane_fit(reach.reachable(table), "f", "valid", 1.0).toPandas().dropna(subset=["d_ix"])
    flat = pd.DataFrame({"x": out["d_ix"] - 3, "y": out["d_iy"] + 2, "z": out["d_iz"] - 0.5}).abs()
    assert len(out) > 40 and ((flat < 1e-9) | (out[["d_ix", "d_iy", "d_iz"]].rename(columns={"d_ix": "x", "d_iy": "y", "d_iz": "z"}) == 0)).all().all()


def test_clamped_windows_repeat_the_border(spark):
    n = spark.createDataFrame([(x, y, 0, float(x + 10 * y)) for x in range(3) for y in range(2)], "ix long, iy long, iz long, f double")
    got = {(r.ix, r.iy): r.f_around for r in reach.around(n, ["f"], clamp=True).collect()}
    assert got[0, 0] == [0.0, 0, 1, 0, 0, 1, 10, 10, 11] * 3 and len(got[2, 1]) == 27
    assert {(r.ix, r.iy): r.f_around[:9] for r in reach.around(n, ["f"]).collect()}[0, 0] == [None] * 9
