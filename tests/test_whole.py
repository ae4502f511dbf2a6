"""Jobs over all rows, where a corner of them used to be taken."""

import duckdb
import numpy as np
import pytest

from voxlattice.catalog import ORACLES, QUERIES
from voxlattice.plans import nodes as pn
from voxlattice.plans import reports as pr


def test_nearest_fill_at_any_distance(spark):
    rng = np.random.default_rng(5)
    at = np.array([(x, y, z) for z in range(40) for y in range(4) for x in range(3)])
    ok = rng.random(len(at)) < 0.5
    ok[(at[:, 2] > 10) & (at[:, 2] < 39)] = False  # up to 14 layers from a value
    f = rng.random(len(at))
    rows = [(int(i), *map(int, p), bool(k), float(v)) for i, (p, k, v) in enumerate(zip(at, ok, f))]
    df = spark.createDataFrame(rows, "node_id long, ix long, iy long, iz long, node_valid boolean, f double")
    got = {r["node_id"]: r["src"] for r in pn._nearest_fill(df).collect()}
    have = np.flatnonzero(ok)
    want = {int(i): int(min(have, key=lambda j: (((at[i] - at[j]) ** 2).sum(), j))) for i in np.flatnonzero(~ok)}
    assert got == want
    assert pn._nearest_fill(df.where("not node_valid")).count() == 0


def test_nearest_fill_reads_all_layers(spark, sf):
    got = {r["node_id"]: r["src"] for r in QUERIES["join9_nearest_fill"](spark, sf).collect()}
    n = pn.lattice(spark, sf).select("node_id", "ix", "iy", "iz", "node_valid").toPandas().sort_values("node_id")
    at, ok, ids = n[["ix", "iy", "iz"]].to_numpy(), n["node_valid"].to_numpy(), n["node_id"].to_numpy()
    for i in np.flatnonzero(~ok):
        d = ((at[ok] - at[i]) ** 2).sum(1)
        assert got.pop(ids[i]) == ids[ok][np.flatnonzero(d == d.min())[0]]
    assert not got


@pytest.mark.parametrize("name", ["join9_nearest_fill", "agg14_autocorrelation_line", "agg14_autocorrelation", "agg16_sliding_window", "agg17_texture_of_boxes", "join8_coarse_to_fine"])
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("orders", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(map(tuple, QUERIES[name](spark, sf).collect())) == sorted(con.execute(ORACLES[name]).fetchall())


def test_windows_over_the_whole_volume(spark, sf):
    v = pr.voxels(spark, sf)
    p = v.toPandas()
    box = np.full((p["z"].max() + 1, 32, 32), np.nan)
    box[p["z"], p["y"], p["x"]] = p["v"]
    got = {tuple(r)[:4]: tuple(r)[4:] for r in QUERIES["agg16_sliding_window"](spark, sf).collect()}
    starts = [(x, y, z) for x in range(0, 13, 4) for y in range(0, 21, 4) for z in range(0, len(box) - 7, 4)]
    assert got.keys() == {(*s, h) for s in starts for h in range(7)}
    for x, y, z in starts:
        w = box[z : z + 8, y : y + 12, x : x + 12]
        mu, var = np.nanmean(w), np.nanvar(w)
        for h in range(7):
            c = (w - mu) * (box[z : z + 8, y : y + 12, x + h : x + h + 12] - mu)
            pairs, rho = got[x, y, z, h]
            assert pairs == (~np.isnan(c)).sum() and abs(rho - np.nanmean(c) / var) < 2e-6
