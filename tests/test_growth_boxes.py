"""Steps that go by boxes, cubes of bricks or blocks of nodes: same results, few groups, few rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_gaps_that_hang_together_take_few_rounds(spark, monkeypatch):
    from voxlattice.operators import graphs

    rng = np.random.default_rng(31)
    cells = [p for p in np.ndindex(3, 3, 60) if p[2] not in (50, 53)]
    known = {p: float(rng.normal()) for p in cells if rng.random() < 0.4 and p[2] not in (51, 52)}  # layers 51 and 52 know nothing
    at = {p: i for i, p in enumerate(cells)}
    a, b = np.eye(len(cells)), np.zeros(len(cells))
    for p, i in at.items():
        beside = [q for q in (tuple(np.add(p, s)) for s in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))) if q in at]
        if p in known:
            b[i] = known[p]
        else:
            a[i, i] = len(beside)
            a[i, [at[q] for q in beside]] = -1.0
    want = np.linalg.lstsq(a, b, rcond=None)[0]
    df = spark.createDataFrame([(i, *p, known.get(p)) for p, i in at.items()], "node_id long, ix int, iy int, iz int, v double")
    monkeypatch.setattr(graphs, "least_labels", None)  # rounds of joins over all gaps
    monkeypatch.setattr(graphs, "conjugate_gradient", None)  # a shuffled round a step
    got = {r["node"]: r["filled"] for r in graphs.harmonic_fill(df, "v").collect()}
    assert got.keys() == {i for p, i in at.items() if p not in known}
    assert all(got[i] is None if p[2] in (51, 52) else abs(got[i] - want[i]) < 1e-9 for p, i in at.items() if p not in known)


def test_gaps_that_reach_far_are_finished(spark, monkeypatch):
    from voxlattice.operators import graphs, schwarz

    df = spark.range(30).select(F.col("id").alias("node_id"), F.col("id").alias("ix"), F.lit(0).alias("iy"), F.lit(0).alias("iz"), F.when(F.col("id").isin(0, 29), 2.0 * F.col("id")).alias("v"), F.when(F.col("id").isin(0, 29), F.lit(1.0)).alias("w"))
    whole = schwarz.solve
    monkeypatch.setattr(schwarz, "solve", lambda *a: whole(*a, slow=0.0))  # finished by conjugate gradients
    got = {r["node"]: (r["v"], r["w"]) for r in graphs.harmonic_fills(df, ["v", "w"]).collect()}
    assert len(got) == 28 and all(abs(v - 2 * k) < 1e-9 and abs(w - 1) < 1e-9 for k, (v, w) in got.items())


def test_search_goes_by_cubes_of_bricks(spark, monkeypatch, tmp_path):
    from voxlattice.operators import pyramid

    f = np.random.default_rng(32).normal(size=(16, 16, 36))
    moved = np.roll(f, 2, axis=2)
    cut = lambda v, k: v[tuple(slice(4 * i, 4 * i + 4) for i in k)].ravel().tolist()
    bricks = list(np.ndindex(4, 4, 9))
    table = spark.createDataFrame([(*map(int, k), cut(f, k), cut(moved, k)) for k in bricks], "bz long, by long, bx long, ref array<double>, def array<double>")
    nodes = spark.createDataFrame([(i, *(4 * int(c) + 2 for c in k), 0, 0, 0) for i, k in enumerate(bricks)], "node_id long, z long, y long, x long, sz long, sy long, sx long")
    kept, log = pyramid._box, str(tmp_path / "boxes")

    def counted(*args):
        with open(log, "a") as out:
            out.write(".")
        return kept(*args)

    monkeypatch.setattr(pyramid, "_box", counted)
    got = {r["node_id"]: (r["tz"], r["ty"], r["tx"]) for r in pyramid.search(table, 4, nodes, 1, 2).where("zncc > 0.999").collect()}
    assert {i for i, t in got.items() if t == (0, 0, 2)} >= {i for i, k in enumerate(bricks) if 0 < k[2] < 8}
    assert len(open(log).read()) == 4  # two boxes for each of two cubes, where each of 144 bricks had its own


def test_peak_in_a_box_with_absent_voxels():
    from voxlattice.operators import pyramid

    rng = np.random.default_rng(33)
    a, g = rng.normal(size=(3, 3, 3)), np.full((12, 12, 12), np.nan)
    g[4:11, 5:12, 2:9] = rng.normal(size=(7, 7, 7))
    g[9, 9, 4] = np.nan
    windows = np.lib.stride_tricks.sliding_window_view(g, a.shape).reshape(1000, 27)
    d = windows - windows.mean(1, keepdims=True)
    score = d @ (a - a.mean()).ravel() / np.sqrt((d * d).sum(1) * ((a - a.mean()) ** 2).sum())
    found, value = pyramid.peak(a, g)
    assert found == np.unravel_index(np.nanargmax(score), (10, 10, 10)) and abs(value - np.nanmax(score)) < 1e-12
    g[:] = np.nan
    assert pyramid.peak(a, g)[0] is None
    g[4:6] = 1.0
    assert pyramid.peak(a, g)[0] is None  # thinner than the subset


def test_median_test_copies_no_node_to_its_neighbours(spark, sf, tmp_path):
    """A part layer and gaps: as the SQL says, and without a join of 26 copies a node."""
    import duckdb

    from voxlattice.catalog import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{sf}/orders.parquet' WHERE o_orderkey < 1237 AND o_orderkey % 7 <> 3 AND o_orderkey // 100 NOT BETWEEN 4 AND 6 OR o_orderkey = 555) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    out = QUERIES["win10_median_test"](spark, str(tmp_path))
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString() and "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    want = {r[0]: r[1:] for r in con.execute(f"SELECT node_id, residual, outlier FROM ({ORACLES['win10_median_test']})").fetchall()}
    got = {r["node_id"]: (r["residual"], r["outlier"]) for r in out.collect()}
    assert got == want and 555 not in got and any(v[0] is None for v in got.values())


def test_bodies_go_by_cubes_of_bricks(spark, monkeypatch):
    from voxlattice.operators import bodies

    rng = np.random.default_rng(34)
    rows = [(*map(int, k), (rng.random(64) < 0.5).astype(float).tolist()) for k in np.ndindex(20, 2, 2)]
    table = spark.createDataFrame(rows, "bz long, by long, bx long, mask array<double>")
    kept, rounds, edges = bodies.least_labels, [], []
    monkeypatch.setattr(bodies, "least_labels", lambda e, n: rounds.append(n.count()) or edges.append(e.count()) or kept(e, n))
    slices = bodies.clean_mask(table, 4, keep_largest=False, axes=(1, 2))
    assert slices.count() == 80 and rounds == [0]  # a slice lies in one cube, and no body has to be named for its holes
    assert bodies.clean_mask(table, 4).count() == 80
    assert edges[1] <= 2 * 2 * 64  # labels on either side of the two faces between three cubes of 8 layers


def test_largest_body_is_labelled_by_cubes(spark, sf, monkeypatch):
    import duckdb

    from voxlattice.catalog import ORACLES, QUERIES
    from voxlattice.operators import graphs

    monkeypatch.setattr(graphs, "grid_components", None)  # edges of all voxels
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = {tuple(r) for r in QUERIES["agg21_largest_body"](spark, sf).select("component", "size", "largest").collect()}
    assert got == set(con.execute(f"SELECT component, size, largest FROM ({ORACLES['agg21_largest_body']})").fetchall())


def test_slices_reach_python_as_plain_numbers(spark, sf, monkeypatch):
    from voxlattice.catalog import QUERIES
    from voxlattice.sources import volumes

    seen = []
    kept = volumes.stack_slices
    monkeypatch.setattr(volumes, "stack_slices", lambda slices, edge: seen.append(slices) or kept(slices, edge))
    assert QUERIES["src3_stack_slices"](spark, sf).count() == 1
    plan = seen[0]._jdf.queryExecution().analyzed().toString()
    child = seen[0]._jdf.queryExecution().analyzed().children().head()
    assert "MapInPandas" in plan and child.schema().apply("cells").dataType().simpleString() == "array<float>"


def test_coarse_to_fine_copies_no_node_to_its_corners(spark, sf, tmp_path):
    """Gaps in the lattice, also where coarse nodes end early: as the SQL says, each node in one group."""
    import duckdb

    from voxlattice.catalog import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{sf}/orders.parquet' WHERE o_orderkey % 17 <> 5 AND o_orderkey // 100 NOT IN (6, 12)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    out = QUERIES["join8_coarse_to_fine"](spark, str(tmp_path))
    assert "FlatMapCoGroupsInPandas" in out._jdf.queryExecution().executedPlan().toString()
    want = dict(con.execute(f"SELECT node_id, value FROM ({ORACLES['join8_coarse_to_fine']})").fetchall())
    assert {r["node_id"]: r["value"] for r in out.collect()} == want and len(want) > 1000


def test_a_chain_of_frames_follows_in_one_pass(spark, monkeypatch, tmp_path):
    from voxlattice.operators import store
    from voxlattice.streaming import frames

    written, kept = [], store.write
    monkeypatch.setattr(store, "write", lambda df: written.append(1) or kept(df))
    schedule = spark.createDataFrame([(f, f - 1) for f in range(1, 7)], "frame long, ref long")
    pairs = spark.createDataFrame([(f, n, 1.0) for f in range(1, 7) for n in (-3, 5, 1005) if (f, n) != (4, 5)], "frame long, node_id long, u double")
    frames.advance(pairs, schedule, f"{tmp_path}/a")
    got = {(r["frame"], r["node_id"]): r["u_total"] for r in spark.read.parquet(f"{tmp_path}/a/total").collect()}
    assert got == {(f, n): float(f) for f in range(1, 7) for n in (-3, 5, 1005) if n != 5 or f < 4}
    assert sorted(map(tuple, frames.waiting(spark, f"{tmp_path}/a").collect())) == [(5, 5, 1.0), (6, 5, 1.0)]
    assert len(written) == 1  # not a round of joins a frame
