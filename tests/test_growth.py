"""Steps that must not fail or slow down as the tables grow."""

import pytest
from pyspark.sql import functions as F

from voxlattice.plans import nodes as pn


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_corners_are_not_broadcast(spark):
    k = F.col("id")
    points = spark.range(50).select(k.alias("pid"), (k / 7).alias("gx"), (k % 3 / 2).alias("gy"), (k % 5 / 3).alias("gz"))
    nodes = spark.range(1000).select((k % 10).alias("ix"), (F.expr("id div 10") % 10).alias("iy"), F.expr("id div 100").alias("iz"), (2 * (k % 10)).cast("double").alias("f"))
    out = pn._corner_join(points, nodes, True)
    assert "BroadcastHashJoin" not in plan(out)
    assert {r["pid"]: round(r["s"], 9) for r in out.collect()} == {i: round(2 * i / 7, 9) for i in range(50)}


def test_box_sums_beside_places_without_a_node(spark):
    import itertools

    from voxlattice.operators import stencil

    cells = {p for p in itertools.product(range(7), range(6), range(5)) if not (p[2] >= 3 and p[1] >= 2) and p not in {(3, 1, 1), (4, 1, 1), (0, 5, 0)}} | {(15, 3, 2)}
    df = spark.createDataFrame([(*p, 1 + p[0] + 10 * p[1] + 100 * p[2]) for p in cells], "ix long, iy long, iz long, s long")
    got = {(r["ix"], r["iy"], r["iz"]): r["s"] for r in stencil.box_sums(df, ["s"], 2).collect()}
    assert got == {p: sum(1 + q[0] + 10 * q[1] + 100 * q[2] for q in cells if all(abs(a - b) <= 2 for a, b in zip(p, q))) for p in cells}


def test_valid_subsets_of_a_part_layer(spark, duck_part):
    from voxlattice.catalog import ORACLES, QUERIES

    folder, duck = duck_part
    got = {tuple(r) for r in QUERIES["prj18_valid_subsets"](spark, folder).select("x", "y", "z", "centre", "fraction", "valid").collect()}
    assert got == set(duck.execute(f"SELECT x, y, z, centre, fraction, valid FROM ({ORACLES['prj18_valid_subsets']})").fetchall())


@pytest.fixture
def duck_part(sf, tmp_path):
    """Volumes whose last layer is only begun."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{sf}/embeddings.parquet' WHERE vec_id < 2 * 64 + 16 + 3) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    return str(tmp_path), con


def test_spline_taps_stay_small(spark):
    from voxlattice.operators import spline

    df = spark.range(3).select(spline.taps(F.col("id").cast("double"), F.lit(0), F.col("id") + 5).alias("t"))
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 50_000
    assert [round(sum(t["w"] for t in r["t"]), 9) for r in df.collect()] == [1.0, 1.0, 1.0]


def test_search_broadcasts_no_bricks(spark):
    from voxlattice.operators import pyramid

    bricks = spark.range(8).selectExpr("id div 4 bz", "id div 2 % 2 by", "id % 2 bx", "transform(sequence(0, 63), i -> double((i * 7 + id) % 11)) ref").selectExpr("*", "ref AS def")
    nodes = spark.range(1).selectExpr("id node_id", "4L z", "4L y", "4L x", "0L sz", "0L sy", "0L sx")
    out = pyramid.search(bricks, 4, nodes, 1, 1)
    assert "BroadcastHashJoin" not in plan(out)
    assert [tuple(r)[1:4] for r in out.collect()] == [(0, 0, 0)]


def test_samples_over_many_batches(spark):
    from voxlattice.operators import batch

    rows = spark.range(3000).selectExpr("CASE WHEN id < 2000 THEN id % 7 WHEN id < 2990 THEN id END AS sample_id", "id AS v")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        results, jobs = batch.run_batch(rows, lambda f, _: {"sample_id": [f["sample_id"].iloc[0]], "n": [len(f)], "s": [int(f["v"].sum())]}, "sample_id long, n long, s long")
        got = {r[0]: r[1:] for r in results.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {i: (len(range(i, 2000, 7)), sum(range(i, 2000, 7))) for i in range(7)} | {i: (1, i) for i in range(2000, 2990)} | {None: (10, sum(range(2990, 3000)))}
    assert got == want and jobs.where("state = 'done'").count() == len(want)


def test_state_is_kept_by_blocks(spark, tmp_path):
    from voxlattice.streaming import frames

    rows = [(f, n, float(n % 13 + f)) for n in [0, 1, 999, 1000, 2500, -3] for f in (1, 2, 3) if (n, f) != (999, 1)] + [(1, None, 4.0)]
    for k in range(3):  # late frames first
        spark.createDataFrame(sorted(rows, key=lambda r: -r[0])[k::3], "frame long, node_id long, u double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("frame long, node_id long, u double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    schedule = spark.createDataFrame([(f, f - 1) for f in (1, 2, 3)], "frame long, ref long")
    assert frames.BLOCK == 1000
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        frames.totals(stream, schedule).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    finally:
        spark.conf.unset(name)
    got = sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("node_id", "frame", "u_total").collect()), key=repr)
    want = [(n, f, float(sum(n % 13 + g for g in range(1, f + 1)))) for n in [0, 1, 1000, 2500, -3] for f in (1, 2, 3)] + [(None, 1, 4.0)]
    assert got == sorted(want, key=repr)


def test_cells_give_what_corners_give(spark):
    nodes = spark.sql("SELECT id % 5 AS ix, id div 5 % 4 AS iy, id div 20 AS iz, double(id * id % 17) AS f FROM range(80) WHERE id % 11 <> 3")
    points = spark.range(400).selectExpr("id AS pid", "id % 23 / 4.0D - 0.5 AS gx", "id % 19 / 5.0D AS gy", "CASE WHEN id % 50 > 0 THEN id % 17 / 4.0D END AS gz")
    got = {r["pid"]: (r["s"], r["cover"]) for r in pn._sample(points, pn._cells(nodes)).collect()}
    want = {r["pid"]: (r["s"], r["cover"]) for r in pn._corner_join(points, nodes, True).collect()}
    few = {r["pid"]: (r["s"], r["cover"]) for r in pn._corner_join(points, nodes, False).collect()}
    near = lambda a, b: all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(a, b))
    assert len(got) == len(want) == 400 and 100 < len(few) < 400
    assert all(near(got[i], want[i]) and near(want[i], few.get(i, (None, None))) for i in got)
    assert got[0] == got[50] == (None, None)


@pytest.mark.parametrize("name, joins", [("join7_trilinear_or_null", 1), ("trj1_line_by_distance", 1), ("trj1_line_samples", 1), ("trj3_cumulative_chain", 3)])
def test_points_are_neither_copied_nor_joined_back(spark, sf, name, joins):
    from voxlattice.catalog import QUERIES

    found = plan(QUERIES[name](spark, sf))
    assert found.count("SortMergeJoin") == joins and "BroadcastHashJoin" not in found


def test_median_windows_with_gaps(spark, sf, tmp_path):
    import duckdb

    from voxlattice.catalog import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{sf}/orders.parquet' WHERE o_orderkey < 437 AND o_orderkey % 13 <> 5 AND o_orderkey NOT BETWEEN 200 AND 214) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    name = "win10_median_vector"
    out = QUERIES[name](spark, str(tmp_path))
    assert "SortMergeJoin" not in plan(out)  # windows carry values to their neighbours; nothing is joined by place
    assert sorted(map(tuple, out.collect())) == sorted(con.execute(ORACLES[name]).fetchall())


def _smoothing(spark):
    """Nodes of a long grid with gaps and unknown values, and the smoothed field of a dense solve."""
    import numpy as np

    rng = np.random.default_rng(21)
    cells = [p for p in np.ndindex(3, 3, 40) if rng.random() < 0.8]
    value = {p: float(rng.normal()) if rng.random() < 0.8 else None for p in cells}
    at = {p: i for i, p in enumerate(cells)}
    a, b = np.zeros((len(cells),) * 2), np.zeros(len(cells))
    for p, i in at.items():
        beside = [at[q] for q in (tuple(np.add(p, s)) for s in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))) if q in at]
        a[i, i] = (value[p] is not None) + 2.0 * len(beside)
        a[i, beside] = -2.0
        b[i] = value[p] or 0.0
    df = spark.createDataFrame([(0, i, *p, value[p]) for p, i in at.items()], "frame int, node_id long, ix int, iy int, iz int, v double")
    return df, np.linalg.lstsq(a, b, rcond=None)[0]


@pytest.mark.parametrize("size, overlap, rounds", [(10, 9, 8), (64, 16, 2), (64, 16, None)])
def test_smoothing_takes_few_rounds(spark, monkeypatch, size, overlap, rounds):
    from voxlattice.operators import schwarz, solve

    df, want = _smoothing(spark)
    made = []
    kept = schwarz.boxed
    monkeypatch.setattr(schwarz, "boxed", lambda *a: made.append(1) or kept(*a))
    if rounds:
        monkeypatch.setattr(solve, "conjugate_gradient", None)  # a shuffled round a step
    else:
        whole = schwarz.solve
        monkeypatch.setattr(schwarz, "solve", lambda *a: whole(*a, slow=0.0))  # finished by conjugate gradients
    got = solve.compatible_field(df, "v", 2.0, "frame", size=size, overlap=overlap).collect()
    assert len(got) == len(want) and all(abs(r["smooth"] - want[r["node_id"]]) < 1e-7 and r["residual"] <= 1e-10 for r in got)
    assert not rounds or len(made) <= rounds


def test_global_step_takes_few_rounds(spark, monkeypatch):
    import numpy as np

    from voxlattice.operators import elements, schwarz

    rng = np.random.default_rng(22)
    cells = [p for p in np.ndindex(3, 3, 30) if rng.random() < 0.97]
    names = [*(f"u{i}" for i in (1, 2, 3)), *(f"f{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))]
    rows = [(0, k, *map(int, p), *map(float, rng.normal(size=12))) for k, p in enumerate(cells)]
    df = spark.createDataFrame(rows, "frame int, node_id long, ix int, iy int, iz int, " + ", ".join(f"{n} double" for n in names))
    monkeypatch.setattr(elements, "conjugate_gradient", None)  # a shuffled round a step
    one, two = (sorted(map(tuple, elements.global_step(df, (8.0, 8.0, 8.0), 4.0, 1.0, 0.5, "frame", size=s, overlap=9).collect())) for s in (64, 10))
    assert len(one) == len(cells) and any(r[-1] is None for r in one) and any(r[-1] is not None for r in one)
    for a, b in zip(one, two):
        assert a[:2] == b[:2] and (a[-1] is None) == (b[-1] is None) and np.allclose(a[2:5], b[2:5], atol=1e-7)


def test_near_correlations_need_no_transform(spark, monkeypatch):
    import numpy as np

    from voxlattice.operators import solve

    rng = np.random.default_rng(23)
    rows = [(k, *map(int, p), float(v)) for k in (0, 1) for p, v in zip(np.ndindex(5, 4, 90), rng.normal(size=1800)) if v < 1.3]
    df = spark.createDataFrame(rows, "key int, ix int, iy int, iz int, u double")
    run = lambda: {r["key"]: tuple(r)[1:] for r in solve.mean_confidence(df, "u", "key").collect()}
    monkeypatch.setattr(solve, "NEAR_LAGS", ())
    want = run()
    monkeypatch.undo()
    monkeypatch.setattr(solve, "transform", None)
    got = run()
    assert got.keys() == want.keys() == {0, 1} and all(np.allclose(got[k], want[k], rtol=1e-9) for k in got)


def test_bricks_go_to_few_groups(spark):
    import numpy as np
    import pandas as pd

    from voxlattice.operators import blocks

    v = np.arange(8 * 12 * 44, dtype=float).reshape(8, 12, 44)
    there = [k for k in np.ndindex(2, 3, 11) if k != (1, 1, 4)]
    block = lambda k: tuple(slice(4 * i, 4 * i + 4) for i in k)
    df = spark.createDataFrame([(*map(int, k), v[block(k)].ravel().tolist()) for k in there], "bz long, by long, bx long, data array<double>")
    v[block((1, 1, 4))] = np.nan
    grown = np.pad(v, 7, constant_values=np.nan)
    want = {k: [float(np.nansum(b)), int(np.isnan(b).sum())] for k in there for b in [grown[tuple(slice(4 * i, 4 * i + 18) for i in k)]]}
    work = lambda key, boxes: pd.DataFrame([(*key, float(np.nansum(boxes["data"])), int(np.isnan(boxes["data"]).sum()))], columns=["bz", "by", "bx", "s", "n"])
    out = blocks.map_blocks(df, 4, 7, work, "bz long, by long, bx long, s double, n long")
    assert {tuple(r)[:3]: list(r)[3:] for r in out.collect()} == want
    assert "Join" not in plan(out)  # 125 copies a brick were joined with the bricks
