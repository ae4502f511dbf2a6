"""Further modes of the operators: whole filters, flags, schedules, vector tests, volumes in three axes, rules and batches."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import reach, stencil, store
from ..sources.views import lattice, measurements, table, voxels
from .nodes import REGIONS, _CORNER_SQL, _REGION_SQL, _cells, _corner_join, _sample
from .registry import R, query, r6

AXES = stencil.AXES


# ---- node filter and series ----

_SLAB = _REGION_SQL["slab"]


def node_filter(nodes, meas, region, layers: int = 1, min_zncc: float = 0.93):
    """Every candidate node of every frame with the first reason that drops it, or null.

    Incremental frames compose all pairs before them: a node is dropped if any pair of its chain is bad. A pair without
    the node counts as not converged, a missing correlation as low. Edge layers are counted in the valid part of the region.
    """
    n = stencil.erode(nodes.withColumn("inside", region).withColumn("body", F.col("node_valid") & F.col("inside")), "body", layers)
    frames = meas.agg(F.collect_set("frame").alias("frames"))
    grid = n.where("inside").crossJoin(F.broadcast(frames)).select("node_id", "node_valid", "core", F.explode("frames").alias("frame"))
    pairs = grid.join(meas, ["node_id", "frame"], "left")
    chain = Window.partitionBy("node_id").orderBy("frame")
    ever = lambda bad: F.max(bad.cast("int")).over(chain) == 1
    late = F.coalesce(F.col("status") != 0, F.lit(True))
    low = ~F.coalesce(F.col("zncc") >= min_zncc, F.lit(False))
    cut = F.coalesce(F.col("w") > 0.7, F.lit(False))
    flags = pairs.select("*", ever(late).alias("late"), ever(F.coalesce("outlier", F.lit(False))).alias("odd"), ever(low).alias("low"), ever(cut).alias("was_cut"))
    reason = F.when(~F.col("node_valid"), "invalid").when(F.col("late"), "not_converged").when(F.col("odd"), "outlier").when(F.col("low"), "low_zncc").when(~F.col("core"), "edge").when(F.col("was_cut"), "cut")
    return flags.withColumn("reason", reason)


_FILTER_SQL = f"""n AS (SELECT *, ({_SLAB}) AS inside FROM lat),
c AS (SELECT a.node_id, a.node_valid, (SELECT count(*) FROM n b WHERE b.ix BETWEEN a.ix - 1 AND a.ix + 1 AND b.iy BETWEEN a.iy - 1 AND a.iy + 1 AND b.iz BETWEEN a.iz - 1 AND a.iz + 1 AND b.inside AND b.node_valid) = 27 AS core FROM n a WHERE a.inside),
p AS (SELECT c.*, f.frame, m.u, coalesce(m.status <> 0, true) AS late, coalesce(m.outlier, false) AS odd, NOT coalesce(m.zncc >= 0.93, false) AS low, coalesce(m.w > 0.7, false) AS was_cut
 FROM c CROSS JOIN (SELECT DISTINCT frame FROM meas) f LEFT JOIN meas m ON m.node_id = c.node_id AND m.frame = f.frame),
g AS (SELECT node_id, frame, u, node_valid, core, bool_or(late) OVER w AS late, bool_or(odd) OVER w AS odd, bool_or(low) OVER w AS low, bool_or(was_cut) OVER w AS was_cut FROM p WINDOW w AS (PARTITION BY node_id ORDER BY frame)),
r AS (SELECT *, CASE WHEN NOT node_valid THEN 'invalid' WHEN late THEN 'not_converged' WHEN odd THEN 'outlier' WHEN low THEN 'low_zncc' WHEN NOT core THEN 'edge' WHEN was_cut THEN 'cut' END AS reason FROM g)"""
_REASONS = ("invalid", "not_converged", "outlier", "low_zncc", "edge", "cut")


@query(f"WITH {_FILTER_SQL} SELECT frame, count(*) AS candidates, " + ", ".join(f"count(*) FILTER (reason = '{x}') AS {x}" for x in _REASONS) + f", count(*) FILTER (reason IS NULL) AS kept, {R('count(*) FILTER (reason IS NULL) / count(*)')} AS valid_fraction FROM r GROUP BY frame")
def prj6_node_filter(spark, sf):
    """Nodes of a region dropped by each reason in order, edge layers and cut subsets too, over chains of incremental pairs."""
    s = node_filter(lattice(spark, sf), measurements(spark, sf), REGIONS["slab"].contains())
    count = lambda c: F.count(F.when(c, 1))
    kept = count(F.col("reason").isNull())
    return s.groupBy("frame").agg(F.count("*").alias("candidates"), *[count(F.col("reason") == x).alias(x) for x in _REASONS], kept.alias("kept"), r6(kept / F.count("*")).alias("valid_fraction"))


_HITS_SQL = " UNION ALL ".join(f"SELECT '{k}' AS region, node_id, x, node_valid FROM lat WHERE {v}" for k, v in {**_REGION_SQL, "all": "true", "corner": "x < 21 AND y < 25 AND z < 45"}.items())


@query(f"""WITH h AS ({_HITS_SQL}), j AS (SELECT h.region, f.frame, h.x, m.u, m.v, h.node_valid AND m.status = 0 AND NOT m.outlier AS used FROM h CROSS JOIN (SELECT DISTINCT frame FROM meas) f LEFT JOIN meas m ON m.node_id = h.node_id AND m.frame = f.frame),
a AS (SELECT region, frame, count(*) AS candidates, count(*) FILTER (used) AS nodes_used, regr_slope(u, x) FILTER (used) AS s, regr_intercept(u, x) FILTER (used) AS o, avg(u) FILTER (used) AS mean, stddev_pop(u) FILTER (used) AS std, regr_syy(u, x) FILTER (used) AS syy, regr_sxy(u, x) FILTER (used) AS sxy FROM j GROUP BY region, frame)
SELECT region, frame, candidates, nodes_used, {R('nodes_used / candidates')} AS valid_fraction, CASE WHEN nodes_used < 4 THEN 'no_fit' WHEN nodes_used < 0.3 * candidates THEN 'few_nodes' ELSE 'ok' END AS flag,
 CASE WHEN nodes_used >= 4 THEN {R('mean')} END AS mean, CASE WHEN nodes_used >= 4 THEN {R('std')} END AS std, CASE WHEN nodes_used >= 4 AND s IS NOT NULL THEN {R('sqrt(greatest(syy - s * sxy, 0) / nodes_used)')} END AS std_detrended FROM a""")
def agg6_series_flags(spark, sf):
    """A series for every region with what it rests on: nodes used of the candidates, whether a fit was possible, and the
    spread before and after a linear trend is taken out."""
    shapes = {**{k: r.contains() for k, r in REGIONS.items()}, "corner": (F.col("x") < 21) & (F.col("y") < 25) & (F.col("z") < 45)}
    hits = F.explode(F.array_append(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in shapes.items()])), F.lit("all"))).alias("region")
    m = measurements(spark, sf)
    n = lattice(spark, sf).select("node_id", "x", "node_valid", hits)
    frames = m.agg(F.collect_set("frame").alias("frames"))
    sizes = n.groupBy("region").agg(F.count("*").alias("candidates")).crossJoin(F.broadcast(frames)).select("region", "candidates", F.explode("frames").alias("frame"))
    good = n.where("node_valid").join(m.where("status = 0 and not outlier"), "node_id")
    a = good.groupBy("region", "frame").agg(F.count("*").alias("k"), F.avg("u").alias("mean"), F.stddev_pop("u").alias("std"), F.covar_pop("u", "x").alias("cov"), F.var_pop("x").alias("vx"))
    a = sizes.join(a, ["region", "frame"], "left").withColumn("nodes_used", F.coalesce("k", F.lit(0)))
    flag = F.when(F.col("nodes_used") < 4, "no_fit").when(F.col("nodes_used") < 0.3 * F.col("candidates"), "few_nodes").otherwise("ok")
    enough = F.col("nodes_used") >= 4
    left = F.when(enough & (F.col("vx") > 0), r6(F.sqrt(F.greatest(F.col("std") * F.col("std") - F.col("cov") * F.col("cov") / F.col("vx"), F.lit(0.0)))))
    return a.select("region", "frame", "candidates", "nodes_used", r6(F.col("nodes_used") / F.col("candidates")).alias("valid_fraction"), flag.alias("flag"), F.when(enough, r6("mean")).alias("mean"), F.when(enough, r6("std")).alias("std"), left.alias("std_detrended"))


# ---- grids: interpolation, fits, smoothing, gradients, outliers ----


@query(f"""WITH s AS (SELECT max(iz) AS mz FROM lat), pts AS (SELECT p_partkey AS pid, least(greatest((p_partkey % 37) / 2.5 - 2, 0), 9) AS gx, least(greatest((p_partkey % 29) / 2.2 - 1.5, 0), 9) AS gy, least(greatest((p_partkey % 41) * 0.9 - 3, 0), mz) AS gz FROM part, s), {_CORNER_SQL}
SELECT pid, {R('sum(w * f)')} AS value FROM cor JOIN lat USING (ix, iy, iz) WHERE w > 0 GROUP BY pid""")
def join6_nearest_outside(spark, sf):
    """Linear interpolation at any point: outside the grid the nearest edge's value holds."""
    n = lattice(spark, sf).select("ix", "iy", "iz", "f")
    k = F.col("p_partkey")
    p = table(spark, sf, "part").crossJoin(F.broadcast(n.agg(F.max("iz").alias("mz"))))
    held = lambda g, hi: F.least(F.greatest(g, F.lit(0.0)), hi)
    p = p.select(k.alias("pid"), held((k % 37) / 2.5 - 2, F.lit(9.0)).alias("gx"), held((k % 29) / 2.2 - 1.5, F.lit(9.0)).alias("gy"), held((k % 41) * 0.9 - 3, F.col("mz").cast("double")).alias("gz"))
    return _corner_join(p, n, False).select("pid", r6("s").alias("value"))


_MOMENTS = [("w", "1.0"), *((f"s{a}", f"i{a}") for a in "xyz"), *((f"s{a}{b}", f"i{a} * i{b}") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz"))]


@query(f"""WITH n AS (SELECT * FROM lat WHERE node_valid), m AS (SELECT a.node_id, count(*) AS k, var_pop(b.ix) AS xx, var_pop(b.iy) AS yy, var_pop(b.iz) AS zz, covar_pop(b.ix, b.iy) AS xy, covar_pop(b.ix, b.iz) AS xz, covar_pop(b.iy, b.iz) AS yz, covar_pop(b.f, b.ix) AS fx, covar_pop(b.f, b.iy) AS fy, covar_pop(b.f, b.iz) AS fz
 FROM n a JOIN n b ON b.ix BETWEEN a.ix - 1 AND a.ix + 1 AND b.iy BETWEEN a.iy - 1 AND a.iy + 1 AND b.iz BETWEEN a.iz - 1 AND a.iz + 1 GROUP BY a.node_id),
d AS (SELECT *, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS det FROM m)
SELECT node_id, k AS used, k = 27 AS complete, CASE WHEN k >= 5 AND det > 1e-6 THEN {R('(fx * (yy * zz - yz * yz) - xy * (fy * zz - yz * fz) + xz * (fy * yz - yy * fz)) / det / 8')} END AS d_ix,
 CASE WHEN k >= 5 AND det > 1e-6 THEN {R('(xx * (fy * zz - yz * fz) - fx * (xy * zz - yz * xz) + xz * (xy * fz - fy * xz)) / det / 8')} END AS d_iy,
 CASE WHEN k >= 5 AND det > 1e-6 THEN {R('(xx * (yy * fz - fy * yz) - xy * (xy * fz - fy * xz) + fx * (xy * yz - yy * xz)) / det / 8')} END AS d_iz FROM d""")
def win7_plane_fit_gaps(spark, sf):
    """Plane-fit gradient from the valid nodes of a 3x3x3 window, five at least; null where they lie in a plane.

    The window's moments are box sums, one grid axis after the other, so no node is copied 27 times.
    """
    n = lattice(spark, sf)
    there = F.col("node_valid")
    parts = {name: F.when(there, F.expr(e).cast("double")).otherwise(0.0) for name, e in _MOMENTS}
    parts |= {"sf": F.when(there, F.col("f")).otherwise(0.0), **{f"sf{a}": F.when(there, F.col("f") * F.col(f"i{a}")).otherwise(0.0) for a in "xyz"}}
    m = stencil.box_sums(n.withColumns(parts), list(parts), 1).where("node_valid")
    k = F.col("w")
    cov = lambda p, a, b: F.col(p) / k - F.col(a) * F.col(b) / (k * k)
    c = {"xx": cov("sxx", "sx", "sx"), "yy": cov("syy", "sy", "sy"), "zz": cov("szz", "sz", "sz"), "xy": cov("sxy", "sx", "sy"), "xz": cov("sxz", "sx", "sz"), "yz": cov("syz", "sy", "sz"), **{f"f{a}": cov(f"sf{a}", "sf", f"s{a}") for a in "xyz"}}
    m = m.select("node_id", k.cast("long").alias("used"), (k == 27).alias("complete"), *[v.alias(n_) for n_, v in c.items()])
    rows = [["xx", "xy", "xz"], ["xy", "yy", "yz"], ["xz", "yz", "zz"]]

    def det(t):
        (a, b, c_), (d, e, f), (g, h, i) = [[F.col(x) for x in r] for r in t]
        return a * (e * i - f * h) - b * (d * i - f * g) + c_ * (d * h - e * g)

    whole = det(rows)
    solved = lambda j: det([[("fx", "fy", "fz")[r] if q == j else rows[r][q] for q in range(3)] for r in range(3)])
    ok = (F.col("used") >= 5) & (whole > 1e-6)
    return m.select("node_id", "used", "complete", *[F.when(ok, r6(solved(j) / whole / 8)).alias(f"d_{a}") for j, a in enumerate(AXES)])


_SIGMA, _REACH = 0.5, 2
_WEIGHTS = {k: math.exp(-k * k / (2 * _SIGMA * _SIGMA)) for k in range(-_REACH, _REACH + 1)}


@query(f"""WITH t(k, g) AS (VALUES {', '.join(f'({k}, CAST({g!r} AS DOUBLE))' for k, g in _WEIGHTS.items())}), s AS (SELECT max(iz) AS mz FROM lat),
p AS (SELECT a.node_id, a.node_valid, p.g * q.g * r.g AS g, least(greatest(a.ix + p.k, 0), 9) AS ix, least(greatest(a.iy + q.k, 0), 9) AS iy, least(greatest(a.iz + r.k, 0), mz) AS iz FROM lat a, s, t p, t q, t r)
SELECT p.node_id, CASE WHEN any_value(p.node_valid) THEN {R('sum(g * f) FILTER (b.node_valid) / sum(g) FILTER (b.node_valid)')} END AS smooth FROM p JOIN lat b USING (ix, iy, iz) GROUP BY p.node_id""")
def win8_smoothing_3d(spark, sf):
    """Normalised Gaussian smoothing in three axes: missing nodes give and get nothing, edges repeat the nearest node."""
    n = lattice(spark, sf)
    n = n.withColumns({"a": F.when(F.col("node_valid"), F.col("f")).otherwise(0.0), "b": F.col("node_valid").cast("double")})
    for axis in AXES:
        for c in ("a", "b"):
            n = n.withColumn(c, stencil.weighted(c, axis, _WEIGHTS))
    return n.select("node_id", F.when(F.col("node_valid") & (F.col("b") > 1e-12), r6(F.col("a") / F.col("b"))).alias("smooth"))


_SEVEN = "(p1 - m1) * 0.75 - (p2 - m2) * 0.15 + (p3 - m3) / 60"
_LAGS_SQL = "lead(v, 1) OVER w AS p1, lag(v, 1) OVER w AS m1, lead(v, 2) OVER w AS p2, lag(v, 2) OVER w AS m2, lead(v, 3) OVER w AS p3, lag(v, 3) OVER w AS m3"


@query(f"""WITH s AS (SELECT max(z) - 3 AS tz, max(y) - 3 AS ty, max(x) - 3 AS tx FROM vox),
gx AS (SELECT z, y, x, {_SEVEN} AS gx FROM (SELECT z, y, x, {_LAGS_SQL} FROM vox WINDOW w AS (PARTITION BY z, y ORDER BY x))),
gy AS (SELECT z, y, x, {_SEVEN} AS gy FROM (SELECT z, y, x, {_LAGS_SQL} FROM vox WINDOW w AS (PARTITION BY z, x ORDER BY y))),
gz AS (SELECT z, y, x, {_SEVEN} AS gz FROM (SELECT z, y, x, {_LAGS_SQL} FROM vox WINDOW w AS (PARTITION BY y, x ORDER BY z)))
SELECT z, y, x, CASE WHEN inside THEN {R('gx')} ELSE 0 END AS gx, CASE WHEN inside THEN {R('gy')} ELSE 0 END AS gy, CASE WHEN inside THEN {R('gz')} ELSE 0 END AS gz
FROM (SELECT gx.z, gx.y, gx.x, gx, gy, gz, gx.z BETWEEN 3 AND tz AND gx.y BETWEEN 3 AND ty AND gx.x BETWEEN 3 AND tx AS inside FROM gx JOIN gy USING (z, y, x) JOIN gz USING (z, y, x), s)""")
def win9_volume_gradient_3d(spark, sf):
    """Seven-point derivatives along all axes, zero within three voxels of any border."""
    v = voxels(spark, sf)
    top = v.agg(*[(F.max(a) - 3).alias(f"t{a}") for a in "zyx"])
    for a in "xyz":
        w = Window.partitionBy(*[c for c in "zyx" if c != a]).orderBy(a)
        at = lambda k: F.max("v").over(w.rangeBetween(k, k))  # noqa: B023, E731
        v = v.withColumn(f"g{a}", sum(((at(k) - at(-k)) * c for k, c in ((1, 0.75), (2, -0.15), (3, 1 / 60))), F.lit(0.0)))
    inside = F.lit(True)
    for a in "zyx":
        inside = inside & F.col(a).between(F.lit(3), F.col(f"t{a}"))
    v = v.crossJoin(F.broadcast(top))
    return v.select("z", "y", "x", *[F.when(inside, r6(f"g{a}")).otherwise(0.0).alias(f"g{a}") for a in "xyz"])


_SIDE_SQL = "((a.ix < 5) = (b.ix < 5))"
_NEAR_SQL = "b.ix BETWEEN a.ix - 1 AND a.ix + 1 AND b.iy BETWEEN a.iy - 1 AND a.iy + 1 AND b.iz BETWEEN a.iz - 1 AND a.iz + 1 AND b.node_id <> a.node_id"


@query(f"""WITH n AS (SELECT node_id, ix, iy, iz, c, CASE c WHEN 'u' THEN f WHEN 'v' THEN f * f ELSE 1 / f END AS v FROM lat, (VALUES ('u'), ('v'), ('w')) t(c) WHERE node_valid),
m AS (SELECT a.node_id, a.c, any_value(a.ix) AS ix, any_value(a.iy) AS iy, any_value(a.iz) AS iz, count(*) AS k, abs(any_value(a.v) - quantile_cont(b.v, 0.5)) AS d FROM n a JOIN n b ON a.c = b.c AND {_NEAR_SQL} AND {_SIDE_SQL} GROUP BY a.node_id, a.c),
r AS (SELECT a.node_id, a.c, any_value(a.k) AS k, any_value(a.d) / (quantile_cont(b.d, 0.5) + 0.1) AS q FROM m a LEFT JOIN m b ON a.c = b.c AND {_NEAR_SQL} AND {_SIDE_SQL} GROUP BY a.node_id, a.c),
s AS (SELECT node_id, sqrt(sum(CASE WHEN k >= 6 AND q IS NOT NULL THEN q * q ELSE 0 END)) AS size FROM r GROUP BY node_id)
SELECT node_id, {R('coalesce(size, 0)')} AS fluctuation, coalesce(size, 0) > 3 AS outlier FROM lat LEFT JOIN s USING (node_id) WHERE node_valid""")
def win10_median_vector(spark, sf):
    """Median test of three components on a mesh cut between ix 4 and 5: neighbours on the node's own side, invalid ones left
    out, six at least; a neighbour's fluctuation is about its own median."""
    n = lattice(spark, sf)
    f = F.when(F.col("node_valid"), F.col("f"))
    n = n.select("node_id", *AXES, "node_valid", f.alias("u"), (f * f).alias("v"), (1 / f).alias("w"))
    cells = lambda test: F.lit(reach.cells(lambda *d: any(d) and test(d[0])))
    side = F.when(F.col("ix") == 4, cells(lambda dx: dx < 1)).when(F.col("ix") == 5, cells(lambda dx: dx > -1)).otherwise(cells(lambda dx: True))
    near = lambda c: reach.within(F.col(f"{c}_around"), side)
    parts = ("u", "v", "w")
    n = reach.around(n, list(parts), gaps=True).select("node_id", *AXES, "node_valid", *[F.size(F.array_compact(near(c))).alias(f"k{c}") for c in parts], *[F.abs(F.col(c) - reach.median(near(c))).alias(f"d{c}") for c in parts])
    n = reach.around(n, [f"d{c}" for c in parts], gaps=True).where("node_valid")
    n = n.select("node_id", *[F.when(F.col(f"k{c}") >= 6, F.col(f"d{c}") / (reach.median(near(f"d{c}")) + 0.1)).alias(f"q{c}") for c in parts])
    size = F.sqrt(sum((F.coalesce(F.col(f"q{c}") * F.col(f"q{c}"), F.lit(0.0)) for c in parts), F.lit(0.0)))
    return n.select("node_id", r6(size).alias("fluctuation"), (size > 3).alias("outlier"))


# ---- parameters, schedules, batches ----

#: A sample's parameters as SQL over the part table; the expressions read alike in both engines.
_PARAMETERS = {
    "winsize_x": "2 + p_size", "winsize_y": "4 + p_size % 9", "winsize_z": "8", "step_x": "p_partkey % 7", "step_y": "4", "step_z": "2 + p_size % 5", "voxel_x": "CASE WHEN p_size % 10 = 7 THEN CAST('Infinity' AS DOUBLE) ELSE CAST((p_size - 1) / 4.0 AS DOUBLE) END", "voxel_y": "1.0", "voxel_z": "p_partkey % 50 / 10.0",
    "prefilter_sigma": "(p_partkey % 13 - 1) / 2.0", "search_x": "p_partkey % 11 - 1", "search_y": "8", "search_z": "p_size - 2", "init_subset": "p_size + 2", "init_guess": "CASE p_partkey % 5 WHEN 0 THEN 'pyramid' WHEN 1 THEN 'ncc' WHEN 2 THEN 'zero' WHEN 3 THEN 'previous' ELSE 'best' END",
    "pyramid_levels": "p_partkey % 6 - 1", "ncc_max_expand": "p_size % 7 - 1", "init_outlier": "p_partkey % 4 - 0.5", "local_outlier": "2.0", "icgn_tol": "p_partkey % 9 / 8.0", "icgn_dp_tol": "p_size / 40.0", "icgn_patience": "p_partkey % 17 - 1", "icgn_max_iter": "p_partkey % 19", "fine_radius": "p_size % 4",
    "coarse_factor": "p_partkey % 10", "stride": "p_size % 6", "interp": "CASE p_size % 4 WHEN 0 THEN 'cubic' WHEN 1 THEN 'bspline' WHEN 2 THEN 'linear' ELSE 'nearest' END", "min_valid": "p_partkey % 12 / 10.0", "cond_max": "p_partkey % 23", "mu": "(p_partkey % 21 - 1) / 1000.0", "beta": "CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size - 10.0 END",
    "beta_least": "p_partkey % 25 / 100.0", "beta_criterion": "CASE p_partkey % 3 WHEN 0 THEN 'matlab' WHEN 1 THEN 'normalized' ELSE 'other' END", "admm_max_iter": "p_size % 5", "admm_tol": "p_partkey % 27 / 100.0", "subpb2": "CASE p_size % 3 WHEN 0 THEN 'fem' WHEN 1 THEN 'fd' ELSE 'none' END", "gauss_order": "1 + p_partkey % 4",
    "dual_update": "CASE p_size % 2 WHEN 0 THEN 'accumulate' ELSE 'reset' END", "global_solver": "CASE p_partkey % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'pcg' WHEN 2 THEN 'direct' ELSE 'lu' END", "pcg_tol": "p_partkey % 29 / 1e8", "pcg_max_iter": "p_size % 8", "alpha": "(p_partkey % 31 - 1) / 3.0", "disp_smoothing": "(p_size % 9 - 1) / 2.0", "strain_smoothing": "0.5",
    "strain_method": "CASE p_partkey % 6 WHEN 0 THEN 'plane_fit' WHEN 1 THEN 'fem' WHEN 2 THEN 'fd' WHEN 3 THEN 'direct' ELSE 'spline' END", "halfwidth": "p_size % 3", "strain_type": "CASE p_size % 5 WHEN 0 THEN 'infinitesimal' WHEN 1 THEN 'green_lagrange' WHEN 2 THEN 'euler_almansi' WHEN 3 THEN 'hencky' ELSE 'log' END",
    "reference_mode": "CASE p_partkey % 3 WHEN 0 THEN 'accumulative' WHEN 1 THEN 'incremental' ELSE 'mixed' END", "cumulative_interp": "CASE p_size % 3 WHEN 0 THEN 'linear' WHEN 1 THEN 'cubic' ELSE 'quintic' END", "backend": "CASE p_partkey % 5 WHEN 0 THEN 'auto' WHEN 1 THEN 'numba' WHEN 2 THEN 'numpy' WHEN 3 THEN 'cuda' ELSE 'gpu' END",
    "gradient_mode": "CASE p_size % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'stored' WHEN 2 THEN 'on_the_fly' ELSE 'never' END", "n_threads": "p_partkey % 33 - 1", "tile_local": "p_size - 3", "disp_margin": "p_partkey % 35 - 1", "strain_margin": "p_size / 40.0",
}
#: What breaks each rule. Fixed values (names of choices and limits).
RULES = {
    "winsize_x": "winsize_x < 4 OR winsize_x % 2 <> 0", "winsize_y": "winsize_y < 4 OR winsize_y % 2 <> 0", "winsize_z": "winsize_z < 4 OR winsize_z % 2 <> 0", "step_x": "step_x < 1", "step_y": "step_y < 1", "step_z": "step_z < 1",
    **{f"voxel_{a}": f"NOT (voxel_{a} > 0 AND voxel_{a} < CAST('Infinity' AS DOUBLE))" for a in "xyz"}, "prefilter_sigma": "prefilter_sigma < 0", "search_radius": "search_x < 0 OR search_y < 0 OR search_z < 0",
    "init_subset": "init_subset < 4 OR init_subset % 2 <> 0", "init_guess_method": "init_guess NOT IN ('pyramid', 'ncc', 'zero', 'previous')", "pyramid_levels": "pyramid_levels < 0", "ncc_max_expand": "ncc_max_expand < 0", "outlier_threshold": "init_outlier < 0 OR local_outlier < 0", "icgn_tol": "NOT (icgn_tol > 0 AND icgn_tol < 1)",
    "icgn_dp_tol": "NOT (icgn_dp_tol > 0 AND icgn_dp_tol < 1)", "icgn_patience": "icgn_patience < 0", "icgn_max_iter": "icgn_max_iter < 1", "pyramid_fine_radius": "fine_radius < 1", "init_coarse_factor": "coarse_factor NOT BETWEEN 1 AND 8", "subset_stride": "stride < 1",
    "stride_samples": "stride > greatest(1, floor(least(winsize_x, winsize_y, winsize_z) / 4))", "interp_method": "interp NOT IN ('cubic', 'bspline', 'linear')", "min_valid_ratio": "NOT (min_valid > 0 AND min_valid <= 1)", "hessian_cond_max": "cond_max <= 1", "mu": "mu <= 0", "beta": "coalesce(beta <= 0, false)", "beta_range": "beta_least <= 0",
    "beta_criterion": "beta_criterion NOT IN ('matlab', 'normalized')", "admm_max_iter": "admm_max_iter < 1", "admm_tol": "admm_tol <= 0", "subpb2_method": "subpb2 NOT IN ('fem', 'fd')", "gauss_pt_order": "gauss_order NOT IN (2, 3)", "dual_update": "dual_update NOT IN ('accumulate', 'reset')", "global_solver": "global_solver NOT IN ('auto', 'pcg', 'direct')",
    "pcg": "pcg_tol <= 0 OR pcg_max_iter < 1", "alpha": "alpha < 0", "smoothing": "disp_smoothing < 0 OR strain_smoothing < 0", "strain_method": "strain_method NOT IN ('plane_fit', 'fem', 'fd', 'direct')", "strain_halfwidth": "halfwidth < 1", "strain_type": "strain_type NOT IN ('infinitesimal', 'green_lagrange', 'euler_almansi', 'hencky')",
    "reference_mode": "reference_mode NOT IN ('accumulative', 'incremental')", "cumulative_interp": "cumulative_interp NOT IN ('linear', 'cubic')", "backend": "backend NOT IN ('auto', 'numba', 'numpy', 'cuda')", "gradient_mode": "gradient_mode NOT IN ('auto', 'stored', 'on_the_fly')", "on_the_fly": "gradient_mode = 'on_the_fly' AND backend = 'numpy'",
    "n_threads": "n_threads < 0", "tile_local": "tile_local < 0", "tile_disp_margin": "disp_margin < 0", "tile_strain_margin": "strain_margin NOT BETWEEN 0.0 AND 1.0",
}
#: What is allowed but named: subsets that don't overlap leave the global step weakly tied.
WARNINGS = {"overlap": "step_x > winsize_x OR step_y > winsize_y OR step_z > winsize_z"}
_PAR_SQL = "par AS (SELECT p_partkey AS sample_id, " + ", ".join(f"{e} AS {n}" for n, e in _PARAMETERS.items()) + " FROM part)"
_BROKEN_SQL = "concat_ws(',', " + ", ".join(f"CASE WHEN {e} THEN '{n}' END" for n, e in RULES.items()) + ")"


def violations(parameters):
    """The names of the rules that a row's parameters break, in the rules' order."""
    return parameters.withColumn("violations", F.concat_ws(",", *[F.when(F.expr(e), F.lit(n)) for n, e in RULES.items()]))


def _parameters(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("sample_id"), *[F.expr(e).alias(n) for n, e in _PARAMETERS.items()])


@query(f"WITH {_PAR_SQL} SELECT sample_id, {_BROKEN_SQL} AS violations, CASE WHEN {WARNINGS['overlap']} THEN 'overlap' ELSE '' END AS warnings FROM par")
def prj11_all_rules(spark, sf):
    """Every rule of a parameter set as a column; samples name all the rules that they break, and what they are warned of."""
    said = F.concat_ws(",", *[F.when(F.expr(e), F.lit(n)) for n, e in WARNINGS.items()])
    return violations(_parameters(spark, sf)).select("sample_id", "violations", said.alias("warnings"))


_SERIOUS = ("icgn_max_iter", "gauss_pt_order", "backend", "interp_method")


@query(f"""WITH {_PAR_SQL}, v AS (SELECT sample_id, {_BROKEN_SQL} AS violations FROM par), m AS (SELECT l_partkey AS sample_id, count(*) AS nodes, count(*) FILTER (l_returnflag = 'R') AS bad FROM lineitem GROUP BY l_partkey),
j AS (SELECT v.sample_id, violations, coalesce(nodes, 0) AS nodes, coalesce(bad, 0) AS bad FROM v LEFT JOIN m USING (sample_id))
SELECT sample_id, nodes, CASE WHEN {' OR '.join(f"list_contains(string_split(violations, ','), '{x}')" for x in _SERIOUS)} THEN 'rejected' WHEN nodes = 0 THEN 'failed' WHEN bad * 2 > nodes THEN 'partial' ELSE 'done' END AS state,
 CASE WHEN {' OR '.join(f"list_contains(string_split(violations, ','), '{x}')" for x in _SERIOUS)} THEN violations WHEN nodes = 0 THEN 'no nodes' WHEN bad * 2 > nodes THEN bad || ' of ' || nodes || ' nodes' END AS reason FROM j""")
def snk8_batch_states(spark, sf):
    """A batch of samples as one job: those with bad parameters or without data are recorded with the reason, the rest go on."""
    v = violations(_parameters(spark, sf)).select("sample_id", "violations")
    m = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("sample_id")).agg(F.count("*").alias("nodes"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("bad"))
    j = v.join(m, "sample_id", "left").select("sample_id", "violations", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("bad", F.lit(0)).alias("bad"))
    rejected = F.arrays_overlap(F.split("violations", ","), F.array(*map(F.lit, _SERIOUS)))
    partial = F.col("bad") * 2 > F.col("nodes")
    state = F.when(rejected, "rejected").when(F.col("nodes") == 0, "failed").when(partial, "partial").otherwise("done")
    reason = F.when(rejected, F.col("violations")).when(F.col("nodes") == 0, "no nodes").when(partial, F.concat(F.col("bad").cast("string"), F.lit(" of "), F.col("nodes").cast("string"), F.lit(" nodes")))
    return j.select("sample_id", "nodes", state.alias("state"), reason.alias("reason"))


@query("""WITH f AS (SELECT DISTINCT p_size AS frame FROM part WHERE p_size > 0), m AS (SELECT frame, 'accumulative' AS mode, 0 AS ref FROM f UNION ALL SELECT frame, 'incremental', frame - 1 FROM f UNION ALL SELECT frame, 'every_5', (frame - 1) // 5 * 5 FROM f UNION ALL SELECT frame, 'custom', (frame * 7) % 12 - 1 FROM f)
SELECT mode, CAST(frame AS BIGINT) AS frame, CAST(ref AS BIGINT) AS ref, CASE WHEN ref < 0 THEN 'negative' WHEN ref >= frame THEN 'future' END AS problem FROM m""")
def join1_schedules(spark, sf):
    """Reference frames by mode, and what is wrong with a custom one: no frame may refer to a later one."""
    f = table(spark, sf, "part").where("p_size > 0").select(F.col("p_size").cast("long").alias("frame")).distinct()
    modes = {"accumulative": F.lit(0), "incremental": F.col("frame") - 1, "every_5": F.floor((F.col("frame") - 1) / 5) * 5, "custom": (F.col("frame") * 7) % 12 - 1}
    m = f.select("frame", F.explode(F.array(*[F.struct(F.lit(k).alias("mode"), v.cast("long").alias("ref")) for k, v in modes.items()])).alias("m")).select("m.mode", "frame", "m.ref")
    return m.withColumn("problem", F.when(F.col("ref") < 0, "negative").when(F.col("ref") >= F.col("frame"), "future"))


@query("""WITH s AS (SELECT c_custkey AS sample_id, CASE c_custkey % 3 WHEN 0 THEN 'resume' WHEN 1 THEN 'restart' ELSE 'auto' END AS mode, c_custkey % 5 <> 0 AS exists, md5(c_mktsegment || (CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE '' END)) = md5(c_mktsegment) AS same FROM customer)
SELECT sample_id, mode, CASE WHEN NOT exists THEN 'create' WHEN mode = 'restart' THEN 'replace' WHEN same THEN 'continue' WHEN mode = 'auto' THEN 'replace' ELSE 'refuse' END AS action FROM s""")
def snk7_checkpoint_modes(spark, sf):
    """What happens to a sample's checkpoint: fingerprints that differ stop a resume, and are replaced where that is allowed."""
    k = F.col("c_custkey")
    mode = F.when(k % 3 == 0, "resume").when(k % 3 == 1, "restart").otherwise("auto")
    wanted = F.concat(F.col("c_mktsegment"), F.when(k % 4 == 0, "x").otherwise(""))
    same = F.md5(wanted) == F.md5("c_mktsegment")
    action = F.when(k % 5 == 0, "create").when(mode == "restart", "replace").when(same, "continue").when(mode == "auto", "replace").otherwise("refuse")
    return table(spark, sf, "customer").select(k.alias("sample_id"), mode.alias("mode"), action.alias("action"))


# ---- exports, positions, cumulative chains ----


@query(f"""WITH j AS (SELECT m.frame, m.u, l.node_id, l.ix, l.iy, l.iz, l.x, l.y, l.z FROM meas m JOIN lat l USING (node_id) WHERE l.node_valid AND m.status = 0), h AS ({_HITS_SQL}),
t AS (SELECT 'series' AS part, 'all' AS key, frame, u FROM j UNION ALL SELECT 'region_series', region, frame, u FROM j JOIN h USING (node_id) UNION ALL SELECT 'profile_x', CAST(ix AS VARCHAR), frame, u FROM j UNION ALL SELECT 'profile_y', CAST(iy AS VARCHAR), frame, u FROM j UNION ALL SELECT 'line', CAST(ix AS VARCHAR), frame, u FROM j WHERE iy = 4 AND iz = 3)
SELECT part, key, frame + 1 AS frame, count(*) AS n, {R('avg(u)')} AS mean, {R('stddev_pop(u)')} AS std, {R('min(u)')} AS min, {R('max(u)')} AS max FROM t GROUP BY part, key, frame""")
def snk3_statistics_tables(spark, sf):
    """The statistics files in one pass: the series, that of every region, profiles along axes and a line of nodes."""
    shapes = {**{k: r.contains() for k, r in REGIONS.items()}, "corner": (F.col("x") < 21) & (F.col("y") < 25) & (F.col("z") < 45)}
    entry = lambda part, key: F.struct(F.lit(part).alias("part"), key.cast("string").alias("key"))
    parts = [entry("series", F.lit("all")), entry("region_series", F.lit("all")), entry("profile_x", F.col("ix")), entry("profile_y", F.col("iy")), F.when((F.col("iy") == 4) & (F.col("iz") == 3), entry("line", F.col("ix"))), *[F.when(c, entry("region_series", F.lit(k))) for k, c in shapes.items()]]
    n = lattice(spark, sf).where("node_valid").select("node_id", F.explode(F.array_compact(F.array(*parts))).alias("e"))
    j = measurements(spark, sf).where("status = 0").select("node_id", "frame", "u").join(n, "node_id")
    return j.groupBy("e.part", "e.key", (F.col("frame") + 1).alias("frame")).agg(F.count("*").alias("n"), r6(F.avg("u")).alias("mean"), r6(F.stddev_pop("u")).alias("std"), r6(F.min("u")).alias("min"), r6(F.max("u")).alias("max"))


@query("""WITH t AS (SELECT p_partkey AS box_id, k * 8 AS lo, md5('17/' || p_partkey || '/' || (k * 8)) AS r FROM part, range(10) u(k) WHERE k * 8 + 8 <= p_size + 10), n AS (SELECT *, row_number() OVER (PARTITION BY box_id ORDER BY r, lo) AS place FROM t)
SELECT box_id, CAST(lo AS BIGINT) AS lo, CAST(place AS BIGINT) AS place FROM n WHERE place <= 3""")
def top2_random_positions(spark, sf):
    """Three positions of each box drawn at random: a seed gives the same ones whatever the order of rows (the draw is the feature)."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("box_id"), (F.col("p_size") + 10).alias("edge"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("k"))
    t = p.where("k * 8 + 8 <= edge").select("box_id", (F.col("k") * 8).alias("lo"))
    draw = F.md5(F.concat(F.lit("17/"), F.col("box_id").cast("string"), F.lit("/"), F.col("lo").cast("string")))
    place = F.row_number().over(Window.partitionBy("box_id").orderBy(draw, "lo")).cast("long")
    return t.withColumn("place", place).where("place <= 3")


_PAIRS = ((0.30, -0.20, 0.25), (-0.15, 0.35, 0.10), (0.20, 0.10, -0.30))


def _chain_sql() -> str:
    steps = ["s0 AS (SELECT node_id, CAST(ix AS DOUBLE) AS px, CAST(iy AS DOUBLE) AS py, CAST(iz AS DOUBLE) AS pz FROM lat)"]
    for k, (a, b, c) in enumerate(_PAIRS):
        steps.append(f"h{k} AS (SELECT node_id, px, py, pz, least(greatest(px, 0), 9) AS gx, least(greatest(py, 0), 9) AS gy, least(greatest(pz, 0), mz) AS gz FROM s{k}, (SELECT max(iz) AS mz FROM lat))")
        w = " * ".join(f"(CASE WHEN {d} = 1 THEN g{x} - floor(g{x}) ELSE 1 - (g{x} - floor(g{x})) END)" for d, x in zip(("p", "q", "r"), "xyz"))
        steps.append(f"c{k} AS (SELECT node_id, floor(gx) + p AS ix, floor(gy) + q AS iy, floor(gz) + r AS iz, {w} AS w FROM h{k}, range(2) a(p), range(2) b(q), range(2) c(r))")
        steps.append(f"d{k} AS (SELECT c.node_id, sum(c.w * l.f) AS f FROM c{k} c JOIN lat l USING (ix, iy, iz) WHERE c.w > 0 GROUP BY c.node_id)")
        steps.append(f"s{k + 1} AS (SELECT s.node_id, px + {a} * f AS px, py + {b} * f AS py, pz + {c} * f AS pz FROM s{k} s JOIN d{k} USING (node_id))")
    last = f"s{len(_PAIRS)}"
    return f"WITH {', '.join(steps)} SELECT {last}.node_id, {R('(px - ix) * 8')} AS u, {R('(py - iy) * 8')} AS v, {R('(pz - iz) * 8')} AS w FROM {last} JOIN lat USING (node_id)"


@query(_chain_sql())
def trj3_cumulative_chain(spark, sf):
    """Three pairs composed in three axes: each pair's field is read where the pairs before have moved every node; outside
    the grid the nearest edge holds."""
    n = lattice(spark, sf).select("node_id", *AXES, "f")
    top = F.broadcast(n.agg(F.max("iz").cast("double").alias("mz")))
    s = n.select("node_id", *AXES, *[F.col(f"i{a}").cast("double").alias(f"p{a}") for a in "xyz"]).crossJoin(top)
    cells = store.write(_cells(n))
    held = lambda a, hi: F.least(F.greatest(F.col(f"p{a}"), F.lit(0.0)), hi)
    for pair in _PAIRS:
        s = _sample(s, cells, held("x", F.lit(9.0)), held("y", F.lit(9.0)), held("z", F.col("mz"))).where("cover is not null")
        s = s.select("node_id", *AXES, "mz", *[(F.col(f"p{a}") + c * F.col("s")).alias(f"p{a}") for a, c in zip("xyz", pair)])
    return s.select("node_id", *[r6((F.col(f"p{a}") - F.col(f"i{a}")) * 8).alias(c) for a, c in zip("xyz", "uvw")])


@query(f"SELECT z, y, count(*) AS n, {R('sum(v * x)')} AS weighed, {R('min(v)')} AS min, {R('max(v)')} AS max FROM vox GROUP BY z, y")
def src6_slice_lines(spark, sf):
    """Bricks put together into slices line by line, each an array in x order with nulls where a brick is absent, as a
    volume file holds them; a line is the largest thing that a row holds."""
    v = voxels(spark, sf)
    width = v.agg(F.max("x").alias("mx"))
    lines = v.groupBy("z", "y").agg(F.map_from_entries(F.collect_list(F.struct("x", "v"))).alias("at")).crossJoin(F.broadcast(width))
    s = lines.select("z", "y", F.transform(F.sequence(F.lit(0).cast("long"), F.col("mx")), lambda x: F.try_element_at("at", x)).alias("data"))
    weighed = F.aggregate(F.transform("data", lambda c, i: F.coalesce(c * i, F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
    return s.select("z", "y", F.size(F.array_compact("data")).cast("long").alias("n"), r6(weighed).alias("weighed"), r6(F.array_min("data")).alias("min"), r6(F.array_max("data")).alias("max"))
