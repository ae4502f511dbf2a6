"""Queries over nodes: sources, projections, filters, joins and set operations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..operators import graphs, store
from ..operators import regions as rg
from ..operators import stencil
from ..sources.views import lattice, measurements, table, voxels
from .registry import R, query, r6

# ---- sources and sinks ----


@query("""WITH p AS (SELECT p_brand AS sample, 'scan_' || p_size || '_' || p_partkey || '.npy' AS path, p_size, p_partkey FROM part)
SELECT sample, path, CAST(row_number() OVER (PARTITION BY sample ORDER BY p_size, p_partkey) - 1 AS BIGINT) AS frame FROM p""")
def src1_natural_order(spark, sf):
    """Frames of each sample from file names in digit-aware order."""
    p = table(spark, sf, "part").select(F.col("p_brand").alias("sample"), F.concat(F.lit("scan_"), "p_size", F.lit("_"), "p_partkey", F.lit(".npy")).alias("path"))
    key = F.transform(F.regexp_extract_all("path", F.lit(r"(\d+|\D+)"), F.lit(1)), lambda t: F.when(t.rlike(r"^\d"), F.lpad(t, 20, "0")).otherwise(t))
    return p.select("sample", "path", (F.row_number().over(Window.partitionBy("sample").orderBy(key)) - 1).cast("long").alias("frame"))


@query("""WITH s AS (SELECT p_brand AS sample, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS BIGINT) AS frame,
 CAST(p_size % 3 AS BIGINT) AS nz, CAST(p_partkey % 2 AS BIGINT) AS ny FROM part)
SELECT a.sample, a.frame, a.nz, a.ny, b.nz AS ref_nz, b.ny AS ref_ny FROM s a JOIN s b ON a.sample = b.sample AND b.frame = 0 WHERE a.nz <> b.nz OR a.ny <> b.ny""")
def src4_shape_check(spark, sf):
    """Every scan whose shape is not that of its sample's first."""
    frame = (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).cast("long")
    s = table(spark, sf, "part").select(F.col("p_brand").alias("sample"), frame.alias("frame"), (F.col("p_size") % 3).cast("long").alias("nz"), (F.col("p_partkey") % 2).cast("long").alias("ny"))
    ref = s.where("frame = 0").select("sample", F.col("nz").alias("ref_nz"), F.col("ny").alias("ref_ny"))
    return s.join(ref, "sample").where("nz <> ref_nz or ny <> ref_ny")


@query(f"SELECT count(*) AS n, {R('min(v)')} AS min, {R('max(v)')} AS max, {R('avg(v)')} AS mean, {R('stddev_pop(v)')} AS std, count(*) * 4 AS bytes FROM vox")
def src5_volume_summary(spark, sf):
    v = voxels(spark, sf)
    return v.agg(F.count("*").alias("n"), r6(F.min("v")).alias("min"), r6(F.max("v")).alias("max"), r6(F.avg("v")).alias("mean"), r6(F.stddev_pop("v")).alias("std"), (F.count("*") * 4).alias("bytes"))


@query(f"""WITH s AS (SELECT avg(v) AS mu, CASE WHEN stddev_pop(v) < 1e-12 THEN 1 ELSE stddev_pop(v) END AS sd FROM vox), n AS (SELECT vec_id, (v - mu) / sd AS value, m FROM vox, s)
SELECT vec_id, count(*) AS voxels, {R('min(value)')} AS least, {R('max(value)')} AS greatest, {R('avg(value)')} AS mean, count(*) FILTER (m) AS inside FROM n GROUP BY vec_id""")
def src7_normalised_frame(spark, sf):
    """A frame with mean 0 and deviation 1 and its mask, summed up by brick."""
    v = voxels(spark, sf)
    s = v.agg(F.avg("v").alias("mean"), F.when(F.stddev_pop("v") < 1e-12, 1.0).otherwise(F.stddev_pop("v")).alias("sd"))
    n = v.crossJoin(F.broadcast(s)).select("vec_id", ((F.col("v") - F.col("mean")) / F.col("sd")).alias("value"), "m")
    return n.groupBy("vec_id").agg(F.count("*").alias("voxels"), r6(F.min("value")).alias("least"), r6(F.max("value")).alias("greatest"), r6(F.avg("value")).alias("mean"), F.count_if("m").alias("inside"))


@query(f"""SELECT m.frame + 1 AS frame, l.x, l.y, l.z, l.node_valid AS valid, CASE WHEN l.node_valid THEN {R('m.u')} END AS disp_u, CASE WHEN l.node_valid THEN {R('m.v')} END AS disp_v
FROM lat l JOIN meas m USING (node_id)""")
def snk1_node_rows(spark, sf):
    """What the per-frame CSV holds: one-based frames, empty cells at invalid nodes."""
    j = lattice(spark, sf).join(measurements(spark, sf), "node_id")
    return j.select((F.col("frame") + 1).alias("frame"), "x", "y", "z", F.col("node_valid").alias("valid"), F.when(F.col("node_valid"), r6("u")).alias("disp_u"), F.when(F.col("node_valid"), r6("v")).alias("disp_v"))


@query(f"SELECT frame, count(*) AS n_nodes, {R('quantile_cont(zncc, 0.5)')} AS median_zncc, {R('avg(CASE WHEN status = 0 THEN 1.0 ELSE 0.0 END)')} AS converged_share FROM meas GROUP BY frame")
def snk2_run_summary(spark, sf):
    m = measurements(spark, sf)
    return m.groupBy("frame").agg(F.count("*").alias("n_nodes"), r6(F.percentile("zncc", F.lit(0.5))).alias("median_zncc"), r6(F.avg(F.when(F.col("status") == 0, 1.0).otherwise(0.0))).alias("converged_share"))


_GRADIENT = ("f11", "f21", "f31", "f12", "f22", "f32", "f13", "f23", "f33")


@query(f"SELECT node_id, frame, " + ", ".join(f"{R(c)} AS {n}" for n, c in zip(_GRADIENT, ("u", "v", "w", "v - w", "u", "u", "zncc", "zncc", "v"))) + ", true AS same_back FROM meas")
def snk6_column_major(spark, sf):
    """A row-major gradient rewritten in column-major order, and back again."""
    row_major = F.array("u", F.col("v") - F.col("w"), "zncc", "v", "u", "zncc", "w", "u", "v")
    turned = lambda g: F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.get(g, (i % 3) * 3 + F.floor(i / 3).cast("int")))
    m = measurements(spark, sf).withColumn("g", turned(row_major)).withColumn("back", turned(F.col("g")))
    return m.select("node_id", "frame", *[r6(F.get("g", F.lit(k))).alias(n) for k, n in enumerate(_GRADIENT)], (F.col("back") == row_major).alias("same_back"))


@query("""WITH a AS (SELECT CAST(p_partkey AS VARCHAR) AS k, p_name AS v FROM part WHERE p_partkey % 7 <> 0),
b AS (SELECT CAST(p_partkey AS VARCHAR) AS k, CASE WHEN p_size % 5 = 0 THEN p_type ELSE p_name END AS v FROM part WHERE p_partkey % 11 <> 0)
SELECT coalesce(a.k, b.k) AS key, a.v AS stored, b.v AS wanted FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def snk7_fingerprint_diff(spark, sf):
    """Parameters that differ between a checkpoint and the run that wants to resume it."""
    p = table(spark, sf, "part")
    a = p.where("p_partkey % 7 <> 0").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("stored"))
    b = p.where("p_partkey % 11 <> 0").select(F.col("p_partkey").cast("string").alias("key"), F.when(F.col("p_size") % 5 == 0, F.col("p_type")).otherwise(F.col("p_name")).alias("wanted"))
    return a.join(b, "key", "full").where(~F.col("stored").eqNullSafe(F.col("wanted")))


@query("""SELECT l.node_id, f.frame FROM lat l, (SELECT DISTINCT frame FROM meas) f WHERE NOT EXISTS (SELECT 1 FROM meas m WHERE m.node_id = l.node_id AND m.frame = f.frame)""")
def snk7_frames_to_do(spark, sf):
    """Cells of the schedule without a stored result."""
    m = measurements(spark, sf)
    frames = m.agg(F.collect_set("frame").alias("frames"))  # one row
    every = lattice(spark, sf).select("node_id").crossJoin(F.broadcast(frames)).select("node_id", F.explode("frames").alias("frame"))
    return every.join(m, ["node_id", "frame"], "left_anti")


@query(f"""SELECT c_custkey AS sample_id, {R('coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END, d.shared)')} AS winsize FROM customer
JOIN (SELECT c_nationkey, avg(c_acctbal) AS shared FROM customer GROUP BY c_nationkey) d USING (c_nationkey)""")
def snk8_parameter_overlay(spark, sf):
    """A sample's own parameter where it has one, else the shared one."""
    c = table(spark, sf, "customer")
    shared = c.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("shared"))
    return c.join(shared, "c_nationkey").select(F.col("c_custkey").alias("sample_id"), r6(F.coalesce(F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")), "shared")).alias("winsize"))


# ---- projections and filters ----

_VOI = ((4, 25), (2, -1), (0, 12))


@query("""WITH s AS (SELECT max(x) AS mx, max(y) AS my, max(z) AS mz FROM vox)
SELECT vec_id, x, y, z FROM vox, s WHERE x BETWEEN 4 AND least(25, mx) AND y BETWEEN 2 AND my AND z BETWEEN 0 AND least(12, mz)""")
def prj1_crop(spark, sf):
    """Voxels of inclusive ranges clamped to the volume; -1 is the end."""
    v = voxels(spark, sf)
    s = v.agg(*[F.max(a).alias(f"m{a}") for a in "xyz"])
    inside = F.lit(True)
    for a, (lo, hi) in zip("xyz", _VOI):
        inside = inside & F.col(a).between(F.lit(max(lo, 0)), F.col(f"m{a}") if hi < 0 else F.least(F.lit(hi), F.col(f"m{a}")))
    return v.crossJoin(F.broadcast(s)).where(inside).select("vec_id", "x", "y", "z")


@query("""WITH a AS (SELECT min(x) FILTER (m) - 19 AS x0, max(x) FILTER (m) + 19 AS x1, min(z) FILTER (m) - 19 AS z0, max(z) FILTER (m) + 19 AS z1, max(x) AS mx, max(z) AS mz FROM vox)
SELECT greatest(x0, 0) AS x0, least(x1, mx) AS x1, greatest(z0, 0) AS z0, least(z1, mz) AS z1 FROM a""")
def prj2_voi_from_mask(spark, sf):
    """Bounding box of the mask, grown by half a subset, the search radius and a margin, and clamped."""
    grow = 16 // 2 + 5 + 6
    inside = lambda a: F.when(F.col("m"), F.col(a))
    a = voxels(spark, sf).agg(*[e for c in "xz" for e in ((F.min(inside(c)) - grow).alias(f"{c}0"), (F.max(inside(c)) + grow).alias(f"{c}1"), F.max(c).alias(f"m{c}"))])
    return a.select(*[e for c in "xz" for e in (F.greatest(F.col(f"{c}0"), F.lit(0)).alias(f"{c}0"), F.least(F.col(f"{c}1"), F.col(f"m{c}")).alias(f"{c}1"))])


@query("""WITH b AS (SELECT p_partkey AS box_id, least(p_size, p_partkey % 50) AS a, greatest(p_size, p_partkey % 50) AS c FROM part), k AS (SELECT box_id, least(greatest(a, 0), 31) AS lo, least(greatest(c, a + 1), 32) AS hi FROM b)
SELECT box_id, CAST(lo AS BIGINT) AS lo, CAST(greatest(hi, lo + 1) AS BIGINT) AS hi, CAST(greatest(hi, lo + 1) - lo AS BIGINT) AS size, CAST((greatest(hi, lo + 1) + lo) / 2.0 AS DOUBLE) AS centre FROM k""")
def prj3_box_algebra(spark, sf):
    """Half-open intervals ordered, clipped to 32 voxels and never empty; their size and centre."""
    p = table(spark, sf, "part")
    a, c = F.least("p_size", F.col("p_partkey") % 50), F.greatest("p_size", F.col("p_partkey") % 50)
    k = p.select(F.col("p_partkey").alias("box_id"), F.least(F.greatest(a, F.lit(0)), F.lit(31)).alias("lo"), F.least(F.greatest(c, a + 1), F.lit(32)).alias("h"))
    k = k.withColumn("hi", F.greatest(F.col("h"), F.col("lo") + 1))
    return k.select("box_id", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), (F.col("hi") - F.col("lo")).cast("long").alias("size"), ((F.col("hi") + F.col("lo")) / 2).alias("centre"))


REGIONS = {
    "box": rg.Box((30, 30, 100), (70, 90, 700)),
    "sphere": rg.Sphere((60, 60, 400), 150),
    "cylinder": rg.Cylinder("z", (56, 60, 0), 25, 60, 900),
    "slab": rg.Slab("x", 36, 68),
    "rect": rg.Prism("xy", "rect", ((28, 32), (60, 80)), 60, 800),
    "ellipse": rg.Prism("xz", "ellipse", ((20, 100), (90, 900)), 30, 90),
    "triangle": rg.Prism("xy", "polygon", ((21.0, 25.5), (90.3, 33.7), (44.1, 95.9)), 28, 1000),
}
_REGION_SQL = {
    "box": "x BETWEEN 30 AND 70 AND y BETWEEN 30 AND 90 AND z BETWEEN 100 AND 700",
    "sphere": "sqrt((x-60)*(x-60) + (y-60)*(y-60) + (z-400)*(z-400)) <= 150",
    "cylinder": "sqrt((x-56)*(x-56) + (y-60)*(y-60)) <= 25 AND z BETWEEN 60 AND 900",
    "slab": "x BETWEEN 36 AND 68",
    "rect": "x BETWEEN 28 AND 60 AND y BETWEEN 32 AND 80 AND z BETWEEN 60 AND 800",
    "ellipse": "((x-55)/35)*((x-55)/35) + ((z-500)/400)*((z-500)/400) <= 1 AND y BETWEEN 30 AND 90",
    "triangle": "z BETWEEN 28 AND 1000 AND ("
    + " + ".join(
        f"(CASE WHEN (({b0} > y) <> ({b1} > y)) AND x < (y - {b0}) * {(a1 - a0) / (b1 - b0)!r} + {a0} THEN 1 ELSE 0 END)"
        for (a0, b0), (a1, b1) in zip(((21.0, 25.5), (90.3, 33.7), (44.1, 95.9)), ((90.3, 33.7), (44.1, 95.9), (21.0, 25.5)))
    )
    + ") % 2 = 1",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS region, node_id FROM lat WHERE {v}" for k, v in _REGION_SQL.items()))
def prj4_region_nodes(spark, sf):
    """The nodes inside each of seven region shapes, in one pass over the nodes."""
    hits = F.array_compact(F.array(*[F.when(r.contains(), F.lit(k)) for k, r in REGIONS.items()]))
    return lattice(spark, sf).select(F.explode(hits).alias("region"), "node_id")


@query("""SELECT s_suppkey AS region_id, s_acctbal >= 0 AS valid, CASE WHEN s_acctbal < 0 THEN 'radius must be positive' END AS problem,
CAST((SELECT coalesce(max(s_suppkey), 0) + 1 FROM supplier) AS BIGINT) AS next_id FROM supplier""")
def prj5_region_validation(spark, sf):
    """Stored regions read from JSON; those that are not valid say why; the id that is free next."""
    s = table(spark, sf, "supplier").select("s_suppkey", F.to_json(F.struct(F.lit("sphere").alias("shape"), F.col("s_acctbal").alias("radius"))).alias("j"))
    r = s.withColumn("r", F.from_json("j", "shape string, radius double"))
    nxt = s.agg((F.coalesce(F.max("s_suppkey"), F.lit(0)) + 1).alias("next_id"))
    return r.crossJoin(F.broadcast(nxt)).select(F.col("s_suppkey").alias("region_id"), (F.col("r.radius") >= 0).alias("valid"), F.when(F.col("r.radius") < 0, "radius must be positive").alias("problem"), "next_id")


_REASONS = ("invalid", "not_converged", "outlier", "low_zncc")


def select_nodes(nodes, meas, min_zncc: float = 0.93):
    """Each measured node with the first reason that drops it, or null; a missing correlation counts as low."""
    j = nodes.join(meas, "node_id")
    reason = F.when(~F.col("node_valid"), "invalid").when(F.col("status") != 0, "not_converged").when(F.col("outlier"), "outlier").when(~F.coalesce(F.col("zncc") >= min_zncc, F.lit(False)), "low_zncc")
    return j.withColumn("drop_reason", reason)


@query("""WITH j AS (SELECT m.frame, CASE WHEN NOT l.node_valid THEN 'invalid' WHEN m.status <> 0 THEN 'not_converged' WHEN m.outlier THEN 'outlier' WHEN NOT coalesce(m.zncc >= 0.93, false) THEN 'low_zncc' END AS reason FROM lat l JOIN meas m USING (node_id))
SELECT frame, count(*) AS candidates, count(*) FILTER (reason = 'invalid') AS invalid, count(*) FILTER (reason = 'not_converged') AS not_converged, count(*) FILTER (reason = 'outlier') AS outlier, count(*) FILTER (reason = 'low_zncc') AS low_zncc, count(*) FILTER (reason IS NULL) AS kept FROM j GROUP BY frame""")
def prj6_selection_counts(spark, sf):
    """Nodes dropped by reason, each counted among those still kept, for every frame."""
    s = select_nodes(lattice(spark, sf), measurements(spark, sf))
    count = lambda c: F.count(F.when(c, 1))
    return s.groupBy("frame").agg(F.count("*").alias("candidates"), *[count(F.col("drop_reason") == r).alias(r) for r in _REASONS], count(F.col("drop_reason").isNull()).alias("kept"))


@query("""SELECT b.node_id, b.node_valid, (SELECT count(*) FROM lat n WHERE n.ix BETWEEN b.ix - 1 AND b.ix + 1 AND n.iy BETWEEN b.iy - 1 AND b.iy + 1 AND n.iz BETWEEN b.iz - 1 AND b.iz + 1 AND n.f <= 3) = 27 AS core FROM lat b""")
def prj7_edge_layers(spark, sf):
    """Erosion of a body by one layer."""
    n = lattice(spark, sf).withColumn("body", F.col("f") <= 3)
    return stencil.erode(n, "body", 1).select("node_id", "node_valid", "core")


@query(f"SELECT m.node_id, frame, CASE WHEN node_valid THEN {R('sqrt(u * u + v * v + w * w)')} END AS magnitude, CASE WHEN node_valid AND status = 0 THEN {R('u - v')} END AS trimmed FROM lat l JOIN meas m ON l.node_id = m.node_id")
def prj8_fields(spark, sf):
    """A derived field of displacement, and one that is also trimmed at untrusted nodes."""
    j = lattice(spark, sf).join(measurements(spark, sf), "node_id")
    size = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v") + F.col("w") * F.col("w"))
    return j.select("node_id", "frame", F.when(F.col("node_valid"), r6(size)).alias("magnitude"), F.when(F.col("node_valid") & (F.col("status") == 0), r6(F.col("u") - F.col("v"))).alias("trimmed"))


@query(f"""WITH j AS (SELECT m.*, l.node_valid FROM lat l JOIN meas m USING (node_id)), t AS (SELECT frame, avg(u) AS tu FROM j WHERE node_valid GROUP BY frame)
SELECT node_id, frame, CASE WHEN node_valid THEN {R('u - tu')} END AS value FROM j JOIN t USING (frame)""")
def prj9_frame_view(spark, sf):
    """A field with the frame's translation removed, null at invalid nodes."""
    j = lattice(spark, sf).join(measurements(spark, sf), "node_id")
    t = j.where("node_valid").groupBy("frame").agg(F.avg("u").alias("tu"))
    return j.join(t, "frame").select("node_id", "frame", F.when(F.col("node_valid"), r6(F.col("u") - F.col("tu"))).alias("value"))


@query("""SELECT p_partkey AS field_id, CASE WHEN p_type LIKE 'ECON%' THEN 'strain' ELSE 'displacement' END AS kind,
CASE WHEN p_type LIKE 'ECON%' THEN '-' WHEN p_size % 4 = 0 THEN 'voxel' WHEN p_brand = 'Brand#1' THEN '?' ELSE lower(p_brand) END AS unit FROM part""")
def prj10_units(spark, sf):
    p = table(spark, sf, "part")
    strain = F.col("p_type").startswith("ECON")
    return p.select(F.col("p_partkey").alias("field_id"), F.when(strain, "strain").otherwise("displacement").alias("kind"), F.when(strain, "-").when(F.col("p_size") % 4 == 0, "voxel").when(F.col("p_brand") == "Brand#1", "?").otherwise(F.lower("p_brand")).alias("unit"))


@query("""SELECT p_partkey AS sample_id, rtrim((CASE WHEN p_size < 4 THEN 'winsize,' ELSE '' END) || (CASE WHEN p_size % 2 = 1 THEN 'winsize_even,' ELSE '' END) || (CASE WHEN p_partkey % 50 > p_size THEN 'step,' ELSE '' END), ',') AS violations FROM part""")
def prj11_parameter_rules(spark, sf):
    """Names of the rules that each sample's parameters break."""
    rules = {"winsize": F.col("p_size") < 4, "winsize_even": F.col("p_size") % 2 == 1, "step": F.col("p_partkey") % 50 > F.col("p_size")}
    broken = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("sample_id"), F.array_join(broken, ",").alias("violations"))


@query("""SELECT vec_id, x, y, z, NOT (((x BETWEEN 4 AND 20 AND y BETWEEN 4 AND 24) OR ((x-16)/8.0)*((x-16)/8.0) + ((y-16)/12.0)*((y-16)/12.0) <= 1) AND NOT (x BETWEEN 10 AND 12 AND z BETWEEN 2 AND 6)) AS mask FROM vox""")
def prj12_mask_operations(spark, sf):
    """Drawing operations folded in their order: a rectangle, an ellipse added, a slot cut, inverted."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    p, q = (x - 16) / 8.0, (y - 16) / 12.0
    ops = [("replace", x.between(4, 20) & y.between(4, 24)), ("add", p * p + q * q <= 1), ("cut", x.between(10, 12) & z.between(2, 6)), ("invert", None)]
    mask = F.lit(False)
    for mode, shape in ops:
        mask = {"replace": lambda: shape, "add": lambda: mask | shape, "cut": lambda: mask & ~shape, "invert": lambda: ~mask}[mode]()
    return voxels(spark, sf).select("vec_id", "x", "y", "z", mask.alias("mask"))


@query(f"""SELECT y // 4 AS by, x // 4 AS bx, {R('max(CASE WHEN x % 4 = 0 AND y % 4 = 0 THEN v END)')} AS value, bool_and(m) AS inside FROM vox WHERE z = (SELECT (max(z) + 1) // 2 FROM vox) GROUP BY ALL""")
def prj13_middle_slice(spark, sf):
    """The middle slice, thinned: values by point, the mask only where its whole block is inside."""
    v = voxels(spark, sf)
    mid = v.agg(F.expr("(max(z) + 1) div 2").alias("mid"))
    s = v.join(F.broadcast(mid), F.col("z") == F.col("mid"))
    return s.groupBy(F.expr("y div 4").alias("by"), F.expr("x div 4").alias("bx")).agg(r6(F.max(F.when((F.col("x") % 4 == 0) & (F.col("y") % 4 == 0), F.col("v")))).alias("value"), F.bool_and("m").alias("inside"))


@query("""WITH p AS (SELECT p_partkey AS sample_id, 40 + p_size AS n, 2 + p_size % 6 AS step FROM part), q AS (SELECT *, 12 AS margin FROM p),
c AS (SELECT sample_id, step, n, (n - 1 - 2 * margin) // step + 1 AS k, margin FROM q)
SELECT sample_id, CAST(i AS BIGINT) AS i, CAST(margin + (n - 1 - 2 * margin - (k - 1) * step) // 2 + i * step AS BIGINT) AS x FROM c, range(100) t(i) WHERE i < k""")
def prj14_grid_axis(spark, sf):
    """Node positions along an axis, symmetric in what the border leaves."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("sample_id"), (40 + F.col("p_size")).alias("n"), (2 + F.col("p_size") % 6).alias("step"))
    c = p.withColumn("span", F.col("n") - 1 - 24).withColumn("k", F.expr("span div step + 1"))
    return c.select("sample_id", "span", "step", "k", F.explode(F.sequence(F.lit(0), (F.col("k") - 1).cast("int"))).alias("i")).select("sample_id", F.col("i").cast("long").alias("i"), F.expr("12 + (span - (k - 1) * step) div 2 + i * step").cast("long").alias("x"))


@query("""WITH s AS (SELECT max(iz) AS mz FROM lat)
SELECT a.node_id, (a.ix IN (0, 9) OR a.iy IN (0, 9) OR a.iz IN (0, s.mz)) AS surface,
 (a.ix IN (0, 9) OR a.iy IN (0, 9) OR a.iz IN (0, s.mz)) OR (a.node_valid AND EXISTS (SELECT 1 FROM lat b WHERE NOT b.node_valid AND abs(a.ix - b.ix) + abs(a.iy - b.iy) + abs(a.iz - b.iz) = 1 AND b.iz BETWEEN a.iz - 1 AND a.iz + 1)) AS boundary FROM lat a, s""")
def prj15_boundary_nodes(spark, sf):
    """Nodes on the grid's surface, and those that touch an invalid one."""
    n = lattice(spark, sf)
    top = n.agg(F.max("iz").alias("mz"))
    touch = F.lit(False)
    for a in stencil.AXES:
        for step in (-1, 1):
            touch = touch | F.coalesce(stencil.at((~F.col("node_valid")).cast("int"), a, step) == 1, F.lit(False))
    n = n.withColumn("touch", touch).crossJoin(F.broadcast(top))
    surface = F.col("ix").isin(0, 9) | F.col("iy").isin(0, 9) | (F.col("iz") == 0) | (F.col("iz") == F.col("mz"))
    return n.select("node_id", surface.alias("surface"), (surface | (F.col("node_valid") & F.col("touch"))).alias("boundary"))


@query("SELECT node_id, ix // 3 AS cx, iy // 3 AS cy, iz // 3 AS cz FROM lat WHERE ix % 3 = 0 AND iy % 3 = 0 AND iz % 3 = 0")
def prj16_coarse_lattice(spark, sf):
    return lattice(spark, sf).where("ix % 3 = 0 and iy % 3 = 0 and iz % 3 = 0").select("node_id", *[F.expr(f"i{a} div 3").alias(f"c{a}") for a in "xyz"])


#: Status codes of a node's solve. Fixed values.
STATUS = ("converged", "max_iter", "out_of_bounds", "invalid_subset", "singular", "nan", "skipped", "stalled")


@query("SELECT node_id, frame, code, CASE code " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(STATUS)) + f""" END AS name, {R('v')} AS first, {R('u')} AS p10, {R('v')} AS p11, {R('w')} AS p12
FROM (SELECT *, CASE WHEN node_id % 11 = 0 THEN 9 ELSE (status + node_id) % 8 END AS code FROM meas)""")
def prj17_status_and_pack(spark, sf):
    """Status names from a small dimension (unknown codes have none), and the twelve warp parameters packed and sliced."""
    names = spark.createDataFrame(list(enumerate(STATUS)), "code long, name string")
    m = measurements(spark, sf).withColumn("code", F.when(F.col("node_id") % 11 == 0, 9).otherwise((F.col("status") + F.col("node_id")) % 8)).join(F.broadcast(names), "code", "left")
    packed = F.concat(F.array(*["v"] * 9), F.array("u", "v", "w"))
    tail = F.slice(packed, 10, 3)
    return m.select("node_id", "frame", "code", "name", r6(F.get(F.slice(packed, 1, 1), F.lit(0))).alias("first"), *[r6(F.get(tail, F.lit(k))).alias(f"p{10 + k}") for k in range(3)])


@query("""SELECT a.node_id AS element, count(*) AS corners, bool_and(b.node_valid) AS live FROM lat a JOIN lat b ON b.ix BETWEEN a.ix AND a.ix + 1 AND b.iy BETWEEN a.iy AND a.iy + 1 AND b.iz BETWEEN a.iz AND a.iz + 1
WHERE a.ix < 9 AND a.iy < 9 AND a.iz < (SELECT max(iz) FROM lat) GROUP BY a.node_id""")
def prj18_live_elements(spark, sf):
    """Hexahedral elements with eight corners; those with an invalid corner are dead."""
    n = lattice(spark, sf)
    top = n.agg(F.max("iz").alias("mz"))
    corners = n.select("ix", "iy", "iz", "node_valid", F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz")) for a in (0, 1) for b in (0, 1) for c in (0, 1)])).alias("d"))
    e = corners.select((F.col("ix") - F.col("d.dx")).alias("ex"), (F.col("iy") - F.col("d.dy")).alias("ey"), (F.col("iz") - F.col("d.dz")).alias("ez"), "node_valid").crossJoin(F.broadcast(top))
    e = e.where("ex between 0 and 8 and ey between 0 and 8 and ez >= 0 and ez < mz")
    return e.groupBy((F.col("ex") + 10 * F.col("ey") + 100 * F.col("ez")).alias("element")).agg(F.count("*").alias("corners"), F.bool_and("node_valid").alias("live"))


@query("""WITH k AS (SELECT iz FROM lat GROUP BY iz ORDER BY abs(28 + 8 * iz - 131), iz LIMIT 1)
SELECT node_id, x, y, node_valid, (x - 50) * (x - 50) + (y - 50) * (y - 50) = (SELECT min((x - 50) * (x - 50) + (y - 50) * (y - 50)) FROM lat) AS nearest FROM lat WHERE iz = (SELECT iz FROM k)""")
def prj19_lattice_layer(spark, sf):
    """The node layer nearest to a slice, and its nodes nearest to a point."""
    n = lattice(spark, sf)
    k = n.agg(F.min_by("iz", F.struct(F.abs(F.col("z") - 131), F.col("iz"))).alias("k"))
    layer = n.join(F.broadcast(k), F.col("iz") == F.col("k"))
    d2 = (F.col("x") - 50) * (F.col("x") - 50) + (F.col("y") - 50) * (F.col("y") - 50)
    least = layer.agg(F.min(d2).alias("least"))
    return layer.crossJoin(F.broadcast(least)).select("node_id", "x", "y", "node_valid", (d2 == F.col("least")).alias("nearest"))


# ---- joins ----


@query("""WITH RECURSIVE s AS (SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS frame, CAST((l_linenumber - 1) // 2 AS BIGINT) AS ref FROM lineitem),
path AS (SELECT frame, ref AS anc, 1 AS depth FROM s UNION ALL SELECT p.frame, s.ref, p.depth + 1 FROM path p JOIN s ON s.frame = p.anc)
SELECT frame, anc, CAST(depth AS BIGINT) AS depth FROM path""")
def join1_reference_chain(spark, sf):
    """Every frame's path of reference frames back to the root, by doubling over the schedule's depth."""
    s = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("long").alias("frame"), F.expr("(l_linenumber - 1) div 2").alias("ref")).distinct()
    path = step = s.select("frame", F.col("ref").alias("anc"), F.lit(1).cast("long").alias("depth"))
    while True:
        step = step.alias("p").join(F.broadcast(s.alias("s")), F.col("p.anc") == F.col("s.frame")).select("p.frame", F.col("s.ref").alias("anc"), (F.col("p.depth") + 1).alias("depth"))
        if not step.limit(1).count():
            return path
        path = path.unionByName(step)


@query("""WITH a AS (SELECT node_id, round(x + 0.0001, 3) AS kx, round(y, 3) AS ky, round(z, 3) AS kz FROM lat), b AS (SELECT round(x, 3) AS kx, round(y, 3) AS ky, round(z, 3) AS kz, max(node_id) AS row FROM lat WHERE node_valid GROUP BY ALL)
SELECT node_id, coalesce(row, -1) AS match FROM a LEFT JOIN b USING (kx, ky, kz)""")
def join2_match_nodes(spark, sf):
    """Nodes of one grid matched to another by rounded coordinates; -1 where there is none, the last of duplicates."""
    n = lattice(spark, sf)
    key = lambda d: [F.bround(c + d * (c_ == "x"), 3).alias(f"k{c_}") for c_ in "xyz" for c in [F.col(c_)]]
    b = n.where("node_valid").select("node_id", *key(0.0)).groupBy("kx", "ky", "kz").agg(F.max("node_id").alias("row"))
    return n.select("node_id", *key(0.0001)).join(b, ["kx", "ky", "kz"], "left").select("node_id", F.coalesce("row", F.lit(-1)).alias("match"))


@query(f"""SELECT a.node_id, count(*) AS neighbours, {R('avg(b.f)')} AS mean FROM lat a JOIN lat b ON b.ix BETWEEN a.ix - 1 AND a.ix + 1 AND b.iy BETWEEN a.iy - 1 AND a.iy + 1 AND b.iz BETWEEN a.iz - 1 AND a.iz + 1 AND a.node_id <> b.node_id GROUP BY a.node_id""")
def join3_stencil(spark, sf):
    """The 26 neighbours of every node: box sums, one grid axis after the other, less the node itself."""
    n = lattice(spark, sf).select("node_id", "ix", "iy", "iz", "f", F.lit(1).alias("k"), F.col("f").alias("s"))
    s = stencil.box_sums(n, ["k", "s"], 1).where("k > 1")
    return s.select("node_id", (F.col("k") - 1).alias("neighbours"), r6((F.col("s") - F.col("f")) / (F.col("k") - 1)).alias("mean"))


@query("""SELECT a.node_id, count(b.node_id) AS same_side FROM lat a LEFT JOIN lat b ON b.node_valid AND abs(a.ix - b.ix) + abs(a.iy - b.iy) + abs(a.iz - b.iz) = 1 AND b.iz BETWEEN a.iz - 1 AND a.iz + 1 AND NOT (a.ix + b.ix = 9 AND a.ix <> b.ix) GROUP BY a.node_id""")
def join4_same_side(spark, sf):
    """Usable direct neighbours that an uncut edge reaches (edges between ix 4 and 5 are cut)."""
    total = F.lit(0)
    for a in stencil.AXES:
        for step in (-1, 1):
            cut = (F.col("ix") == (4 if step == 1 else 5)) if a == "ix" else F.lit(False)
            total = total + F.when(~cut, F.coalesce(stencil.at(F.col("node_valid").cast("int"), a, step), F.lit(0))).otherwise(0)
    return lattice(spark, sf).select("node_id", total.cast("long").alias("same_side"))


@query("""WITH b AS (SELECT node_id // 100 AS block, min(x) - 20 AS x0, max(x) + 20 AS x1, min(z) - 20 AS z0, max(z) + 20 AS z1 FROM lat GROUP BY 1)
SELECT block, CAST(bx AS BIGINT) AS bx, CAST(bz AS BIGINT) AS bz FROM b, range(8) t(bx), range(3000) s(bz) WHERE bx BETWEEN floor(x0 / 64) AND floor(x1 / 64) AND bz BETWEEN floor(z0 / 64) AND floor(z1 / 64)""")
def join5_block_bricks(spark, sf):
    """Bricks that each block of nodes needs with its halo, as an equi-joinable list."""
    b = lattice(spark, sf).groupBy(F.expr("node_id div 100").alias("block")).agg(*[e for a in "xz" for e in ((F.min(a) - 20).alias(f"{a}0"), (F.max(a) + 20).alias(f"{a}1"))])
    span = lambda a: F.explode(F.sequence(F.greatest(F.floor(F.col(f"{a}0") / 64), F.lit(0)), F.floor(F.col(f"{a}1") / 64)))
    return b.select("block", span("x").alias("bx"), "z0", "z1").select("block", "bx", span("z").alias("bz"))


def _cells(nodes):
    """(cx, cy, cz, v0..v7, k0..k7) of every grid cell that touches a node: the sum and number of values at each corner (x fastest)."""
    corners = F.explode(F.array(*[F.struct(*[F.lit(k >> i & 1).alias(a) for i, a in enumerate("xyz")], F.lit(k).alias("k")) for k in range(8)])).alias("c")
    c = nodes.select("ix", "iy", "iz", "f", corners).select(*[(F.col(f"i{a}") - F.col(f"c.{a}")).cast("long").alias(f"c{a}") for a in "xyz"], F.col("c.k").alias("k"), "f")
    here = [F.col("k") == k for k in range(8)]
    return c.groupBy("cx", "cy", "cz").agg(*[F.sum(F.when(h, F.col("f"))).alias(f"v{k}") for k, h in enumerate(here)], *[F.count_if(h).alias(f"k{k}") for k, h in enumerate(here)])


def _sample(points, cells, gx="gx", gy="gy", gz="gz"):
    """The points with `s` and `cover`: trilinear sum and weight at fractional grid positions (columns, or expressions of theirs);
    null where no corner of weight is a node.

    A point meets its cell, which holds all eight corners, so that no point is copied. The join is a merge join: the planner
    takes the cells for as small as the points' file, and would send them to every task through the driver.
    """
    g = {a: F.col(e) if isinstance(e, str) else e for a, e in zip("xyz", (gx, gy, gz))}
    kept = points.columns
    j = points.withColumns({f"c{a}": F.floor(e) for a, e in g.items()}).join(cells.hint("merge"), ["cx", "cy", "cz"], "left")
    # shares and weights are columns of their own, so that none is written out eight times in the generated code
    j = j.withColumns({f"_t{a}": e - F.floor(e) for a, e in g.items()})
    part = lambda k, i, a: F.col(f"_t{a}") if k >> i & 1 else 1 - F.col(f"_t{a}")
    j = j.withColumns({f"_w{k}": part(k, 0, "x") * part(k, 1, "y") * part(k, 2, "z") for k in range(8)})
    total = [F.when(F.col(f"_w{k}") > 0, F.col(f"_w{k}") * F.col(f"v{k}")) for k in range(8)]
    cover = sum((F.when(F.col(f"_w{k}") > 0, F.col(f"_w{k}") * F.coalesce(f"k{k}", F.lit(0))).otherwise(0.0) for k in range(8)), F.lit(0.0))
    s = F.when(F.coalesce(*total).isNotNull(), sum((F.coalesce(x, F.lit(0.0)) for x in total), F.lit(0.0)))
    return j.select(*kept, s.alias("s"), F.when(cover > 0, cover).alias("cover"))


def _corner_join(points, nodes, keep_all: bool):
    """(pid, s, cover) of the points (pid, gx, gy, gz), for fewer points than nodes: trilinear sum and weight over corners that are
    nodes. `keep_all` keeps points without such a corner, as nulls.

    A merge join too, and the only one: points that have to stay go through it, not through a second join.
    """
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (0, 1) for b in (0, 1) for c in (0, 1)])
    c = points.select("pid", "gx", "gy", "gz", F.explode(corners).alias("k"))
    part = lambda g, k: F.when(k == 1, F.col(g) - F.floor(g)).otherwise(1 - (F.col(g) - F.floor(g)))
    w = part("gx", F.col("k.a")) * part("gy", F.col("k.b")) * part("gz", F.col("k.c"))
    c = c.select("pid", *[(F.floor(g) + F.col(f"k.{k}")).alias(i) for g, k, i in (("gx", "a", "ix"), ("gy", "b", "iy"), ("gz", "c", "iz"))], w.alias("w"))
    c = c if keep_all else c.where("w > 0")
    j = c.join(nodes.withColumn("_here", F.lit(True)).hint("merge"), ["ix", "iy", "iz"], "left" if keep_all else "inner")
    used = F.col("_here") & (F.col("w") > 0)
    return j.groupBy("pid").agg(F.sum(F.when(used, F.col("w") * F.col("f"))).alias("s"), F.sum(F.when(used, F.col("w"))).alias("cover"))


_POINTS_SQL = "pts AS (SELECT p_partkey AS pid, (p_partkey % 37) / 4.5 AS gx, (p_partkey % 29) / 3.3 AS gy, (p_partkey % 41) / 3.1 AS gz FROM part)"
_CORNER_SQL = """cor AS (SELECT pid, floor(gx) + a AS ix, floor(gy) + b AS iy, floor(gz) + c AS iz,
 (CASE WHEN a = 1 THEN gx - floor(gx) ELSE 1 - (gx - floor(gx)) END) * (CASE WHEN b = 1 THEN gy - floor(gy) ELSE 1 - (gy - floor(gy)) END) * (CASE WHEN c = 1 THEN gz - floor(gz) ELSE 1 - (gz - floor(gz)) END) AS w FROM pts, range(2) p(a), range(2) q(b), range(2) r(c))"""


def _points(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("pid"), ((k % 37) / 4.5).alias("gx"), ((k % 29) / 3.3).alias("gy"), ((k % 41) / 3.1).alias("gz"))


@query(f"WITH {_POINTS_SQL}, {_CORNER_SQL} SELECT pid, {R('sum(w * f)')} AS value FROM cor JOIN lat USING (ix, iy, iz) WHERE w > 0 GROUP BY pid HAVING sum(w) > 1 - 1e-9")
def join6_interpolate(spark, sf):
    """Linear interpolation of a dense grid field at points inside the grid."""
    n = lattice(spark, sf).select("ix", "iy", "iz", "f")
    return _corner_join(_points(spark, sf), n, False).where(F.col("cover") > 1 - 1e-9).select("pid", r6("s").alias("value"))


@query(f"WITH {_POINTS_SQL}, {_CORNER_SQL}, g AS (SELECT pid, sum(w * f) AS s, sum(w) AS cover FROM cor JOIN (SELECT * FROM lat WHERE node_valid) USING (ix, iy, iz) WHERE w > 0 GROUP BY pid) SELECT pts.pid, CASE WHEN cover > 1 - 1e-9 THEN {R('s')} END AS value FROM pts LEFT JOIN g ON pts.pid = g.pid")
def join7_trilinear_or_null(spark, sf):
    """Trilinear samples, null where a node with weight has no value."""
    p = _points(spark, sf)
    n = lattice(spark, sf).where("node_valid").select("ix", "iy", "iz", "f")
    return _corner_join(p, n, True).select("pid", F.when(F.col("cover") > 1 - 1e-9, r6("s")).alias("value"))


@query(f"""WITH c AS (SELECT node_id, ix // 3 AS cx, iy // 3 AS cy, iz // 3 AS cz, node_valid, f FROM lat WHERE ix % 3 = 0 AND iy % 3 = 0 AND iz % 3 = 0),
d AS (SELECT a.node_id, min(((a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)+(a.cz-b.cz)*(a.cz-b.cz)) * 1000000000 + b.node_id) % 1000000000 AS src FROM c a JOIN c b ON b.node_valid AND NOT a.node_valid GROUP BY a.node_id),
g AS (SELECT c.cx, c.cy, c.cz, coalesce(e.f, c.f) AS f FROM c LEFT JOIN d ON d.node_id = c.node_id LEFT JOIN c e ON e.node_id = d.src),
s AS (SELECT max(cx) AS mx, max(cy) AS my, max(cz) AS mz FROM g),
p AS (SELECT node_id, ix / 3.0 AS gx, iy / 3.0 AS gy, iz / 3.0 AS gz, least(ix // 3, mx - 1) AS x0, least(iy // 3, my - 1) AS y0, least(iz // 3, mz - 1) AS z0 FROM lat, s),
k AS (SELECT node_id, x0 + a AS cx, y0 + b AS cy, z0 + e AS cz, (CASE WHEN a = 1 THEN gx - x0 ELSE 1 - (gx - x0) END) * (CASE WHEN b = 1 THEN gy - y0 ELSE 1 - (gy - y0) END) * (CASE WHEN e = 1 THEN gz - z0 ELSE 1 - (gz - z0) END) AS w FROM p, range(2) t(a), range(2) u(b), range(2) v(e))
SELECT node_id, {R('sum(w * f)')} AS value FROM k JOIN g USING (cx, cy, cz) GROUP BY node_id""")
def join8_coarse_to_fine(spark, sf):
    """A coarse lattice's values at every node: trilinear between, continued linearly beyond the last coarse node; coarse
    nodes without a value take the nearest one's first."""
    n = lattice(spark, sf)
    c = n.where("ix % 3 = 0 and iy % 3 = 0 and iz % 3 = 0").select("node_id", *[F.expr(f"i{a} div 3").alias(f"i{a}") for a in "xyz"], "node_valid", "f")
    filled = _nearest_fill(c, exact=True).select("node_id", F.col("value").alias("g"))
    c = c.join(filled, "node_id", "left").select(*[F.col(f"i{a}").alias(f"c{a}") for a in "xyz"], F.coalesce("g", "f").alias("f"))
    top = c.agg(*[(F.max(f"c{a}") - 1).alias(f"m{a}") for a in "xyz"])
    # a node goes to one block of coarse cells, a coarse node to the few blocks whose cells it is a corner of
    size, block = 16, [f"b{a}" for a in "xyz"]
    p = n.crossJoin(F.broadcast(top)).select("node_id", *[f"i{a}" for a in "xyz"], *[F.least(F.expr(f"i{a} div 3"), F.col(f"m{a}")).alias(f"{a}0") for a in "xyz"])
    p = p.select("*", *[F.floor(F.col(f"{a}0") / size).alias(f"b{a}") for a in "xyz"])
    for a in "xyz":
        c = c.withColumn(f"b{a}", F.explode(F.sequence(F.floor((F.col(f"c{a}") - 1) / size), F.floor(F.col(f"c{a}") / size))))

    def between(key, nodes, coarse):
        first = np.array(key, np.int64) * size
        value, there = np.full((size + 1,) * 3, np.nan), np.zeros((size + 1,) * 3, bool)
        at = tuple((coarse[["cx", "cy", "cz"]].to_numpy(np.int64) - first).T)
        value[at], there[at] = coarse["f"], True
        low = nodes[["x0", "y0", "z0"]].to_numpy(np.int64)
        t = nodes[["ix", "iy", "iz"]].to_numpy(float) / 3.0 - low
        total, known, some = np.zeros(len(nodes)), np.zeros(len(nodes), bool), np.zeros(len(nodes), bool)
        for k in np.ndindex((2, 2, 2)):
            corner = tuple((low - first + k).T)
            w = np.where(k, t, 1 - t).prod(axis=1)
            v = value[corner]
            total += np.where(np.isnan(v), 0.0, w * v)
            known |= ~np.isnan(v)
            some |= there[corner]
        return pd.DataFrame({"node_id": nodes["node_id"][some], "s": np.where(known, total, np.nan)[some]})

    done = p.groupBy(*block).cogroup(c.groupBy(*block)).applyInPandas(between, StructType([n.schema["node_id"], StructField("s", DoubleType())]))
    return done.select("node_id", F.when(~F.isnan("s"), r6("s")).alias("value"))


def _nearest_fill(nodes, exact=False):
    """(node_id, src, value) of every node without a value, at any distance: searched in growing shells.

    A hit within the reach is final. Small shells are lists of offsets, larger ones cells of half the reach, so that work
    follows the nodes that exist. Nothing is filled if no node has a value.
    """
    n = nodes.where("ix is not null and iy is not null and iz is not null")
    have = n.where("node_valid").select("node_id", "ix", "iy", "iz", "f")
    todo = n.where("not node_valid").select(F.col("node_id").alias("t"), *[F.col(f"i{a}").alias(f"t{a}") for a in "xyz"])
    done, reach, empty = None, 1, not have.limit(1).count()
    d2 = sum(((F.col(f"t{a}") - F.col(f"i{a}")) * (F.col(f"t{a}") - F.col(f"i{a}")) for a in "xyz"), F.lit(0))
    while True:
        if reach <= 4:
            c = todo.select("t", F.explode(stencil.offsets(reach)).alias("d"), "tx", "ty", "tz").select("t", "tx", "ty", "tz", *[(F.col(f"t{a}") + F.col(f"d.d{a}")).alias(f"i{a}") for a in "xyz"])
            hits = c.join(have, ["ix", "iy", "iz"])
        else:
            cell = lambda k: [F.floor(F.col(f"{k}{a}") / (reach // 2)).alias(f"c{a}") for a in "xyz"]
            c = todo.select("*", *cell("t")).select("t", "tx", "ty", "tz", *[F.col(f"c{a}") for a in "xyz"], F.explode(stencil.offsets(2, True)).alias("d"))
            hits = c.select("t", "tx", "ty", "tz", *[(F.col(f"c{a}") + F.col(f"d.d{a}")).alias(f"c{a}") for a in "xyz"]).join(have.select("*", *cell("i")), ["cx", "cy", "cz"])
        best = store.write(hits.withColumn("d2", d2).groupBy("t").agg(F.min(F.struct("d2", "node_id", "f")).alias("b")).where(F.col("b.d2") <= reach * reach))
        done = best if done is None else done.unionByName(best)
        todo = store.write(todo.join(best, "t", "left_anti"))
        if empty or not todo.limit(1).count():
            return done.select(F.col("t").alias("node_id"), F.col("b.node_id").alias("src"), (F.col("b.f") if exact else r6("b.f")).alias("value"))
        reach *= 2


@query(f"""WITH d AS (SELECT a.node_id, min(((a.ix-b.ix)*(a.ix-b.ix)+(a.iy-b.iy)*(a.iy-b.iy)+(a.iz-b.iz)*(a.iz-b.iz)) * 1000000000 + b.node_id) % 1000000000 AS src FROM lat a JOIN lat b ON b.node_valid AND NOT a.node_valid GROUP BY a.node_id)
SELECT d.node_id, src, {R('f')} AS value FROM d JOIN lat ON lat.node_id = src""")
def join9_nearest_fill(spark, sf):
    """Missing nodes filled from the nearest node with a value (ties: the smaller id)."""
    return _nearest_fill(lattice(spark, sf))


@query("SELECT region, frame, count(*) AS n, " + R("avg(u)") + " AS mean FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS region, node_id FROM lat WHERE {v}" for k, v in {**_REGION_SQL, "all": "true"}.items()) + ") r JOIN meas USING (node_id) GROUP BY region, frame")
def join10_region_series(spark, sf):
    """A series for each region and one for all nodes, in one job."""
    hits = F.array_append(F.array_compact(F.array(*[F.when(r.contains(), F.lit(k)) for k, r in REGIONS.items()])), F.lit("all"))
    n = lattice(spark, sf).select("node_id", hits.alias("r"))
    return measurements(spark, sf).join(n, "node_id").select("frame", "u", F.explode("r").alias("region")).groupBy("region", "frame").agg(F.count("*").alias("n"), r6(F.avg("u")).alias("mean"))


@query("""WITH e AS (SELECT ix, iy, iz, f > 3 AS bridging FROM lat WHERE ix < 9 AND iy < 9), k AS (SELECT e.ix, e.iy + b AS iy, e.iz + c AS iz, bridging FROM e, range(2) p(b), range(2) q(c))
SELECT ix, iy, iz, bool_and(bridging) AS cut FROM k GROUP BY ix, iy, iz""")
def join11_cut_edges(spark, sf):
    """An edge along x is cut when all elements that hold it bridge a gap."""
    e = lattice(spark, sf).where("ix < 9 and iy < 9").select("ix", "iy", "iz", (F.col("f") > 3).alias("bridging"))
    k = e.select("ix", F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.lit(c).alias("c")) for b in (0, 1) for c in (0, 1)])).alias("k"), "iy", "iz", "bridging")
    return k.groupBy("ix", (F.col("iy") + F.col("k.b")).alias("iy"), (F.col("iz") + F.col("k.c")).alias("iz")).agg(F.bool_and("bridging").alias("cut"))


@query(f"""WITH a AS (SELECT node_id, u, status FROM meas WHERE frame = 0), b AS (SELECT node_id, u, status FROM meas WHERE frame = 1), j AS (SELECT a.u - b.u AS d, a.status = 0 AND b.status = 0 AS conv FROM a JOIN b USING (node_id))
SELECT name, count(*) AS n, {R('avg(abs(d))')} AS mean_abs FROM (SELECT d, 'all' AS name FROM j UNION ALL SELECT d, 'converged' FROM j WHERE conv) GROUP BY name""")
def join12_compare_results(spark, sf):
    m = measurements(spark, sf)
    a, b = (m.where(f"frame = {k}").select("node_id", F.col("u").alias(f"u{k}"), F.col("status").alias(f"s{k}")) for k in (0, 1))
    names = F.when((F.col("s0") == 0) & (F.col("s1") == 0), F.array(F.lit("all"), F.lit("converged"))).otherwise(F.array(F.lit("all")))
    return a.join(b, "node_id").select((F.col("u0") - F.col("u1")).alias("d"), F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("n"), r6(F.avg(F.abs("d"))).alias("mean_abs"))


# ---- sets ----


@query("SELECT x, y, z, m OR x < 8 AS joined, m AND NOT x < 8 AS cut, NOT m AS inverse FROM vox")
def set1_masks(spark, sf):
    drawn = F.col("x") < 8
    return voxels(spark, sf).select("x", "y", "z", (F.col("m") | drawn).alias("joined"), (F.col("m") & ~drawn).alias("cut"), (~F.col("m")).alias("inverse"))


@query("SELECT node_id FROM meas GROUP BY node_id HAVING count(*) = (SELECT count(DISTINCT frame) FROM meas)")
def set2_common_nodes(spark, sf):
    """Nodes that every frame has."""
    m = measurements(spark, sf)
    frames = m.agg(F.count_distinct("frame").alias("frames"))
    return m.groupBy("node_id").agg(F.count("*").alias("k")).crossJoin(F.broadcast(frames)).where("k = frames").select("node_id")


@query(f"SELECT 'all' AS series, frame, {R('avg(u)')} AS mean FROM meas GROUP BY frame UNION ALL SELECT 'slab', frame, {R('avg(u)')} FROM meas JOIN lat USING (node_id) WHERE {_REGION_SQL['slab']} GROUP BY frame")
def set3_stacked_series(spark, sf):
    m = measurements(spark, sf)
    mean = lambda d, n: d.groupBy("frame").agg(r6(F.avg("u")).alias("mean")).withColumn("series", F.lit(n))
    slab = lattice(spark, sf).where(REGIONS["slab"].contains()).select("node_id")
    return mean(m, "all").unionByName(mean(m.join(slab, "node_id", "left_semi"), "slab"))


@query("""SELECT p_partkey AS sample_id, min(p_partkey) OVER w AS class_id, count(*) OVER w AS members FROM part WINDOW w AS (PARTITION BY p_brand, p_type, p_size, p_name)""")
def set4_same_settings(spark, sf):
    """Each sample with the class of those whose settings have its fingerprint: the smallest id and the number of members."""
    p = table(spark, sf, "part").select("p_partkey", F.sha2(F.to_json(F.struct("p_brand", "p_type", "p_size", "p_name")), 256).alias("mark"))
    classes = p.groupBy("mark").agg(F.min("p_partkey").alias("class_id"), F.count("*").alias("members"))
    return p.join(classes, "mark").select(F.col("p_partkey").alias("sample_id"), "class_id", "members")


@query("SELECT CAST(f AS BIGINT) AS frame, count(*) AS voxels, count(*) FILTER (m) AS inside FROM vox, range(7) t(f) GROUP BY f")
def set5_mask_for_all_frames(spark, sf):
    """One mask given to every frame of the sample."""
    frames = table(spark, sf, "lineitem").select((F.col("l_linenumber") - 1).cast("long").alias("frame")).distinct()
    mask = voxels(spark, sf).groupBy("m").agg(F.count("*").alias("n"))
    return mask.crossJoin(F.broadcast(frames)).groupBy("frame").agg(F.sum("n").alias("voxels"), F.sum(F.when(F.col("m"), F.col("n")).otherwise(0)).alias("inside"))
