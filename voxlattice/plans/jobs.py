"""Queries of grouped-map jobs and driver loops, which SQL doesn't express; tests compare them with NumPy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import blocks, bodies, graphs, motion, pyramid, solve, store
from ..operators import stencil as sl
from ..sources import volumes
from ..sources.views import lattice, measurements, table, voxels
from . import fields
from .registry import R, query, r6


def bricks(spark, sf):
    """The embedding volume as bricks of edge 4."""
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(F.expr("vec_id div 64").alias("bz"), (F.expr("vec_id div 8") % 8).alias("by"), (v % 8).alias("bx"), F.col("embedding").cast("array<double>").alias("data"))


def mask(spark, sf, level: float | None):
    """Bricks of the voxels above a level (none: the mean)."""
    b = bricks(spark, sf)
    mean = voxels(spark, sf).agg(F.avg("v").alias("level")) if level is None else None
    b = b.crossJoin(F.broadcast(mean)) if level is None else b.withColumn("level", F.lit(level))
    return b.select("bz", "by", "bx", F.transform("data", lambda v: (v > F.col("level")).cast("double")).alias("mask"))


def _field(spark, sf):
    return measurements(spark, sf).join(lattice(spark, sf).where("node_valid").select("node_id", "x", "y", "z"), "node_id")


@query()
def agg11_rigid_motion(spark, sf):
    """The rigid motion of every frame and what it leaves."""
    f = _field(spark, sf)
    return motion.fit(f, "rigid", "frame").join(motion.residual(f, "rigid", "frame"), "frame")


@query()
def agg11_rotation_angles(spark, sf):
    """The rotation of every frame's rigid motion as a vector and as Euler angles."""
    out = motion.angles(motion.fit(_field(spark, sf), "rigid", "frame"))
    return out.select("frame", *[r6(c).alias(c) for c in ("rv1", "rv2", "rv3", "rotation_deg", "ex", "ey", "ez")])


@query()
def agg13_rotation_and_stretch(spark, sf):
    """Every frame's affine deformation as a rotation and a stretch, beside the means of its nodes' components."""
    f = _field(spark, sf)
    m = motion.angles(motion.polar(motion.fit(f, "affine", "frame")), "r")
    means = f.groupBy("frame").agg(*[r6(F.avg(c)).alias(f"mean_{c}") for c in "uvw"])
    return m.select("frame", *[r6(c).alias(c) for c in ("rotation_deg", "rv1", "rv2", "rv3", "s11", "s22", "s33", "s12", "s13", "s23")]).join(means, "frame")


@query()
def agg13_homogeneous(spark, sf):
    """Affine deformation of every frame and its Green-Lagrange strain."""
    m = motion.fit(_field(spark, sf), "affine", "frame")
    e = lambda i, j: (sum((F.col(f"a{k}{i}") * F.col(f"a{k}{j}") for k in (1, 2, 3)), F.lit(0.0)) - (1.0 if i == j else 0.0)) / 2
    return m.select("frame", "n", *[r6(e(i, j)).alias(f"e{i}{j}") for i, j in ((1, 1), (2, 2), (3, 3), (1, 2), (1, 3), (2, 3))])


@query(f"""WITH c AS (SELECT avg(v) AS mu FROM vox), b AS (SELECT x, y, z, v - mu AS d FROM vox, c), o AS (SELECT a - 2 AS hz, e - 2 AS hy, g - 2 AS hx FROM range(5) t(a), range(5) u(e), range(5) w(g)),
p AS (SELECT hz, hy, hx, x + hx AS x, y + hy AS y, z + hz AS z, d FROM b, o), s AS (SELECT hz, hy, hx, count(*) AS pairs, avg(p.d * r.d) AS c FROM p JOIN b r USING (x, y, z) GROUP BY hz, hy, hx)
SELECT hz, hy, hx, pairs, {R('c / (SELECT c FROM s WHERE hz = 0 AND hy = 0 AND hx = 0)')} AS rho FROM s""")
def agg14_autocorrelation(spark, sf):
    """Three-dimensional autocorrelation up to lag 2, from every brick's partial sums."""
    b = bricks(spark, sf)
    mean = b.select(F.explode("data").alias("v")).agg(F.avg("v")).first()[0]
    s = blocks.autocovariance(b, 4, 2, mean)
    zero = s.where("hz = 0 and hy = 0 and hx = 0").select((F.col("s") / F.col("pairs")).alias("var"))
    return s.crossJoin(F.broadcast(zero)).select("hz", "hy", "hx", "pairs", r6(F.col("s") / F.col("pairs") / F.col("var")).alias("rho"))


@query("""WITH RECURSIVE k AS (SELECT x, y, z, (z * 32 + y) * 32 + x AS rank FROM vox WHERE v > (SELECT avg(v) FROM vox)), e AS (SELECT s.rank AS f, t.rank AS g FROM k s JOIN (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) n(a, b, c) ON true JOIN k t ON t.x = s.x + a AND t.y = s.y + b AND t.z = s.z + c),
i AS (SELECT rank AS seed, rank FROM k WHERE x % 8 = 0 AND y % 8 = 0 AND z % 8 = 0 UNION SELECT seed, g FROM i JOIN e ON f = rank), j AS (SELECT rank, min(seed) AS lab FROM i GROUP BY rank),
u AS (SELECT rank AS seed, rank FROM k WHERE rank NOT IN (SELECT rank FROM j) UNION SELECT seed, g FROM u JOIN e ON f = rank), l AS (SELECT rank, lab FROM j UNION ALL SELECT rank, min(seed) FROM u GROUP BY rank), q AS (SELECT min(rank) AS component, count(*) AS size FROM l GROUP BY lab)
SELECT component, size, component = (SELECT component FROM q ORDER BY size DESC, component LIMIT 1) AS largest FROM q""")
def agg21_largest_body(spark, sf):
    """Voxels above the mean: the connected bodies and which is the largest."""
    parts = bodies.sizes(mask(spark, sf, None), 4).select(((F.col("z") * 32 + F.col("y")) * 32 + F.col("x")).alias("component"), "size")
    parts = store.write(parts)
    top = parts.agg(F.max(F.struct("size", -F.col("component"))).alias("m"))
    return parts.crossJoin(F.broadcast(top)).select("component", "size", (-F.col("component") == F.col("m.col2")).alias("largest"))


@query()
def win11_harmonic_fill(spark, sf):
    """Values at invalid nodes from the mean of their neighbours."""
    n = lattice(spark, sf).withColumn("g", F.when(F.col("node_valid"), F.col("f")))
    return graphs.harmonic_fill(n, "g").select("node", r6("filled").alias("filled"))


def _moved_bricks(spark, sf, by):
    """Bricks of edge 4 of the volume and of the volume moved along x; what comes in from outside stands still."""
    v = voxels(spark, sf)
    w = sl.Window.partitionBy("y", "z").orderBy("x")
    moved = v.withColumn("d", F.coalesce(F.max("v").over(w.rangeBetween(-by, -by)), F.col("v")))
    order = F.struct(F.col("z") % 4, F.col("y") % 4, F.col("x") % 4)
    packed = moved.groupBy(F.expr("z div 4").alias("bz"), F.expr("y div 4").alias("by"), F.expr("x div 4").alias("bx")).agg(F.array_sort(F.collect_list(F.struct(order.alias("k"), "v", "d"))).alias("a"))
    return packed.select("bz", "by", "bx", F.transform("a", lambda t: t["v"]).alias("ref"), F.transform("a", lambda t: t["d"]).alias("def"))


@query()
def job1_block_matching(spark, sf):
    """The volume matched to itself moved by a voxel: search and refinement at every brick's centre."""
    return blocks.correlate(_moved_bricks(spark, sf, 1), 4, 2, 2)


def _brick_nodes(bricks):
    """A node at every brick's centre."""
    return bricks.select((F.col("bz") * 64 + F.col("by") * 8 + F.col("bx")).alias("node_id"), *[F.col(f"b{a}").alias(f"i{a}") for a in "xyz"], *[(F.col(f"b{a}") * 4 + 2).alias(a) for a in "zyx"])


@query()
def job2_expanding_search(spark, sf):
    """The volume moved by five voxels, searched within two: clipped nodes again with four and eight, and how many rounds each took."""
    b = _moved_bricks(spark, sf, 5)
    nodes = _brick_nodes(b).withColumns({f"s{a}": F.lit(0) for a in "zyx"})
    out = pyramid.expanding_search(b, 4, nodes, 2, 2, 2)
    return out.select("node_id", F.col("tx").alias("u"), F.col("ty").alias("v"), F.col("tz").alias("w"), r6("zncc").alias("zncc"), "clipped", "radius", "rounds")


@query()
def job2_pyramid_search(spark, sf):
    """The volume moved by four voxels, found on a halved copy first; cleaned by the median test between levels."""
    b = _moved_bricks(spark, sf, 4)
    out = pyramid.pyramid_search(b, 4, _brick_nodes(b), 2, 4, 1)
    return out.select("node_id", *[r6(c).alias(c) for c in ("u", "v", "w", "zncc")], "radius", "rounds")


@query()
def agg10_mean_confidence(spark, sf):
    """Interval of each frame's mean displacement that allows for correlated neighbours."""
    n = measurements(spark, sf).where("status = 0").join(lattice(spark, sf).where("node_valid").select("node_id", *sl.AXES), "node_id")
    out = solve.mean_confidence(n, "u", "frame")
    return out.select("frame", "n", *[r6(c).alias(c) for c in ("mean", "n_eff", "half_width")])


@query()
def agg19_phase_shift(spark, sf):
    """Whole-voxel shift between each brick row of the downsampled volume and the next."""
    v = voxels(spark, sf).groupBy(*[F.expr(f"{a} div 2").alias(a) for a in "zyx"]).agg(F.avg("v").alias("a"))
    moved = v.select((F.col("x") + 2).alias("x"), "y", "z", F.col("a").alias("b"))
    j = v.join(moved, ["x", "y", "z"]).withColumn("slab", F.expr("z div 4"))
    return solve.phase_shift(j, "a", "b", "slab")


@query()
def fn4_rotation_and_hencky(spark, sf):
    """Rotation angle and logarithmic strain of every measured gradient."""
    h = fields._h(spark, sf)
    return solve.rotations_and_hencky(h).select("node_id", "frame", r6("rotation_deg").alias("rotation_deg"), *[r6(f"hencky{i}").alias(f"hencky{i}") for i in ("11", "22", "33", "12", "13", "23")])


@query()
def job8_compatible_field(spark, sf):
    """A field made smooth over each frame's measured nodes, with the solve's residual."""
    n = measurements(spark, sf).join(lattice(spark, sf).select("node_id", *sl.AXES), "node_id")
    return solve.compatible_field(n, "u", 2.0, "frame").select("frame", "node_id", r6("smooth").alias("smooth"), (F.col("residual") < 1e-8).alias("solved"))


@query("SELECT iz AS layer, count(*) AS n_nodes FROM lat GROUP BY iz")
def snk5_image_index(spark, sf):
    """The image-data documents' index: a row a layer with its node count."""
    return snk5_image_data(spark, sf).select("layer", "n_nodes")


@query()
def snk5_image_data(spark, sf):
    """One image-data document per layer of nodes, with its node count as the manifest."""
    n = lattice(spark, sf).withColumn("layer", F.col("iz"))
    return volumes.image_data(n, ["f"], "layer").select("layer", "n_nodes", F.length("content").alias("characters"))


@query(f"SELECT 'embeddings' AS path, count(*) AS n, {R('avg(v)')} AS mean, {R('stddev_pop(v)')} AS std, {R('min(v)')} AS min, {R('max(v)')} AS max FROM vox")
def src5_brick_moments(spark, sf):
    """The volume's summary from each brick's partial sums."""
    b = bricks(spark, sf)

    def pack(batches):
        for f in batches:
            yield f.assign(data=[np.asarray(d, "<f4").tobytes() for d in f["data"]])

    packed = b.select(F.lit("embeddings").alias("path"), "data").mapInPandas(pack, "path string, data binary")
    return volumes.brick_moments(packed).select("path", "n", *[r6(c).alias(c) for c in ("mean", "std", "min", "max")])
