"""Texture of many boxes of one volume from its integral volume."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import integral, texture
from ..sources.views import voxels
from .jobs import bricks
from .registry import R, query, r6

LAGS = 3
SIZES, STRIDE = (8, 12, 16), 8
CUBES = (4, 8, 12, 16, 20, 24)


def _integral(spark, sf):
    mean = voxels(spark, sf).agg(F.avg("v")).first()[0]
    return integral.integral_volume(bricks(spark, sf), 4, LAGS, mean)


def _layers(spark, sf):
    return voxels(spark, sf).agg((F.max("z") + 1).alias("nz"))


def _box_sql(boxes: str) -> str:
    """Correlation of boxes bo (box, size, z0, z1, y0, y1, x0, x1) voxel by voxel."""
    return f"""{boxes}, i AS (SELECT box, size, x, y, z, v, x1, y1, z1, count(*) OVER w AS n, avg(v) OVER w AS mu, var_pop(v) OVER w AS var FROM bo JOIN vox ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 AND z >= z0 AND z < z1 WINDOW w AS (PARTITION BY box)),
wh AS (SELECT i.* FROM i JOIN bo USING (box) WHERE n = (bo.x1 - bo.x0) * (bo.y1 - bo.y0) * (bo.z1 - bo.z0)),
h AS (SELECT axis, lag, dx * lag AS dx, dy * lag AS dy, dz * lag AS dz FROM (VALUES ('x', 1, 0, 0), ('y', 0, 1, 0), ('z', 0, 0, 1)) a(axis, dx, dy, dz), range(0, {LAGS + 1}) l(lag)),
sh AS (SELECT box, size, axis, lag, x + dx AS x, y + dy AS y, z + dz AS z, v, mu, var FROM wh, h),
co AS (SELECT p.box, p.size, axis, lag, count(*) AS pairs, avg((p.v - p.mu) * (q.v - q.mu)) / any_value(p.var) AS rho FROM sh p JOIN wh q ON q.box = p.box AND q.x = p.x AND q.y = p.y AND q.z = p.z GROUP BY p.box, p.size, axis, lag)"""


_SWEEP = f"""bo AS (SELECT s || '/' || a || '/' || b || '/' || c AS box, s AS size, a * {STRIDE} AS z0, a * {STRIDE} + s AS z1, b * {STRIDE} AS y0, b * {STRIDE} + s AS y1, c * {STRIDE} AS x0, c * {STRIDE} + s AS x1
 FROM (VALUES {', '.join(f'({s})' for s in SIZES)}) t(s), range(0, 4) g(b), range(0, 4) k(c), (SELECT unnest(range(0, CAST((max(z) + 1) // {STRIDE} + 1 AS BIGINT))) AS a FROM vox) m WHERE b * {STRIDE} + s <= 32 AND c * {STRIDE} + s <= 32)"""


def _sweep(spark, sf):
    """Boxes of every size at every position of a lattice."""
    places = lambda n, s: F.sequence(F.lit(0), F.floor((n - s) / STRIDE).cast("int"))
    rows = _layers(spark, sf).select("nz", F.explode(F.array(*map(F.lit, SIZES))).alias("size"))
    rows = rows.where("nz >= size").select("size", F.explode(places(F.col("nz"), F.col("size"))).alias("a")).select("size", "a", F.explode(places(F.lit(32), F.col("size"))).alias("b")).select("size", "a", "b", F.explode(places(F.lit(32), F.col("size"))).alias("c"))
    ends = [x for k, i in zip("zyx", "abc") for x in ((F.col(i) * STRIDE).alias(f"{k}0"), (F.col(i) * STRIDE + F.col("size")).alias(f"{k}1"))]
    return rows.select(F.concat_ws("/", *[F.col(c).cast("string") for c in ("size", "a", "b", "c")]).alias("box"), "size", *ends)


@query(f"WITH {_box_sql(_SWEEP)} SELECT CAST(size AS INT) AS size, axis, CAST(lag AS INT) AS lag, count(*) AS boxes, {R('avg(rho)')} AS mean, {R('stddev_pop(rho)')} AS spread FROM co GROUP BY size, axis, lag")
def top3_box_sweep(spark, sf):
    """Autocorrelation of boxes of every size at every position: mean and spread by size, axis and lag."""
    boxes = _sweep(spark, sf)
    rho = integral.box_correlation(_integral(spark, sf), 4, LAGS, boxes).join(boxes.select("box", "size"), "box")
    return rho.groupBy("size", "axis", "lag").agg(F.count("*").alias("boxes"), r6(F.avg("rho")).alias("mean"), r6(F.stddev_pop("rho")).alias("spread"))


@query(f"""WITH {_box_sql(_SWEEP)}, f AS (SELECT box, size, axis, lag, rho, lead(rho) OVER w AS nx, row_number() OVER w AS k FROM co WINDOW w AS (PARTITION BY box, axis ORDER BY lag)),
c AS (SELECT box, size, axis, min_by(lag + (rho - 0.05) / (rho - nx), lag) AS length FROM f WHERE rho >= 0.05 AND nx < 0.05 GROUP BY box, size, axis), d AS (SELECT DISTINCT box, size, axis FROM co)
SELECT CAST(size AS INT) AS size, axis, count(length) AS crossed, count(*) AS boxes, {R('avg(length)')} AS mean, {R('stddev_pop(length)')} AS spread FROM d LEFT JOIN c USING (box, size, axis) GROUP BY size, axis""")
def top3_length_sweep(spark, sf):
    """Correlation lengths of all boxes: the level of every size, with boxes that never fall below the threshold counted."""
    boxes = _sweep(spark, sf)
    rho = integral.box_correlation(_integral(spark, sf), 4, LAGS, boxes).select("box", "axis", "lag", F.col("rho").alias("y"))
    lengths = texture.crossings(rho, (0.05,), "box", "axis").join(boxes.select("box", "size"), "box")
    return lengths.groupBy("size", "axis").agg(F.count("value").alias("crossed"), F.count("*").alias("boxes"), r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("spread"))


_CENTRED = f"""bo AS (SELECT s || '' AS box, s AS size, greatest(nz // 2 - s // 2, 0) AS z0, least(nz // 2 + s // 2, nz) AS z1, 16 - s // 2 AS y0, 16 + s // 2 AS y1, 16 - s // 2 AS x0, 16 + s // 2 AS x1 FROM (VALUES {', '.join(f'({s})' for s in CUBES)}) t(s), (SELECT (max(z) + 1) // 4 * 4 - 4 AS nz FROM vox) m)"""


@query(f"WITH {_box_sql(_CENTRED)} SELECT CAST(co.size AS INT) AS size, axis, CAST(lag AS INT) AS lag, pairs, {R('rho')} AS rho, {R('(x1 - x0) * (y1 - y0) * (z1 - z0) / (1.0 * co.size * co.size * co.size)')} AS fill FROM co JOIN bo USING (box)")
def agg17_concentric_cubes(spark, sf):
    """Cubes around the volume's centre, cut at its borders: autocorrelation, and how much of each cube lies inside."""
    rows = _layers(spark, sf).select((F.floor(F.col("nz") / 4) * 4 - 4).cast("int").alias("nz"), F.explode(F.array(*map(F.lit, CUBES))).alias("size"))
    half, mid = F.floor(F.col("size") / 2).cast("int"), F.floor(F.col("nz") / 2).cast("int")
    boxes = rows.select(F.col("size").cast("string").alias("box"), "size", F.greatest(mid - half, F.lit(0)).alias("z0"), F.least(mid + half, F.col("nz")).alias("z1"), *[x for a in "yx" for x in ((16 - half).alias(f"{a}0"), (16 + half).alias(f"{a}1"))])
    share = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * (F.col("z1") - F.col("z0")) / F.pow("size", F.lit(3))
    rho = integral.box_correlation(_integral(spark, sf), 4, LAGS, boxes)
    return rho.join(boxes.select("box", "size", r6(share).alias("fill")), "box").select("size", "axis", "lag", "pairs", r6("rho").alias("rho"), "fill")
