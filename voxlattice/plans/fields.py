"""Queries of field statistics, windows, decisions, functions and lines."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import strain as st
from ..operators import precision, schwarz, stats, stencil, store
from ..sources.views import lattice, measurements, table, voxels
from .nodes import REGIONS, _cells, _sample
from .registry import R, query, r6

_SUM = f"count(v) AS n, {R('avg(v)')} AS mean, {R('stddev_pop(v)')} AS std, {R('quantile_cont(v, 0.5)')} AS median, {R('quantile_cont(v, 0.05)')} AS p05, {R('quantile_cont(v, 0.95)')} AS p95, {R('min(v)')} AS min, {R('max(v)')} AS max, {R('sqrt(avg(v * v))')} AS rms"


def _rounded(df, *keys):
    return df.select(*[k for k in df.columns if k in keys or k in ("n", "field")], *[r6(c).alias(c) for c in df.columns if c not in keys and c not in ("n", "field")])


# ---- aggregations ----


@query(f"WITH s AS (SELECT frame, u AS v FROM meas), a AS (SELECT frame, {_SUM}, quantile_cont(v, 0.5) AS med FROM s GROUP BY frame), d AS (SELECT frame, {R('1.4826 * quantile_cont(abs(v - med), 0.5)')} AS robust_std FROM s JOIN a USING (frame) GROUP BY frame) SELECT a.* EXCLUDE (med), robust_std FROM a JOIN d USING (frame)")
def agg2_field_statistics(spark, sf):
    """Eleven statistics of a field per frame."""
    s = measurements(spark, sf).select("frame", F.col("u").alias("v"))
    return _rounded(stats.summarize(s, "v", "frame"), "frame")


@query(f"""WITH b AS (SELECT frame, avg(u - 2.5) AS bu, avg(v - 0.5) AS bv, avg(w - 0.4) AS bw, stddev_pop(u - 2.5) AS nu, stddev_pop(v - 0.5) AS nv, stddev_pop(w - 0.4) AS nw FROM meas GROUP BY frame)
SELECT frame, {R('sqrt(bu*bu + bv*bv + bw*bw)')} AS bias, {R('sqrt(nu*nu + nv*nv + nw*nw)')} AS noise, {R('sqrt(bu*bu + bv*bv + bw*bw + nu*nu + nv*nv + nw*nw)')} AS rms FROM b""")
def agg3_vector_precision(spark, sf):
    """Bias, noise floor and rms against a nominal displacement."""
    nominal = {"u": 2.5, "v": 0.5, "w": 0.4}
    b = measurements(spark, sf).groupBy("frame").agg(*[e for c, t in nominal.items() for e in (F.avg(F.col(c) - t).alias(f"b{c}"), F.stddev_pop(F.col(c) - t).alias(f"n{c}"))])
    sq = lambda k: sum((F.col(f"{k}{c}") * F.col(f"{k}{c}") for c in nominal), F.lit(0.0))
    return b.select("frame", r6(F.sqrt(sq("b"))).alias("bias"), r6(F.sqrt(sq("n"))).alias("noise"), r6(F.sqrt(sq("b") + sq("n"))).alias("rms"))


@query(f"SELECT frame, {R('avg((abs(u) + abs(v) + abs(w)) / 3)')} AS maer, {R('stddev_pop((abs(u) + abs(v) + abs(w)) / 3)')} AS sder FROM meas GROUP BY frame")
def agg4_strain_precision(spark, sf):
    m = (F.abs("u") + F.abs("v") + F.abs("w")) / 3
    return measurements(spark, sf).groupBy("frame").agg(r6(F.avg(m)).alias("maer"), r6(F.stddev_pop(m)).alias("sder"))


@query(f"""WITH c AS (SELECT node_id FROM meas GROUP BY node_id HAVING count(*) = (SELECT count(DISTINCT frame) FROM meas)), m AS (SELECT * FROM meas WHERE node_id IN (SELECT node_id FROM c))
SELECT c AS component, (SELECT {R('avg(s)')} FROM (SELECT stddev_pop(CASE c WHEN 'u' THEN u WHEN 'v' THEN v ELSE w END) AS s FROM m GROUP BY frame)) AS spatial, (SELECT {R('avg(s)')} FROM (SELECT stddev_pop(CASE c WHEN 'u' THEN u WHEN 'v' THEN v ELSE w END) AS s FROM m GROUP BY node_id)) AS temporal FROM (VALUES ('u'), ('v'), ('w')) t(c)""")
def agg5_spatial_temporal(spark, sf):
    """Spatial and temporal deviation of each component over nodes that every frame has."""
    m = store.write(measurements(spark, sf))
    frames = m.agg(F.count_distinct("frame").alias("frames"))
    common = m.groupBy("node_id").agg(F.count("*").alias("k")).crossJoin(F.broadcast(frames)).where("k = frames")
    m = stats.unpivot(m.join(common, "node_id", "left_semi").select("node_id", "frame", "u", "v", "w"), ["node_id", "frame"], ["u", "v", "w"])
    part = lambda key, name: m.groupBy("field", key).agg(F.stddev_pop("value").alias("s")).groupBy("field").agg(r6(F.avg("s")).alias(name))
    return part("frame", "spatial").join(part("node_id", "temporal"), "field").withColumnRenamed("field", "component")


_BOX = "x BETWEEN 30 AND 70 AND y BETWEEN 30 AND 90 AND z BETWEEN 28 AND 4000"


@query(f"""WITH j AS (SELECT frame, u, v, w FROM meas JOIN lat USING (node_id) WHERE node_valid AND status = 0 AND NOT outlier AND {_BOX}),
t AS (SELECT frame, avg(u) AS tu, avg(v) AS tv, avg(w) AS tw FROM j GROUP BY frame),
s AS (SELECT frame, 'u' AS field, u - tu AS v FROM j JOIN t USING (frame) UNION ALL SELECT frame, 'v', v - tv FROM j JOIN t USING (frame) UNION ALL SELECT frame, 'w', w - tw FROM j JOIN t USING (frame)),
a AS (SELECT frame, field, {_SUM}, quantile_cont(v, 0.5) AS med FROM s GROUP BY frame, field), d AS (SELECT frame, field, {R('1.4826 * quantile_cont(abs(v - med), 0.5)')} AS robust_std FROM s JOIN a USING (frame, field) GROUP BY frame, field)
SELECT a.* EXCLUDE (med), robust_std FROM a JOIN d USING (frame, field)""")
def agg6_frame_series(spark, sf):
    """Statistics of the displacement per frame over the good nodes of a region, with the mean translation removed."""
    from ..operators.regions import Box

    nodes = lattice(spark, sf).where(F.col("node_valid") & Box((30, 30, 28), (70, 90, 4000)).contains()).select("node_id")
    good = store.write(measurements(spark, sf).where("status = 0 and not outlier").join(nodes, "node_id", "left_semi").select("frame", "u", "v", "w"))
    t = good.groupBy("frame").agg(*[F.avg(c).alias(f"t{c}") for c in "uvw"])
    moved = good.join(t, "frame").select("frame", *[(F.col(c) - F.col(f"t{c}")).alias(c) for c in "uvw"])
    long = stats.unpivot(moved, ["frame"], ["u", "v", "w"]).withColumnRenamed("value", "val")
    return _rounded(stats.summarize(long, "val", "frame", "field"), "frame")


@query(f"SELECT frame, ix, count(u) AS n, {R('avg(u)')} AS mean, {R('stddev_pop(u)')} AS std FROM lat JOIN meas USING (node_id) WHERE node_valid GROUP BY frame, ix")
def agg7_layer_profile(spark, sf):
    j = lattice(spark, sf).where("node_valid").join(measurements(spark, sf), "node_id")
    return j.groupBy("frame", "ix").agg(F.count("u").alias("n"), r6(F.avg("u")).alias("mean"), r6(F.stddev_pop("u")).alias("std"))


@query(f"""SELECT a.node_id, {R('sum(CASE WHEN b.node_valid THEN 1.0 ELSE 0 END) / 125')} AS fraction FROM lat a JOIN lat b ON b.ix BETWEEN a.ix - 2 AND a.ix + 2 AND b.iy BETWEEN a.iy - 2 AND a.iy + 2 AND b.iz BETWEEN a.iz - 2 AND a.iz + 2 GROUP BY a.node_id""")
def agg8_window_fraction(spark, sf):
    """Share of a window's nominal volume that is inside, by three separable box sums."""
    n = lattice(spark, sf).withColumn("s", F.col("node_valid").cast("double"))
    for a in stencil.AXES:
        n = n.withColumn("s", F.sum("s").over(stencil.line(a).rangeBetween(-2, 2)))
    return n.select("node_id", r6(F.col("s") / 125).alias("fraction"))


@query("""WITH s AS (SELECT 'dense' AS field, f AS v FROM lat UNION ALL SELECT 'constant', 4.5 FROM lat), q AS (SELECT field, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, count(*) AS n, min(v) AS a, max(v) AS b FROM s GROUP BY field),
r AS (SELECT *, CASE WHEN b > a THEN a ELSE a - greatest(abs(a), 1) * 1e-6 END AS lo, CASE WHEN b > a THEN b ELSE b + greatest(abs(a), 1) * 1e-6 END AS hi FROM q),
w AS (SELECT field, lo, hi, n, CASE WHEN iqr > 0 THEN ceil((hi - lo) / (2 * iqr / pow(n, 1.0 / 3))) ELSE 0 END AS fd FROM r),
k AS (SELECT field, lo, hi, CAST(CASE WHEN fd BETWEEN 2 AND 80 THEN fd ELSE least(80, greatest(10, floor(sqrt(n)))) END AS BIGINT) AS bins FROM w)
SELECT field, CAST(least(bins - 1, floor((v - lo) / (hi - lo) * bins)) AS BIGINT) AS bin, count(*) AS n FROM s JOIN k USING (field) GROUP BY ALL""")
def agg9_histogram(spark, sf):
    """Freedman-Diaconis bins; where they would be under 2 or over 80, the root of the count, 10 to 80. A constant field
    gets bins around its value."""
    n = lattice(spark, sf)
    s = store.write(n.select(F.lit("dense").alias("field"), F.col("f").alias("v")).union(n.select(F.lit("constant"), F.lit(4.5))))
    q = stats.quantiles(s, "v", {"p25": 0.25, "p75": 0.75}, "field").join(s.groupBy("field").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")), "field")
    pad = F.when(F.col("b") > F.col("a"), 0.0).otherwise(F.greatest(F.abs("a"), F.lit(1.0)) * 1e-6)
    q = q.select("field", (F.col("a") - pad).alias("lo"), (F.col("b") + pad).alias("hi"), "n", (F.col("p75") - F.col("p25")).alias("iqr"))
    fd = F.when(F.col("iqr") > 0, F.ceil((F.col("hi") - F.col("lo")) / (2 * F.col("iqr") / F.pow("n", F.lit(1.0 / 3))))).otherwise(0)
    q = q.select("field", "lo", "hi", F.when(fd.between(2, 80), fd).otherwise(F.least(F.lit(80), F.greatest(F.lit(10), F.floor(F.sqrt("n"))))).alias("bins"))
    k = F.least(F.col("bins") - 1, F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins"))).cast("long")
    return s.join(F.broadcast(q), "field").groupBy("field", k.alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH j AS (SELECT frame, x, u FROM lat JOIN meas USING (node_id)) SELECT frame, count(*) AS n, {R('regr_slope(u, x)')} AS slope, {R('regr_intercept(u, x)')} AS offset_u, {R('avg(u)')} AS translation FROM j GROUP BY frame""")
def agg11_motion_moments(spark, sf):
    """Translation and a least-squares line per frame from one pass of moments."""
    j = lattice(spark, sf).join(measurements(spark, sf), "node_id")
    return j.groupBy("frame").agg(F.count("*").alias("n"), r6(F.regr_slope("u", "x")).alias("slope"), r6(F.regr_intercept("u", "x")).alias("offset_u"), r6(F.avg("u")).alias("translation"))


@query(f"""WITH t AS (SELECT frame, avg(u) AS tu, stddev_pop(u) AS su, avg(abs(v)) AS mae FROM meas WHERE status = 0 GROUP BY frame) SELECT {R('avg(tu)')} AS bias, {R('avg(su)')} AS noise, {R('avg(mae)')} AS maer, count(*) AS frames FROM t""")
def agg12_noise_floor(spark, sf):
    t = measurements(spark, sf).where("status = 0").groupBy("frame").agg(F.avg("u").alias("tu"), F.stddev_pop("u").alias("su"), F.avg(F.abs("v")).alias("mae"))
    return t.agg(r6(F.avg("tu")).alias("bias"), r6(F.avg("su")).alias("noise"), r6(F.avg("mae")).alias("maer"), F.count("*").alias("frames"))


@query(f"""WITH c AS (SELECT avg(v) AS mu FROM vox), b AS (SELECT x, y, z, v - mu AS d FROM vox, c), o AS (SELECT a, h, CASE WHEN a = 'x' THEN h ELSE 0 END AS hx, CASE WHEN a = 'y' THEN h ELSE 0 END AS hy, CASE WHEN a = 'z' THEN h ELSE 0 END AS hz FROM (VALUES ('x'), ('y'), ('z')) t(a), range(0, 5) u(h)),
p AS (SELECT o.a AS axis, h, x + hx AS x, y + hy AS y, z + hz AS z, d FROM b, o), s AS (SELECT axis, h, avg(p.d * r.d) AS c FROM p JOIN b r USING (x, y, z) GROUP BY axis, h)
SELECT axis, CAST(h AS BIGINT) AS lag, {R("c / first_value(c) OVER (PARTITION BY axis ORDER BY h)")} AS rho FROM s""")
def agg14_autocorrelation_line(spark, sf):
    """Pair-corrected autocorrelation along each axis: voxels meet their shifted partners on grid lines."""
    v = voxels(spark, sf)
    d = v.crossJoin(F.broadcast(v.agg(F.avg("v").alias("mean")))).select("x", "y", "z", (F.col("v") - F.col("mean")).alias("d"))
    out = None
    for a in "xyz":
        w = Window.partitionBy(*[c for c in "xyz" if c != a]).orderBy(a)
        products = d.select(*[(F.col("d") * F.max("d").over(w.rangeBetween(h, h))).alias(f"h{h}") for h in range(5)])
        means = products.agg(*[F.avg(f"h{h}").alias(f"h{h}") for h in range(5)])
        rows = means.select(F.lit(a).alias("axis"), F.posexplode(F.array(*[F.col(f"h{h}") / F.col("h0") for h in range(5)])).alias("lag", "rho")).select("axis", F.col("lag").cast("long").alias("lag"), r6("rho").alias("rho"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""SELECT CAST(floor(sqrt(CAST((x-16)*(x-16) + (y-16)*(y-16) + (z-16)*(z-16) AS DOUBLE))) AS BIGINT) AS bin, count(*) AS n, {R('avg(v)')} AS mean, {R('sqrt(greatest(avg(v*v) - avg(v)*avg(v), 0))')} AS std, {R('avg(sqrt(CAST((x-16)*(x-16) + (y-16)*(y-16) + (z-16)*(z-16) AS DOUBLE)))')} AS lag FROM vox GROUP BY 1""")
def agg15_radial_profile(spark, sf):
    """Shell means about a centre."""
    r = F.sqrt(((F.col("x") - 16) * (F.col("x") - 16) + (F.col("y") - 16) * (F.col("y") - 16) + (F.col("z") - 16) * (F.col("z") - 16)).cast("double"))
    var = F.avg(F.col("v") * F.col("v")) - F.avg("v") * F.avg("v")
    return voxels(spark, sf).withColumn("r", r).groupBy(F.floor("r").alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("v")).alias("mean"), r6(F.sqrt(F.greatest(var, F.lit(0.0)))).alias("std"), r6(F.avg("r")).alias("lag"))


@query(f"SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, {R('avg(v)')} AS v FROM vox GROUP BY ALL")
def agg18_block_downsample(spark, sf):
    return voxels(spark, sf).groupBy(*[F.expr(f"{a} div 2").alias(a) for a in "zyx"]).agg(r6(F.avg("v")).alias("v"))


@query(f"""WITH r AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n FROM vox), h AS (SELECT CAST(least(255, floor((v - lo) / (hi - lo) * 256)) AS BIGINT) AS b, count(*) AS k FROM vox, r GROUP BY 1),
c AS (SELECT b, sum(k) OVER (ORDER BY b) AS w, sum(k * b) OVER (ORDER BY b) AS m, sum(k) OVER () AS n, sum(k * b) OVER () AS t FROM h),
s AS (SELECT b, round((CAST(t AS DOUBLE) * w / n - m) * (CAST(t AS DOUBLE) * w / n - m) / (CAST(w AS DOUBLE) * (n - w)), 9) AS var FROM c WHERE w < n)
SELECT CAST(max(b) AS BIGINT) AS last_bin, CAST(min(b) AS BIGINT) AS first_bin FROM s WHERE var = (SELECT max(var) FROM s)""")
def agg20_otsu(spark, sf):
    """Bins of the greatest between-class variance of a 256-bin histogram."""
    v = voxels(spark, sf)
    r = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    h = v.crossJoin(F.broadcast(r)).groupBy(F.least(F.lit(255), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 256)).cast("long").alias("b")).agg(F.count("*").alias("k"))
    run, every = Window.orderBy("b"), Window.partitionBy()  # 256 rows at most
    c = h.select("b", F.sum("k").over(run).alias("w"), F.sum(F.col("k") * F.col("b")).over(run).alias("m"), F.sum("k").over(every).alias("n"), F.sum(F.col("k") * F.col("b")).over(every).alias("t")).where("w < n")
    d = F.col("t").cast("double") * F.col("w") / F.col("n") - F.col("m")
    s = c.withColumn("var", F.round(d * d / (F.col("w").cast("double") * (F.col("n") - F.col("w"))), 9))
    best = s.agg(F.max("var").alias("best"))
    return s.join(F.broadcast(best), F.col("var") == F.col("best")).agg(F.max("b").alias("last_bin"), F.min("b").alias("first_bin"))


@query(f"""WITH c AS (SELECT frame, node_id, CASE WHEN status = 0 THEN u END AS it FROM meas), t AS (SELECT frame, greatest(6, avg(it) + 2 * stddev_samp(it)) AS thr FROM c GROUP BY frame)
SELECT frame, count(it) AS converged, {R('avg(it)')} AS mean_iter, {R('quantile_cont(it, 0.5)')} AS median_iter, count(*) FILTER (it > thr) AS slow FROM c JOIN t USING (frame) GROUP BY frame""")
def agg22_solve_summary(spark, sf):
    """Converged nodes, and those much slower than the rest (sample deviation, floor 6)."""
    c = measurements(spark, sf).select("frame", F.when(F.col("status") == 0, F.col("u")).alias("it"))
    c = store.write(c)
    t = c.groupBy("frame").agg(F.greatest(F.lit(6.0), F.avg("it") + 2 * F.stddev_samp("it")).alias("thr"))
    out = c.join(t, "frame").groupBy("frame").agg(F.count("it").alias("converged"), r6(F.avg("it")).alias("mean_iter"), F.count(F.when(F.col("it") > F.col("thr"), 1)).alias("slow"))
    return out.join(stats.quantiles(c, "it", {"median": 0.5}, "frame"), "frame", "left").select("frame", "converged", "mean_iter", r6("median").alias("median_iter"), "slow")


@query(f"SELECT {R('quantile_cont(v, 0.01)')} AS low, {R('quantile_cont(v, 0.99)')} AS high, {R('quantile_cont(CASE WHEN (x + 32 * y + 1024 * z) % 7 = 0 THEN v END, 0.005)')} AS grey_low FROM vox")
def agg23_value_range(spark, sf):
    """A display range, and the grey window of every seventh voxel."""
    sampled = F.when((F.col("x") + 32 * F.col("y") + 1024 * F.col("z")) % 7 == 0, F.col("v"))
    v = store.write(voxels(spark, sf).select(F.lit(0).alias("all"), "v", sampled.alias("s")))
    q = stats.quantiles(v, "v", {"low": 0.01, "high": 0.99}, "all").join(stats.quantiles(v, "s", {"grey_low": 0.005}, "all"), "all")
    return q.select(*[r6(c).alias(c) for c in ("low", "high", "grey_low")])


@query(f"""WITH j AS (SELECT abs(a.u - b.u) AS d, a.u - b.u AS s FROM meas a JOIN meas b ON a.node_id = b.node_id AND a.frame = 0 AND b.frame = 1)
SELECT count(*) AS n, {R('quantile_cont(d, 0.5)')} AS median_abs, {R('sqrt(avg(s*s))')} AS rms, {R('quantile_cont(d, 0.95)')} AS p95, {R('quantile_cont(d, 0.99)')} AS p99, {R('max(d)')} AS max, {R('avg(s)')} AS bias, {R('avg(CASE WHEN d > 1 THEN 1.0 ELSE 0.0 END)')} AS over FROM j""")
def agg24_difference_statistics(spark, sf):
    at = lambda k: F.max(F.when(F.col("frame") == k, F.col("u")))
    j = measurements(spark, sf).where("frame in (0, 1)").groupBy("node_id").agg((at(0) - at(1)).alias("s")).where("s is not null")
    j = store.write(j.select(F.lit(0).alias("all"), "s", F.abs("s").alias("d")))
    q = stats.quantiles(j, "d", {"median_abs": 0.5, "p95": 0.95, "p99": 0.99}, "all")
    s = j.groupBy("all").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("s") * F.col("s"))).alias("rms"), F.max("d").alias("max"), F.avg("s").alias("bias"), F.avg(F.when(F.col("d") > 1, 1.0).otherwise(0.0)).alias("over"))
    return s.join(q, "all").select("n", *[r6(c).alias(c) for c in ("median_abs", "rms", "p95", "p99", "max", "bias", "over")])


@query(f"""WITH e AS (SELECT p_size AS b, avg(p_retailprice) AS e1, stddev_pop(p_retailprice) AS e2 FROM part GROUP BY p_size),
s AS (SELECT b, (e1 - avg(e1) OVER ()) / stddev_pop(e1) OVER () + (e2 - avg(e2) OVER ()) / stddev_pop(e2) OVER () AS score FROM e)
SELECT CAST(arg_min(b, score) AS BIGINT) AS beta, {R('min(score)')} AS score FROM s""")
def agg25_penalty_choice(spark, sf):
    """The candidate with the least sum of two z-scored error norms."""
    e = table(spark, sf, "part").groupBy(F.col("p_size").alias("b")).agg(F.avg("p_retailprice").alias("e1"), F.stddev_pop("p_retailprice").alias("e2"))
    w = Window.partitionBy()  # a candidate a row
    z = lambda c: (F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w)
    return e.withColumn("score", z("e1") + z("e2")).agg(F.min_by("b", "score").cast("long").alias("beta"), r6(F.min("score")).alias("score"))


@query("""SELECT p_partkey AS sample_id, CAST(p_size AS BIGINT) * 32 * 1024 * 1024 * (CASE WHEN p_partkey % 2 = 0 THEN 21 ELSE 9 END) AS bytes, CASE WHEN CAST(p_size AS BIGINT) * 32 * 1024 * 1024 * 21 > 8589934592 THEN 'on_the_fly' ELSE 'stored' END AS mode FROM part""")
def agg26_memory_model(spark, sf):
    voxels_ = F.col("p_size").cast("long") * 32 * 1024 * 1024
    return table(spark, sf, "part").select(F.col("p_partkey").alias("sample_id"), (voxels_ * F.when(F.col("p_partkey") % 2 == 0, 21).otherwise(9)).alias("bytes"), F.when(voxels_ * 21 > 8589934592, "on_the_fly").otherwise("stored").alias("mode"))


# ---- windows and decisions ----

_DAYS_SQL = """d AS (SELECT event_type AS box, CAST(ts AS DATE) AS day, avg(value) AS a FROM events GROUP BY ALL),
p AS (SELECT box, CAST(row_number() OVER (PARTITION BY box ORDER BY day) - 1 AS BIGINT) AS lag, a / first_value(a) OVER (PARTITION BY box ORDER BY day) AS y FROM d)"""


def _profiles(spark, sf):
    d = table(spark, sf, "events").groupBy(F.col("event_type").alias("box"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("a"))
    w = Window.partitionBy("box").orderBy("day")
    return d.select("box", (F.row_number().over(w) - 1).cast("long").alias("lag"), (F.col("a") / F.first("a").over(w)).alias("y"))


@query(f"""WITH {_DAYS_SQL}, t(t) AS (VALUES (0.98), (0.95), (0.9)), n AS (SELECT p.*, t.t, lead(y) OVER w AS y1, lag(y) OVER w AS y0 FROM p, t WINDOW w AS (PARTITION BY box, t ORDER BY lag)),
c AS (SELECT box, t, min(lag) AS i FROM n WHERE y >= t AND y1 < t GROUP BY box, t)
SELECT b.box, CAST(b.t AS DOUBLE) AS threshold, {R('CASE WHEN n.y = n.t THEN n.lag ELSE n.lag + (n.y - n.t) / (n.y - n.y1) END')} AS value, CASE WHEN n.lag IS NULL THEN 'not_crossed' WHEN n.y = n.t AND n.y0 = n.t THEN 'plateau' ELSE 'crossed' END AS status
FROM (SELECT DISTINCT box, t FROM n) b LEFT JOIN c USING (box, t) LEFT JOIN n ON n.box = c.box AND n.t = c.t AND n.lag = c.i""")
def win1_correlation_length(spark, sf):
    """First strict downward crossing of each profile through each threshold."""
    from ..operators.texture import crossings

    out = crossings(_profiles(spark, sf), (0.98, 0.95, 0.9), "box")
    return out.select("box", "threshold", r6("value").alias("value"), "status")


@query(f"""WITH {_DAYS_SQL}, k AS (SELECT box, max(lag) / 2.0 AS start FROM p GROUP BY box) SELECT box, CASE WHEN count(y) >= 3 THEN {R('stddev_pop(y)')} END AS floor FROM p JOIN k USING (box) WHERE lag >= start GROUP BY box""")
def win2_noise_floor(spark, sf):
    """Deviation of the outer half of each profile."""
    p = _profiles(spark, sf)
    start = p.groupBy("box").agg((F.max("lag") / 2).alias("start"))
    return p.join(start, "box").where("lag >= start").groupBy("box").agg(F.when(F.count("y") >= 3, r6(F.stddev_pop("y"))).alias("floor"))


@query(f"""WITH {_DAYS_SQL}, n AS (SELECT *, lag(y) OVER w AS y0, lead(y) OVER w AS y1 FROM p WINDOW w AS (PARTITION BY box ORDER BY lag)),
lo AS (SELECT box, min(lag) AS i FROM n WHERE y <= y0 AND y < y1 GROUP BY box), hi AS (SELECT n.box, min(n.lag) AS j FROM n JOIN lo USING (box) WHERE n.lag > i AND y >= y0 AND y > y1 GROUP BY n.box)
SELECT hi.box, a.lag AS period, {R('a.y')} AS height FROM hi JOIN lo USING (box) JOIN n a ON a.box = hi.box AND a.lag = hi.j JOIN n b ON b.box = hi.box AND b.lag = lo.i WHERE a.y >= 0.1 AND a.y > b.y + 0.02""")
def win3_periodicity(spark, sf):
    """First maximum after a profile's first minimum, if it is a real peak."""
    w = Window.partitionBy("box").orderBy("lag")
    n = _profiles(spark, sf).withColumns({"y0": F.lag("y").over(w), "y1": F.lead("y").over(w)})
    lo = n.where("y <= y0 and y < y1").groupBy("box").agg(F.min(F.struct("lag", "y")).alias("lo"))
    hi = n.join(lo, "box").where("lag > lo.lag and y >= y0 and y > y1").groupBy("box").agg(F.min(F.struct("lag", "y", F.col("lo.y").alias("low"))).alias("h"))
    return hi.where("h.y >= 0.1 and h.y > h.low + 0.02").select("box", F.col("h.lag").alias("period"), r6("h.y").alias("height"))


_LEVELS_SQL = "lv AS (SELECT p_brand AS g, CAST(p_size AS BIGINT) AS size, avg(p_retailprice) AS mean, stddev_pop(p_retailprice) AS spread FROM part GROUP BY ALL)"


def _levels(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("g"), F.col("p_size").cast("long").alias("size")).agg(F.avg("p_retailprice").alias("mean"), F.stddev_pop("p_retailprice").alias("spread"))


@query(f"""WITH {_LEVELS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY size DESC) AS k FROM lv), ref AS (SELECT g, avg(mean) AS reference, 150 + 0.05 * abs(avg(mean)) AS tol FROM r WHERE k <= 3 GROUP BY g),
c AS (SELECT lv.*, reference, tol, max(abs(mean - reference)) OVER (PARTITION BY g ORDER BY size ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS worst, max(size) OVER (PARTITION BY g) AS top FROM lv JOIN ref USING (g))
SELECT g, {R('reference')} AS reference, {R('tol')} AS tolerance, min(size) FILTER (worst <= tol AND top >= 1.2 * size AND spread <= tol) AS settled FROM c GROUP BY g, reference, tol""")
def win4_plateau(spark, sf):
    """The smallest size from which all larger ones stay in the band about the largest ones' mean."""
    from ..operators.texture import plateau

    out = plateau(_levels(spark, sf), "g", 3, 150.0, 0.05, 1.2)
    return out.select("g", r6("reference").alias("reference"), r6("tolerance").alias("tolerance"), "settled")


@query(f"""WITH {_LEVELS_SQL}, w AS (SELECT g, size, first_value(size) OVER win AS start, count(*) OVER win AS k, avg(mean) OVER win AS mu, stddev_pop(mean) OVER win AS sd FROM lv WINDOW win AS (PARTITION BY g ORDER BY size ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
s AS (SELECT *, CASE WHEN mu <= 1e-12 THEN NULL ELSE sd / mu <= 0.08 OR sd <= 20 END AS stable FROM w WHERE k = 3),
q AS (SELECT *, bool_and(coalesce(stable, true)) OVER (PARTITION BY g ORDER BY size ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS holds FROM s)
SELECT g, min(start) FILTER (stable AND holds) AS settled, {R('arg_min(mu, size) FILTER (stable AND holds)')} AS reference FROM q GROUP BY g""")
def win5_cv_window(spark, sf):
    """The first window of three sizes with a stable length whose later windows are stable too."""
    from ..operators.texture import cv_window

    out = cv_window(_levels(spark, sf), "g", 3, 0.08, 20.0)
    return out.select("g", "settled", r6("reference").alias("reference"))


@query(f"""WITH n AS (SELECT *, CASE WHEN node_valid THEN f END AS g FROM lat), d AS (SELECT a.node_id, a.node_valid, a.g, l.g AS lo, h.g AS hi FROM n a LEFT JOIN n l ON l.ix = a.ix - 1 AND l.iy = a.iy AND l.iz = a.iz LEFT JOIN n h ON h.ix = a.ix + 1 AND h.iy = a.iy AND h.iz = a.iz)
SELECT node_id, CASE WHEN node_valid THEN {R('CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN (hi - lo) / 16 WHEN hi IS NOT NULL THEN (hi - g) / 8 WHEN lo IS NOT NULL THEN (g - lo) / 8 END')} END AS d_ix FROM d""")
def win6_gradient(spark, sf):
    """Finite differences, one-sided beside invalid nodes."""
    return stencil.gradient(lattice(spark, sf), "f", "node_valid", 8.0).select("node_id", r6("d_ix").alias("d_ix"))


@query(f"""SELECT a.node_id, {R('sum(b.f * (b.ix - a.ix)) / sum((b.ix - a.ix) * (b.ix - a.ix)) / 8')} AS d_ix, {R('sum(b.f * (b.iy - a.iy)) / sum((b.iy - a.iy) * (b.iy - a.iy)) / 8')} AS d_iy FROM lat a JOIN lat b ON b.ix BETWEEN a.ix - 1 AND a.ix + 1 AND b.iy BETWEEN a.iy - 1 AND a.iy + 1 AND b.iz BETWEEN a.iz - 1 AND a.iz + 1 GROUP BY a.node_id HAVING count(*) = 27""")
def win7_plane_fit(spark, sf):
    """Plane-fit gradient over complete 3x3x3 windows from box sums of the field and its moments."""
    n = lattice(spark, sf).select("node_id", "ix", "iy", "iz", F.lit(1).alias("k"), F.col("f").alias("s"), (F.col("f") * F.col("ix")).alias("sx"), (F.col("f") * F.col("iy")).alias("sy"))
    g = stencil.box_sums(n, ["k", "s", "sx", "sy"], 1, gaps=False).where("k = 27")
    fit = lambda a: (F.col(f"s{a}") - F.col("s") * F.col(f"i{a}")) / 18 / 8
    return g.select("node_id", r6(fit("x")).alias("d_ix"), r6(fit("y")).alias("d_iy"))


@query(f"""WITH w(k, g) AS (VALUES (-2, {math.exp(-2.0)!r}), (-1, {math.exp(-0.5)!r}), (0, 1.0), (1, {math.exp(-0.5)!r}), (2, {math.exp(-2.0)!r}))
SELECT a.node_id, {R('sum(g * b.f) FILTER (b.node_valid) / sum(g) FILTER (b.node_valid)')} AS smooth FROM lat a, w JOIN lat b ON true WHERE b.ix = a.ix + w.k AND b.iy = a.iy AND b.iz = a.iz GROUP BY a.node_id""")
def win8_smoothing(spark, sf):
    """Normalised Gaussian smoothing along x that leaves out missing nodes."""
    n = lattice(spark, sf)
    g = {k: math.exp(-k * k / 2) for k in range(-2, 3)}
    v, one = F.when(F.col("node_valid"), F.col("f")), F.when(F.col("node_valid"), F.lit(1.0))
    total = lambda c: sum((F.coalesce(stencil.at(c, "ix", k), F.lit(0.0)) * w for k, w in g.items()), F.lit(0.0))
    out = n.select("node_id", total(v).alias("a"), total(one).alias("b"))
    return out.select("node_id", F.when(F.col("b") > 0, r6(F.col("a") / F.col("b"))).alias("smooth"))


_STENCIL = ((1, 45 / 60), (2, -9 / 60), (3, 1 / 60))


@query(f"""WITH n AS (SELECT a.z, a.y, a.x, lead(v, 1) OVER w AS p1, lag(v, 1) OVER w AS m1, lead(v, 2) OVER w AS p2, lag(v, 2) OVER w AS m2, lead(v, 3) OVER w AS p3, lag(v, 3) OVER w AS m3 FROM vox a WINDOW w AS (PARTITION BY z, y ORDER BY x))
SELECT z, y, x, {R('coalesce((p1 - m1) * 0.75 - (p2 - m2) * 0.15 + (p3 - m3) / 60, 0)')} AS gx FROM n""")
def win9_volume_gradient(spark, sf):
    """Seven-point derivative along x, zero within three voxels of the border."""
    v = voxels(spark, sf)
    w = Window.partitionBy("z", "y").orderBy("x")
    at = lambda k: F.max("v").over(w.rangeBetween(k, k))
    g = sum(((at(k) - at(-k)) * c for k, c in _STENCIL), F.lit(0.0))
    return v.select("z", "y", "x", r6(F.coalesce(g, F.lit(0.0))).alias("gx"))


@query(f"""WITH e AS (SELECT max(iz) AS mz FROM lat), o(d) AS (VALUES (-1), (0), (1)), k AS (SELECT a.node_id, b.node_id AS other, b.f FROM (SELECT lat.*, mz FROM lat, e) a, o p, o q, o r, lat b WHERE NOT (p.d = 0 AND q.d = 0 AND r.d = 0)
 AND b.ix = least(greatest(a.ix + p.d, 0), 9) AND b.iy = least(greatest(a.iy + q.d, 0), 9) AND b.iz = least(greatest(a.iz + r.d, 0), a.mz)),
m AS (SELECT k.node_id, abs(lat.f - list_sort(list(k.f))[14]) AS d FROM k JOIN lat ON lat.node_id = k.node_id GROUP BY k.node_id, lat.f), r AS (SELECT k.node_id, list_sort(list(m.d))[14] AS res FROM k JOIN m ON m.node_id = k.other GROUP BY k.node_id)
SELECT node_id, {R('d / (res + 0.1)')} AS residual, d / (res + 0.1) > 2 AS outlier FROM m JOIN r USING (node_id)""")
def win10_median_test(spark, sf):
    """Universal median test on 26 neighbours, edges repeating the nearest node; the upper middle value. A node's distance from
    its neighbours' median is held against the median of its neighbours' own distances."""
    n = lattice(spark, sf).select("node_id", "ix", "iy", "iz", "f")
    n = n.crossJoin(F.broadcast(n.agg(F.max("iz").alias("mz"))))

    def around(v, low, last, none):
        """What the 26 places around every place of a dense box hold, edges repeating the nearest place."""
        held = np.pad(v, 1, constant_values=none)  # from low - 1 on
        held = held[np.ix_(*[np.clip(np.clip(np.arange(a - 1, a + n + 1), 0, hi) - a + 1, 0, n + 1) for a, n, hi in zip(low, v.shape, last)])]
        return np.stack([held[tuple(slice(k, k + n) for k, n in zip(c, v.shape))] for c in np.ndindex((3, 3, 3)) if c != (1, 1, 1)], -1)

    def middle(v, low, last):
        near = around(v, low, last, np.nan)
        near.partition(13, axis=-1)  # absent ones come last
        return near[..., 13]

    def judge(frame, box):
        low, last = frame[["ix", "iy", "iz"]].min().to_numpy(int), (9, 9, int(frame["mz"].iloc[0]))
        v = np.where(box.columns["there"], box.columns["f"], np.nan)
        d = np.abs(v - middle(v, low, last))
        q = d / (middle(d, low, last) + 0.1)
        judged = box.own & around(box.columns["there"], low, last, False).any(-1).ravel()[box.at]
        return pd.DataFrame({"node_id": frame["node_id"].to_numpy()[judged], "q": q.ravel()[box.at[judged]]})

    schema = StructType([n.schema["node_id"], StructField("q", DoubleType())])
    done = schwarz.boxed(n, [], schwarz.SIZE, 2, ["f"], judge, schema)
    q = F.when(~F.isnan("q"), F.col("q"))
    return done.select("node_id", r6(q).alias("residual"), (q > 2).alias("outlier"))


# ---- sorts, limits, samples ----


@query("""WITH s AS (SELECT p_partkey AS box_id, CAST(i AS BIGINT) AS i, CAST(least(16 + i * 16, p_size + 20) AS BIGINT) AS size FROM part, range(8) t(i)), d AS (SELECT *, lag(size) OVER (PARTITION BY box_id ORDER BY i) AS before FROM s) SELECT box_id, i, size FROM d WHERE before IS NULL OR size > before""")
def top1_size_schedule(spark, sf):
    """Sizes that grow by a step until the box's edge stops them."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("box_id"), (F.col("p_size") + 20).alias("edge"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("i"))
    s = p.select("box_id", "i", F.least(16 + F.col("i") * 16, F.col("edge")).cast("long").alias("size"))
    return s.withColumn("before", F.lag("size").over(Window.partitionBy("box_id").orderBy("i"))).where("before is null or size > before").drop("before")


@query("""WITH t AS (SELECT box_id, CAST(a AS BIGINT) AS lo, row_number() OVER (PARTITION BY box_id ORDER BY a) - 1 AS k, count(*) OVER (PARTITION BY box_id) AS n FROM (SELECT p_partkey AS box_id, x * 8 AS a FROM part, range(10) t(x) WHERE x * 8 + 8 <= p_size + 10))
SELECT box_id, lo FROM t WHERE n <= 3 OR k = 0 OR k = (n - 1) // 2 OR k = n - 1""")
def top2_tile_positions(spark, sf):
    """Three evenly picked tiles of each box (the feature is the pick)."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("box_id"), (F.col("p_size") + 10).alias("edge"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("k"))
    t = p.where("k * 8 + 8 <= edge").withColumn("n", F.count("*").over(Window.partitionBy("box_id")))
    return t.where("n <= 3 or k = 0 or k = (n - 1) div 2 or k = n - 1").select("box_id", (F.col("k") * 8).alias("lo"))


@query(f"""SELECT p_partkey AS box_id, CAST(least(96, greatest(8, ceil(3 * p_size / 2.0 / 2) * 2)) AS BIGINT) AS edge, CAST(greatest(1, floor(least(96, greatest(8, ceil(3 * p_size / 2.0 / 2) * 2)) / 4)) AS BIGINT) AS step, CASE WHEN ceil(3 * p_size / 2.0 / 2) * 2 > 96 THEN 'clamped' WHEN p_size < 5 THEN 'raised' ELSE '' END AS note FROM part""")
def top4_recommendation(spark, sf):
    """An even subset edge from the correlation length, its step, and what was clamped."""
    even = F.ceil(3 * F.col("p_size") / 2.0 / 2) * 2
    edge = F.least(F.lit(96), F.greatest(F.lit(8), even))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("box_id"), edge.cast("long").alias("edge"), F.greatest(F.lit(1), F.floor(edge / 4)).cast("long").alias("step"), F.when(even > 96, "clamped").when(F.col("p_size") < 5, "raised").otherwise("").alias("note"))


@query(f"SELECT iz AS block, CAST(arg_max(node_id, f) AS BIGINT) AS peak, {R('max(f)')} AS value, arg_max(ix IN (0, 9) OR iy IN (0, 9), f) AS clipped FROM lat GROUP BY iz")
def top5_peak(spark, sf):
    """The peak of each layer's map, and whether it lies on its border."""
    return lattice(spark, sf).groupBy(F.col("iz").alias("block")).agg(F.max_by("node_id", "f").alias("peak"), r6(F.max("f")).alias("value"), F.max_by(F.col("ix").isin(0, 9) | F.col("iy").isin(0, 9), F.col("f")).alias("clipped"))


@query("SELECT node_id FROM (SELECT node_id, row_number() OVER (PARTITION BY iz ORDER BY node_id) - 1 AS k FROM lat WHERE ix % 2 = 0 AND iy % 2 = 0 AND iz % 2 = 0) WHERE k % 3 = 0")
def top6_thinning(spark, sf):
    """Nodes for arrows: every second per axis, then every third of a layer."""
    n = lattice(spark, sf).where("ix % 2 = 0 and iy % 2 = 0 and iz % 2 = 0")
    return n.withColumn("k", F.row_number().over(Window.partitionBy("iz").orderBy("node_id")) - 1).where("k % 3 = 0").select("node_id")


# ---- functions ----

_H_SQL = "h AS (SELECT node_id, frame, u / 50 AS h11, v / 40 AS h12, w / 30 AS h13, (v - w) / 50 AS h21, u / 60 AS h22, w / 45 AS h23, w / 70 AS h31, v / 55 AS h32, (u - v) / 65 AS h33 FROM meas)"


def _h(spark, sf):
    u, v, w = F.col("u"), F.col("v"), F.col("w")
    h = {"h11": u / 50, "h12": v / 40, "h13": w / 30, "h21": (v - w) / 50, "h22": u / 60, "h23": w / 45, "h31": w / 70, "h32": v / 55, "h33": (u - v) / 65}
    return measurements(spark, sf).select("node_id", "frame", *[c.alias(n) for n, c in h.items()])


@query(f"""WITH {_H_SQL} SELECT node_id, frame, {R('(h12 + h21) / 2')} AS inf_xy, {R('((1 + h11) * (1 + h11) + h21 * h21 + h31 * h31 - 1) / 2')} AS gl_xx, {R('((1 + h11) * h12 + h21 * (1 + h22) + h31 * h32) / 2')} AS gl_xy FROM h""")
def fn1_strain_tensors(spark, sf):
    t = st.tensor()
    return _h(spark, sf).select("node_id", "frame", r6(st.infinitesimal(t)[0][1]).alias("inf_xy"), r6(st.green_lagrange(t)[0][0]).alias("gl_xx"), r6(st.green_lagrange(t)[0][1]).alias("gl_xy"))


@query(f"""WITH {_H_SQL}, e AS (SELECT node_id, frame, h11 AS a, h22 AS b, h33 AS c, (h12 + h21) / 2 AS d, (h13 + h31) / 2 AS e, (h23 + h32) / 2 AS f FROM h), q AS (SELECT *, (a + b + c) / 3 AS m FROM e),
p AS (SELECT *, sqrt(((a-m)*(a-m) + (b-m)*(b-m) + (c-m)*(c-m) + 2*d*d + 2*e*e + 2*f*f) / 6) AS p, (a-m)*((b-m)*(c-m) - f*f) - d*(d*(c-m) - f*e) + e*(d*f - (b-m)*e) AS det FROM q),
r AS (SELECT *, acos(greatest(-1, least(1, CASE WHEN p > 0 THEN det / (p*p*p) / 2 ELSE 1 END))) / 3 AS phi FROM p)
SELECT node_id, frame, {R('m + 2 * p * cos(phi)')} AS e1, {R('m + 2 * p * cos(phi + 4 * pi() / 3)')} AS e2, {R('m + 2 * p * cos(phi + 2 * pi() / 3)')} AS e3 FROM r""")
def fn2_principal_strains(spark, sf):
    p = st.principal(st.infinitesimal(st.tensor()))
    return _h(spark, sf).select("node_id", "frame", *[r6(c).alias(f"e{k}") for k, c in enumerate(p, 1)])


@query(f"""WITH {_H_SQL}, e AS (SELECT *, (h11 + h22 + h33) / 3 AS m FROM h) SELECT node_id, frame, {R('h11 + h22 + h33')} AS volumetric,
{R('sqrt(2.0/3 * ((h11-m)*(h11-m) + (h22-m)*(h22-m) + (h33-m)*(h33-m) + (h12+h21)*(h12+h21)/2 + (h13+h31)*(h13+h31)/2 + (h23+h32)*(h23+h32)/2))')} AS von_mises,
{R('(1+h11)*((1+h22)*(1+h33) - h23*h32) - h12*(h21*(1+h33) - h23*h31) + h13*(h21*h32 - (1+h22)*h31)')} AS det_f FROM e""")
def fn3_invariants(spark, sf):
    e, f = st.infinitesimal(st.tensor()), st.deformation(st.tensor())
    return _h(spark, sf).select("node_id", "frame", r6(st.volumetric(e)).alias("volumetric"), r6(st.von_mises(e)).alias("von_mises"), r6(st.det(f)).alias("det_f"))


@query(f"WITH {_H_SQL} SELECT node_id, frame, {R('h12 * 0.5 / 2.0')} AS f12, {R('h21 * 2.0 / 0.5')} AS f21 FROM h")
def fn5_physical_scaling(spark, sf):
    """Gradients in physical units for voxel edges of 0.5 and 2."""
    s = {"1": 0.5, "2": 2.0}
    return _h(spark, sf).select("node_id", "frame", *[r6(F.col(f"h{i}{j}") * s[i] / s[j]).alias(f"f{i}{j}") for i, j in ("12", "21")])


@query(f"""WITH n AS (SELECT *, CASE WHEN node_valid THEN f END AS g FROM lat), d AS (SELECT node_id, node_valid,
 max(g) OVER (PARTITION BY iy, iz ORDER BY ix RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS lx, max(g) OVER (PARTITION BY iy, iz ORDER BY ix RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS hx,
 max(g) OVER (PARTITION BY ix, iz ORDER BY iy RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS ly, max(g) OVER (PARTITION BY ix, iz ORDER BY iy RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS hy,
 max(g) OVER (PARTITION BY ix, iy ORDER BY iz RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS lz, max(g) OVER (PARTITION BY ix, iy ORDER BY iz RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS hz FROM n)
SELECT node_id, {R('(hx - lx) / 16')} AS exx, {R('(hy - ly) / 32')} AS exy FROM d WHERE node_valid AND lx IS NOT NULL AND hx IS NOT NULL AND ly IS NOT NULL AND hy IS NOT NULL AND lz IS NOT NULL AND hz IS NOT NULL""")
def fn6_strain_of_frame(spark, sf):
    """Strain from finite differences at nodes whose neighbours all have values."""
    g = stencil.gradient(lattice(spark, sf), "f", "node_valid", 8.0).where("complete")
    return g.select("node_id", r6("d_ix").alias("exx"), r6(F.col("d_iy") / 2).alias("exy"))


@query(f"""WITH j AS (SELECT m.*, l.x FROM meas m JOIN lat l USING (node_id)), k AS (SELECT frame, regr_slope(u, x) AS s, regr_intercept(u, x) AS o FROM j GROUP BY frame) SELECT node_id, frame, {R('u - s * x - o')} AS residual FROM j JOIN k USING (frame)""")
def fn7_remove_motion(spark, sf):
    """A fitted motion removed from every node of its frame."""
    j = measurements(spark, sf).join(lattice(spark, sf).select("node_id", "x"), "node_id")
    fit = j.groupBy("frame").agg(F.regr_slope("u", "x").alias("s"), F.regr_intercept("u", "x").alias("o"))
    return j.join(F.broadcast(fit), "frame").select("node_id", "frame", r6(F.col("u") - F.col("s") * F.col("x") - F.col("o")).alias("residual"))


@query(f"WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 10 AS t FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {R('-0.5*t + t*t - 0.5*t*t*t')} AS k0, {R('1 - 2.5*t*t + 1.5*t*t*t')} AS k1, {R('(1-t)*(1-t)*(1-t)/6')} AS b0, {R('t*t*t/6')} AS b3 FROM t")
def fn8_interpolation_weights(spark, sf):
    """Keys cubic and cubic B-spline weights of a fraction."""
    t = F.col("l_discount") * 10
    out = {"k0": -0.5 * t + t * t - 0.5 * t * t * t, "k1": 1 - 2.5 * t * t + 1.5 * t * t * t, "b0": (1 - t) * (1 - t) * (1 - t) / 6, "b3": t * t * t / 6}
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[r6(c).alias(n) for n, c in out.items()])


@query(f"SELECT node_id, {R('x + 1.5 + 0.02 * (x - 56) + 0.01 * (y - 60)')} AS wx, {R('y - 0.5 + 0.015 * (z - 100)')} AS wy FROM lat")
def fn9_warp(spark, sf):
    """Affine warp of points about a centre."""
    dx, dy, dz = F.col("x") - 56, F.col("y") - 60, F.col("z") - 100
    return lattice(spark, sf).select("node_id", r6(F.col("x") + 1.5 + 0.02 * dx + 0.01 * dy).alias("wx"), r6(F.col("y") - 0.5 + 0.015 * dz).alias("wy"))


@query(f"""WITH p AS (SELECT p_partkey, (p_partkey % 30) / 2.0 AS r, 2.0 + p_size % 9 AS a, 0.1 + (p_partkey % 7) / 10.0 AS phi FROM part), k AS (SELECT *, CASE WHEN r < 2*a THEN 1 - 0.75 * r / a + r*r*r / (16*a*a*a) ELSE 0 END AS g, -ln(1 - phi) AS nv FROM p)
SELECT p_partkey, {R('((1 - phi) * (1 - phi) * exp(nv * g) - (1 - phi) * (1 - phi)) / (phi * (1 - phi))')} AS rho FROM k""")
def fn10_boolean_correlation(spark, sf):
    """Correlation at distance r of a Boolean model of spheres with a given volume fraction."""
    p = table(spark, sf, "part")
    r, a, phi = (F.col("p_partkey") % 30) / 2.0, 2.0 + F.col("p_size") % 9, 0.1 + (F.col("p_partkey") % 7) / 10.0
    g = F.when(r < 2 * a, 1 - 0.75 * r / a + r * r * r / (16 * a * a * a)).otherwise(0.0)
    solid = (1 - phi) * (1 - phi)
    return p.select("p_partkey", r6((solid * F.exp(-F.log(1 - phi) * g) - solid) / (phi * (1 - phi))).alias("rho"))


@query("SELECT p_partkey AS sample_id, CAST(pow((2 * (p_size // 2)) // (1 + p_partkey % 3) + 1, 3) AS BIGINT) AS n FROM part")
def fn11_subset_count(spark, sf):
    """Voxels sampled in a subset of half width w div 2 from one end to the other at a stride."""
    n, _ = precision.moments(F.expr("p_size div 2"), 1 + F.col("p_partkey") % 3)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("sample_id"), (n * n * n).cast("long").alias("n"))


@query(f"SELECT node_id, {R('0.02 * (x - 56) + 0.01 * (y - 60) + 1.7')} AS u_affine, {R('cos(0.0872664625997165) * (x - 56) - sin(0.0872664625997165) * (y - 60) - (x - 56)')} AS u_rotation, {R('sin(2 * pi() * x / 80)')} AS u_sinus, CAST(CASE WHEN x < 56 THEN -1.5 ELSE 1.5 END AS DOUBLE) AS u_bodies FROM lat")
def fn12_analytic_fields(spark, sf):
    """Displacements known in closed form, as truth for error statistics."""
    dx, dy, a = F.col("x") - 56, F.col("y") - 60, math.radians(5)
    return lattice(spark, sf).select("node_id", r6(0.02 * dx + 0.01 * dy + 1.7).alias("u_affine"), r6(math.cos(a) * dx - math.sin(a) * dy - dx).alias("u_rotation"), r6(F.sin(2 * math.pi * F.col("x") / 80)).alias("u_sinus"), F.when(F.col("x") < 56, -1.5).otherwise(1.5).alias("u_bodies"))


# ---- lines, gauges, trajectories ----

_LINE_SQL = "WITH pts AS (SELECT c_custkey * 100 + i AS pid, i / 19.0 * 9 AS gx, i / 19.0 * (c_custkey % 10) AS gy, i / 19.0 * (c_custkey % 13) AS gz FROM customer, range(20) t(i))"


@query(f"""{_LINE_SQL}, cor AS (SELECT pid, floor(gx) + a AS ix, floor(gy) + b AS iy, floor(gz) + c AS iz, (CASE WHEN a = 1 THEN gx - floor(gx) ELSE 1 - (gx - floor(gx)) END) * (CASE WHEN b = 1 THEN gy - floor(gy) ELSE 1 - (gy - floor(gy)) END) * (CASE WHEN c = 1 THEN gz - floor(gz) ELSE 1 - (gz - floor(gz)) END) AS w FROM pts, range(2) p(a), range(2) q(b), range(2) r(c)),
g AS (SELECT pid, sum(w * f) AS s, sum(w) AS k FROM cor JOIN lat USING (ix, iy, iz) WHERE w > 0 GROUP BY pid)
SELECT pts.pid // 100 AS line, pts.pid % 100 AS i, CASE WHEN k > 1 - 1e-9 THEN {R('s')} END AS value FROM pts LEFT JOIN g ON g.pid = pts.pid""")
def trj1_line_samples(spark, sf):
    """A field sampled at twenty points of a line for each customer's end point."""
    p = table(spark, sf, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("i"))
    t = F.col("i") / 19.0
    p = p.select(F.col("c_custkey").alias("line"), "i", (t * 9).alias("gx"), (t * (F.col("c_custkey") % 10)).alias("gy"), (t * (F.col("c_custkey") % 13)).alias("gz"))
    return _sample(p, _cells(lattice(spark, sf))).select("line", "i", F.when(F.col("cover") > 1 - 1e-9, r6("s")).alias("value"))


@query(f"""WITH g AS (SELECT a.node_id // 10 AS gauge, frame FROM lat a JOIN lat b ON b.node_id = a.node_id + 9, (SELECT DISTINCT frame FROM meas) f WHERE a.node_id % 10 = 0),
j AS (SELECT g.gauge, g.frame, sqrt((72 + b.u - a.u) * (72 + b.u - a.u) + (b.v - a.v) * (b.v - a.v) + (b.w - a.w) * (b.w - a.w)) AS len FROM g LEFT JOIN meas a ON a.node_id = g.gauge * 10 AND a.frame = g.frame LEFT JOIN meas b ON b.node_id = g.gauge * 10 + 9 AND b.frame = g.frame)
SELECT gauge, frame, {R('len')} AS length, {R('len / 72 - 1')} AS strain FROM j""")
def trj2_extensometer(spark, sf):
    """Displaced length of every grid line's end points, and its strain; null in frames that miss an end."""
    m = measurements(spark, sf)
    n = lattice(spark, sf).select("node_id")
    gauges = n.where("node_id % 10 = 0").select(F.expr("node_id div 10").alias("gauge")).join(n.where("node_id % 10 = 9").select(F.expr("node_id div 10").alias("gauge")), "gauge")
    every = gauges.crossJoin(F.broadcast(m.agg(F.collect_set("frame").alias("frames")))).select("gauge", F.explode("frames").alias("frame"))
    # one pass: both ends of a gauge meet in one aggregate
    at = lambda k, c: F.max(F.when(F.col("node_id") % 10 == k, F.col(c)))
    ends = m.where(F.col("node_id") % 10 % 9 == 0).groupBy(F.expr("node_id div 10").alias("gauge"), "frame").agg(*[(at(9, c) - at(0, c)).alias(c) for c in "uvw"])
    j = every.join(ends, ["gauge", "frame"], "left")
    length = F.sqrt((72 + F.col("u")) * (72 + F.col("u")) + F.col("v") * F.col("v") + F.col("w") * F.col("w"))
    return j.select("gauge", "frame", r6(length).alias("length"), r6(length / 72 - 1).alias("strain"))


@query(f"""WITH a AS (SELECT l.node_id, l.iy, l.iz, l.ix + 0.125 * l.f AS g FROM lat l), q AS (SELECT *, CAST(least(greatest(floor(g), 0), 8) AS BIGINT) AS i FROM a)
SELECT q.node_id, {R('(g - q.ix0) * 8 + (1 - (g - i)) * b.f + (g - i) * c.f')} AS u_total FROM (SELECT q.*, l.ix AS ix0 FROM q JOIN lat l USING (node_id)) q JOIN lat b ON b.ix = q.i AND b.iy = q.iy AND b.iz = q.iz JOIN lat c ON c.ix = q.i + 1 AND c.iy = q.iy AND c.iz = q.iz""")
def trj3_cumulative(spark, sf):
    """Two pairs composed: the second is read where the first has moved each node."""
    n = lattice(spark, sf)
    q = n.select("node_id", "iy", "iz", F.col("ix").alias("ix0"), (F.col("ix") + 0.125 * F.col("f")).alias("g")).withColumn("ix", F.least(F.greatest(F.floor("g"), F.lit(0)), F.lit(8)))
    t = F.col("g") - F.col("ix")
    b = n.select("ix", "iy", "iz", F.col("f").alias("b"), stencil.at("f", "ix", 1).alias("c"))
    return q.join(b, ["ix", "iy", "iz"]).select("node_id", r6((F.col("g") - F.col("ix0")) * 8 + (1 - t) * F.col("b") + t * F.col("c")).alias("u_total"))


@query(f"""SELECT a.node_id, {R('26 * a.f - sum(b.f)')} AS au FROM lat a JOIN lat b ON b.ix BETWEEN a.ix - 1 AND a.ix + 1 AND b.iy BETWEEN a.iy - 1 AND a.iy + 1 AND b.iz BETWEEN a.iz - 1 AND a.iz + 1 AND b.node_id <> a.node_id GROUP BY a.node_id, a.f HAVING count(*) = 26""")
def job8_stencil_product(spark, sf):
    """A 27-point stencil matrix times a node vector, inside the grid, from box sums."""
    n = lattice(spark, sf).select("node_id", "ix", "iy", "iz", "f", F.lit(1).alias("k"), F.col("f").alias("s"))
    return stencil.box_sums(n, ["k", "s"], 1, gaps=False).where("k = 27").select("node_id", r6(27 * F.col("f") - F.col("s")).alias("au"))


@query(f"""SELECT a.vec_id, {R('corr(a.v, b.v)')} AS zncc FROM vox a JOIN vox b ON b.x = a.x + 1 AND b.y = a.y AND b.z = a.z GROUP BY a.vec_id""")
def job11_zncc_of_shift(spark, sf):
    """Correlation of every brick with what lies one voxel further along x."""
    v = voxels(spark, sf)
    b = v.select((F.col("x") - 1).alias("x"), "y", "z", F.col("v").alias("w"))
    return v.join(b, ["x", "y", "z"]).groupBy("vec_id").agg(r6(F.corr("v", "w")).alias("zncc"))


@query(f"""SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, {R('avg(value)')} AS mean, {R('stddev_pop(value)')} AS std, {R('min(value)')} AS min, {R('max(value)')} AS max FROM events GROUP BY ALL""")
def str4_running_statistics(spark, sf):
    """Tumbling day statistics of readings: the same plan runs as a stream."""
    from ..streaming.statistics import running

    s = running(table(spark, sf, "events"), "ts", "value", "event_type", "1 day")
    return s.select("event_type", F.to_date("start").alias("day"), "n", *[r6(c).alias(c) for c in ("mean", "std", "min", "max")])
