"""Queries of stored summaries, sliding windows, sweeps and overviews."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import stats
from ..operators.texture import crossings, plateau
from ..sources.views import lattice, measurements, table, voxels
from .registry import R, query, r6


@query(f"""WITH s AS (SELECT frame, 'u' AS field, u AS v FROM meas UNION ALL SELECT frame, 'v', v FROM meas UNION ALL SELECT frame, 'w', w FROM meas)
SELECT frame + 1 AS frame, field, count(v) AS n, {R('avg(v)')} AS mean, {R('stddev_pop(v)')} AS std, {R('quantile_cont(v, 0.5)')} AS median FROM s GROUP BY frame, field""")
def snk3_statistics_table(spark, sf):
    """What the statistics files hold, flattened: one-based frames, a row a field."""
    s = stats.unpivot(measurements(spark, sf).select("frame", "u", "v", "w"), ["frame"], ["u", "v", "w"])
    a = stats.summarize(s, "value", "frame", "field")
    return a.select((F.col("frame") + 1).alias("frame"), "field", "n", *[r6(c).alias(c) for c in ("mean", "std", "median")])


@query("SELECT frame, '{\"frame\":' || frame || ',\"nodes\":' || count(*) || ',\"converged\":' || count(*) FILTER (status = 0) || '}' AS summary FROM meas GROUP BY frame")
def snk4_json_summary(spark, sf):
    """A JSON object a frame."""
    a = measurements(spark, sf).groupBy("frame").agg(F.count("*").alias("nodes"), F.count(F.when(F.col("status") == 0, 1)).alias("converged"))
    return a.select("frame", F.to_json(F.struct("frame", "nodes", "converged")).alias("summary"))


def _sliding_windows(v):
    """(x0, y0, z0, lag, pairs, rho) of every window of 12 x 12 x 8 voxels on the brick grid whose partners along x, up to
    lag 6, lie in the volume. Sums are taken once a cell of 4 x 4 x 4, and windows add up their cells."""
    v = v.where("v is not null")
    right = v.select(F.explode(F.sequence(F.lit(0), F.lit(6))).alias("h"), "x", "y", "z", F.col("v").alias("o")).withColumn("x", F.col("x") - F.col("h"))
    own = [F.expr(f"{a} div 4 * 4").alias(f"c{a}") for a in "xyz"]
    o = F.col("o")
    cells = v.join(right, ["x", "y", "z"]).groupBy("h", *own).agg(F.count("*").alias("n"), F.sum("v").alias("a"), F.sum(o).alias("b"), F.sum(F.col("v") * o).alias("ab"))
    top = v.agg(F.max(F.expr("z div 4 * 4")).alias("top"))
    back = F.explode(F.array(*[F.struct(*[F.lit(-4 * k).alias(f"d{a}") for a, k in zip("xyz", (i, j, k))]) for i in range(3) for j in range(3) for k in range(2)])).alias("d")
    parts = cells.select("*", back).select("h", "n", "a", "b", "ab", *[(F.col(f"c{a}") + F.col(f"d.d{a}")).alias(f"{a}0") for a in "xyz"])
    parts = parts.where("x0 between 0 and 12 and y0 between 0 and 20 and z0 >= 0").crossJoin(F.broadcast(top)).where("z0 = 0 or z0 + 4 <= top")
    w = parts.groupBy("x0", "y0", "z0", "h").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "ab")])
    m = w.where("h = 0").select("x0", "y0", "z0", (F.col("a") / F.col("n")).alias("mu"), (F.col("ab") / F.col("n") - F.col("a") * F.col("a") / (F.col("n") * F.col("n"))).alias("var"))
    c = F.col("ab") / F.col("n") - F.col("mu") * (F.col("a") + F.col("b")) / F.col("n") + F.col("mu") * F.col("mu")
    return w.join(m, ["x0", "y0", "z0"]).select("x0", "y0", "z0", F.col("h").cast("long").alias("lag"), F.col("n").alias("pairs"), r6(F.when(F.col("var") > 0, c / F.col("var"))).alias("rho"))


@query(f"""WITH p AS (SELECT x, y, z, h, v AS a, x + h AS xr FROM vox, range(0, 7) t(h)), q AS (SELECT p.x, p.y, p.z, h, a, r.v AS b FROM p JOIN vox r ON r.x = p.xr AND r.y = p.y AND r.z = p.z),
w AS (SELECT (x // 4) * 4 - 4 * i AS x0, (y // 4) * 4 - 4 * j AS y0, (z // 4) * 4 - 4 * k AS z0, h, a, b FROM q, range(3) c(i), range(3) d(j), range(2) e(k)),
f AS (SELECT w.* FROM w, (SELECT max(z // 4 * 4) AS top FROM vox) WHERE x0 BETWEEN 0 AND 12 AND y0 BETWEEN 0 AND 20 AND z0 >= 0 AND (z0 = 0 OR z0 + 4 <= top)),
m AS (SELECT x0, y0, z0, avg(a) AS mu, var_pop(a) AS s2 FROM f WHERE h = 0 GROUP BY ALL)
SELECT x0, y0, z0, CAST(h AS BIGINT) AS lag, count(*) AS pairs, CASE WHEN any_value(s2) > 0 THEN {R('avg((a - mu) * (b - mu)) / any_value(s2)')} END AS rho FROM f JOIN m USING (x0, y0, z0) GROUP BY x0, y0, z0, h""")
def agg16_sliding_window(spark, sf):
    """Windows over the whole volume, each against the voxels around it: every lag of a window has the same number of pairs."""
    return _sliding_windows(voxels(spark, sf))


@query(f"""WITH v AS (SELECT z // 4 AS box, x, y, z, v FROM vox), m AS (SELECT box, avg(v) AS mu FROM v GROUP BY box), d AS (SELECT v.box, x, y, z, v.v - mu AS d FROM v JOIN m USING (box)),
p AS (SELECT box, h, x + h AS x, y, z, d FROM d, range(0, 9) t(h)), s AS (SELECT p.box, h AS lag, avg(p.d * r.d) AS c FROM p JOIN d r USING (box, x, y, z) GROUP BY p.box, h),
y AS (SELECT box, lag, c / first_value(c) OVER (PARTITION BY box ORDER BY lag) AS y FROM s), n AS (SELECT y.*, t, lead(y) OVER w AS y1, lag(y) OVER w AS y0 FROM y, (VALUES (0.5), (0.2)) k(t) WINDOW w AS (PARTITION BY box, t ORDER BY lag)),
c AS (SELECT box, t, min(lag) AS i FROM n WHERE y >= t AND y1 < t GROUP BY box, t)
SELECT b.box, CAST(b.t AS DOUBLE) AS threshold, {R('CASE WHEN n.y = n.t THEN n.lag ELSE n.lag + (n.y - n.t) / (n.y - n.y1) END')} AS value, CASE WHEN n.lag IS NULL THEN 'not_crossed' WHEN n.y = n.t AND n.y0 = n.t THEN 'plateau' ELSE 'crossed' END AS status
FROM (SELECT DISTINCT box, t FROM n) b LEFT JOIN c USING (box, t) LEFT JOIN n ON n.box = c.box AND n.t = c.t AND n.lag = c.i""")
def agg17_texture_of_boxes(spark, sf):
    """Correlation length along x of every layer of bricks: autocorrelation, profile and crossing over a table of boxes."""
    v = voxels(spark, sf).withColumn("box", F.expr("z div 4"))
    d = v.join(v.groupBy("box").agg(F.avg("v").alias("mu")), "box").select("box", "x", "y", "z", (F.col("v") - F.col("mu")).alias("d"))
    right = d.select("box", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("lag"), "x", "y", "z", F.col("d").alias("e")).withColumn("x", F.col("x") - F.col("lag"))
    s = d.join(right, ["box", "x", "y", "z"]).groupBy("box", "lag").agg(F.avg(F.col("d") * F.col("e")).alias("c"))
    y = F.col("c") / F.first("c").over(Window.partitionBy("box").orderBy("lag"))
    out = crossings(s.select("box", "lag", y.alias("y")), (0.5, 0.2), "box")
    return out.select("box", "threshold", r6("value").alias("value"), "status")


@query(f"""WITH lv AS (SELECT p_brand || '/' || (p_partkey % 2) AS g, CAST(p_size AS BIGINT) AS size, avg(p_retailprice) AS mean, stddev_pop(p_retailprice) AS spread FROM part GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY size DESC) AS k FROM lv), ref AS (SELECT g, avg(mean) AS reference, 150 + 0.05 * abs(avg(mean)) AS tol FROM r WHERE k <= 3 GROUP BY g),
c AS (SELECT lv.*, reference, tol, max(abs(mean - reference)) OVER (PARTITION BY g ORDER BY size ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS worst, max(size) OVER (PARTITION BY g) AS top FROM lv JOIN ref USING (g))
SELECT g, {R('reference')} AS reference, min(size) FILTER (worst <= tol AND top >= 1.2 * size AND spread <= tol) AS settled FROM c GROUP BY g, reference, tol""")
def top3_size_sweep(spark, sf):
    """Lengths at every size and position gathered to levels, and the size that settles for each threshold."""
    p = table(spark, sf, "part").select(F.concat("p_brand", F.lit("/"), F.col("p_partkey") % 2).alias("g"), F.col("p_size").cast("long").alias("size"), "p_retailprice")
    lv = p.groupBy("g", "size").agg(F.avg("p_retailprice").alias("mean"), F.stddev_pop("p_retailprice").alias("spread"))
    return plateau(lv, "g", 3, 150.0, 0.05, 1.2).select("g", r6("reference").alias("reference"), "settled")


@query(f"""WITH j AS (SELECT m.frame, m.u, l.ix, l.node_valid FROM meas m JOIN lat l USING (node_id) WHERE l.node_valid)
SELECT frame, 'layer' AS part, CAST(ix AS VARCHAR) AS key, count(*) AS n, {R('avg(u)')} AS value FROM j GROUP BY frame, ix
UNION ALL SELECT frame, 'all', '', count(*), {R('avg(u)')} FROM j GROUP BY frame UNION ALL SELECT frame, 'spread', '', count(*), {R('stddev_pop(u)')} FROM j GROUP BY frame""")
def agg27_overview(spark, sf):
    """Layer profile, mean and spread of every frame in one table, from one pass by grouping sets."""
    j = measurements(spark, sf).join(lattice(spark, sf).where("node_valid").select("node_id", "ix"), "node_id")
    g = j.rollup("frame", "ix").agg(F.grouping("ix").alias("whole"), F.grouping("frame").alias("every"), F.count("*").alias("n"), F.avg("u").alias("m"), F.stddev_pop("u").alias("s")).where("every = 0")
    kinds = F.when(F.col("whole") == 0, F.array(F.struct(F.lit("layer").alias("part"), F.col("m").alias("x")))).otherwise(F.array(F.struct(F.lit("all").alias("part"), F.col("m").alias("x")), F.struct(F.lit("spread").alias("part"), F.col("s").alias("x"))))
    return g.select("frame", "ix", "n", F.explode(kinds).alias("k")).select("frame", F.col("k.part").alias("part"), F.coalesce(F.col("ix").cast("string"), F.lit("")).alias("key"), "n", r6("k.x").alias("value"))


def user_field(nodes, fn, names=("u", "v", "w")):
    """Displacements of a caller's fn(x, y, z) -> three arrays, evaluated on Arrow batches."""

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(names, fn(x.to_numpy(), y.to_numpy(), z.to_numpy()))))

    return nodes.withColumn("_d", run("x", "y", "z")).select(*nodes.columns, "_d.*")


@query(f"SELECT node_id, {R('0.01 * x + 0.5')} AS u, {R('0.02 * y')} AS v, {R('z * 0.0 - 1')} AS w FROM lat")
def udf1_user_displacement(spark, sf):
    n = user_field(lattice(spark, sf).select("node_id", "x", "y", "z"), lambda x, y, z: (0.01 * x + 0.5, 0.02 * y, 0 * z - 1.0))
    return n.select("node_id", *[r6(c).alias(c) for c in "uvw"])
