"""More modes: volumes of interest, stored regions, drawing, planes, mesh validity, blocks, comparisons, refined peaks."""

from __future__ import annotations

import io
import uuid

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import strain as st
from ..operators import regions as rg
from ..operators import stats, stencil, store
from ..sources import volumes
from ..sources.views import lattice, measurements, table, voxels
from ..streaming import frames
from .fields import _H_SQL, _h, _levels, _LEVELS_SQL, _profiles, _DAYS_SQL
from .nodes import REGIONS, _REGION_SQL, _cells, _sample
from .registry import R, query, r6

_GROW = 16 // 2 + 5 + 6


@query(f"""WITH k AS (SELECT 'mask' AS mask, x, y, z, m AS inside FROM vox UNION ALL SELECT 'whole', x, y, z, true FROM vox UNION ALL SELECT 'empty', x, y, z, false FROM vox UNION ALL SELECT 'bright', x, y, z, v > 0.38 FROM vox),
a AS (SELECT mask, {', '.join(f'min({c}) FILTER (inside) - {_GROW} AS {c}0, max({c}) FILTER (inside) + {_GROW} AS {c}1, max({c}) AS m{c}' for c in 'xyz')}, bool_and(inside) AS whole FROM k GROUP BY mask),
b AS (SELECT mask, whole, {', '.join(f'greatest({c}0, 0) AS {c}0, least({c}1, m{c}) AS {c}1, m{c}' for c in 'xyz')}, x0 IS NULL AS none FROM a)
SELECT mask, {', '.join(f'CASE WHEN NOT none AND NOT whole AND NOT covers THEN {c}{k} END AS {c}{k}' for c in 'xyz' for k in (0, 1))} FROM (SELECT *, {' AND '.join(f'{c}0 = 0 AND {c}1 = m{c}' for c in 'xyz')} AS covers FROM b)""")
def prj2_voi_three_axes(spark, sf):
    """Bounding boxes of masks, grown and clamped in three axes; none for an empty mask or where the box is the whole volume."""
    v = voxels(spark, sf)
    masks = {"mask": F.col("m"), "whole": F.lit(True), "empty": F.lit(False), "bright": F.col("v") > 0.38}
    k = v.select("x", "y", "z", F.explode(F.array(*[F.struct(F.lit(n).alias("mask"), c.alias("inside")) for n, c in masks.items()])).alias("k")).select("x", "y", "z", "k.*")
    inside = lambda c: F.when(F.col("inside"), F.col(c))
    a = k.groupBy("mask").agg(*[e for c in "xyz" for e in (F.greatest(F.min(inside(c)) - _GROW, F.when(F.min(inside(c)).isNotNull(), 0)).alias(f"{c}0"), (F.max(inside(c)) + _GROW).alias(f"{c}1"), F.max(c).alias(f"m{c}"))])
    a = a.withColumns({f"{c}1": F.when(F.col(f"{c}1").isNotNull(), F.least(F.col(f"{c}1"), F.col(f"m{c}"))) for c in "xyz"})
    covers = F.lit(True)
    for c in "xyz":
        covers = covers & (F.col(f"{c}0") == 0) & (F.col(f"{c}1") == F.col(f"m{c}"))
    return a.select("mask", *[F.when(~F.coalesce(covers, F.lit(True)), F.col(f"{c}{k}")).alias(f"{c}{k}") for c in "xyz" for k in (0, 1)])


@query("""WITH s AS (SELECT s_suppkey AS region_id, s_suppkey % 5 AS k, s_acctbal AS r, s_nationkey AS a, s_suppkey % 30 AS b FROM supplier)
SELECT region_id, CASE k WHEN 0 THEN 'box' WHEN 1 THEN 'sphere' WHEN 2 THEN 'cylinder' WHEN 3 THEN 'slab' ELSE 'cone' END AS shape,
 CASE WHEN k = 4 THEN 'unknown shape' WHEN k IN (0, 3) AND b < a THEN 'bounds out of order' WHEN k IN (1, 2) AND r <= 0 THEN 'radius must be positive' WHEN k = 2 AND b < a THEN 'bounds out of order' END AS problem FROM s""")
def prj5_region_shapes(spark, sf):
    """Stored regions of every shape read from JSON, each with what is wrong with it."""
    k = F.col("s_suppkey") % 5
    shape = F.when(k == 0, "box").when(k == 1, "sphere").when(k == 2, "cylinder").when(k == 3, "slab").otherwise("cone")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("region_id"), F.to_json(F.struct(shape.alias("shape"), F.col("s_acctbal").alias("radius"), F.col("s_nationkey").alias("lo"), (F.col("s_suppkey") % 30).alias("hi"))).alias("j"))
    r = s.withColumn("r", F.from_json("j", "shape string, radius double, lo double, hi double")).select("region_id", "r.*")
    round_, flat = F.col("shape").isin("sphere", "cylinder"), F.col("shape").isin("box", "slab", "cylinder")
    problem = F.when(~(round_ | flat), "unknown shape").when(~round_ & (F.col("hi") < F.col("lo")), "bounds out of order").when(round_ & (F.col("radius") <= 0), "radius must be positive").when(flat & (F.col("hi") < F.col("lo")), "bounds out of order")
    return r.select("region_id", "shape", problem.alias("problem"))


_POLYGON = ((4.5, 3.2), (27.1, 9.4), (15.3, 28.6))
_STROKE = ((6.0, 25.0), (12.0, 20.0), (20.0, 24.0))


def _polygon_sql(a: str, b: str) -> str:
    edges = zip(_POLYGON, _POLYGON[1:] + _POLYGON[:1])
    return "(" + " + ".join(f"(CASE WHEN (({b0} > {b}) <> ({b1} > {b})) AND {a} < ({b} - {b0}) * {(a1 - a0) / (b1 - b0)!r} + {a0} THEN 1 ELSE 0 END)" for (a0, b0), (a1, b1) in edges) + ") % 2 = 1"


_BRUSH_SQL = "(" + " OR ".join(f"(y - {p}) * (y - {p}) + (z - {q}) * (z - {q}) <= 6.25" for p, q in _STROKE) + ")"


@query(f"""SELECT n AS undone, count(*) AS voxels, count(*) FILTER (CASE n WHEN 0 THEN (({_polygon_sql('x', 'y')} AND z BETWEEN 2 AND 9) OR ({_BRUSH_SQL})) AND NOT x BETWEEN 14 AND 17 WHEN 1 THEN ({_polygon_sql('x', 'y')} AND z BETWEEN 2 AND 9) OR ({_BRUSH_SQL}) ELSE {_polygon_sql('x', 'y')} AND z BETWEEN 2 AND 9 END) AS inside FROM vox, range(3) t(n) GROUP BY n""")
def prj12_drawing_log(spark, sf):
    """A drawing log folded in order: a polygon over some slices, a brush stroke in another plane, a cut; undo replays it
    without its last operations."""
    spot = F.lit(False)
    for p, q in _STROKE:
        spot = spot | ((F.col("y") - p) * (F.col("y") - p) + (F.col("z") - q) * (F.col("z") - q) <= 6.25)
    log = [("add", rg.Prism("xy", "polygon", _POLYGON, 2, 9).contains()), ("add", spot), ("cut", F.col("x").between(14, 17))]
    masks = []
    for undone in range(3):
        mask = F.lit(False)
        for mode, shape in log[: len(log) - undone]:
            mask = mask | shape if mode == "add" else mask & ~shape
        masks.append(F.struct(F.lit(undone).cast("long").alias("undone"), mask.alias("m")))
    k = voxels(spark, sf).select(F.explode(F.array(*masks)).alias("k"))
    return k.groupBy("k.undone").agg(F.count("*").alias("voxels"), F.count(F.when(F.col("k.m"), 1)).alias("inside"))


@query(f"""WITH s AS (SELECT (max(x) + 1) // 2 AS cx, (max(y) + 1) // 2 AS cy, (max(z) + 1) // 2 AS cz FROM vox),
p AS (SELECT 'xy' AS plane, y AS a, x AS b, v, m FROM vox, s WHERE z = cz UNION ALL SELECT 'xz', z, x, v, m FROM vox, s WHERE y = cy UNION ALL SELECT 'yz', z, y, v, m FROM vox, s WHERE x = cx)
SELECT plane, a // 4 AS row, b // 4 AS col, {R('max(CASE WHEN a % 4 = 0 AND b % 4 = 0 THEN v END)')} AS value, bool_and(m) AS inside FROM p GROUP BY ALL""")
def prj13_three_planes(spark, sf):
    """The middle slices of all three planes, thinned: values by point, the mask only where its whole block is inside."""
    v = voxels(spark, sf)
    mid = v.agg(*[F.expr(f"(max({c}) + 1) div 2").alias(f"c{c}") for c in "xyz"])
    planes = [("xy", "z", "y", "x"), ("xz", "y", "z", "x"), ("yz", "x", "z", "y")]
    on = F.array_compact(F.array(*[F.when(F.col(n) == F.col(f"c{n}"), F.struct(F.lit(p).alias("plane"), F.col(a).alias("a"), F.col(b).alias("b"))) for p, n, a, b in planes]))
    s = v.crossJoin(F.broadcast(mid)).select("v", "m", F.explode(on).alias("p")).select("v", "m", "p.*")
    point = F.when((F.col("a") % 4 == 0) & (F.col("b") % 4 == 0), F.col("v"))
    return s.groupBy("plane", F.expr("a div 4").alias("row"), F.expr("b div 4").alias("col")).agg(r6(F.max(point)).alias("value"), F.bool_and("m").alias("inside"))


@query("""WITH s AS (SELECT max(iz) AS mz FROM lat), c AS (SELECT a.node_id, a.node_valid, a.ix IN (0, 9) OR a.iy IN (0, 9) OR a.iz IN (0, mz) AS surface,
 a.node_valid AND EXISTS (SELECT 1 FROM lat b WHERE NOT b.node_valid AND abs(a.ix - b.ix) + abs(a.iy - b.iy) + abs(a.iz - b.iz) = 1 AND b.iz BETWEEN a.iz - 1 AND a.iz + 1) AS beside,
 EXISTS (SELECT 1 FROM lat b WHERE b.iy = a.iy AND b.iz = a.iz AND ((a.ix = 4 AND b.ix = 5 AND a.f > 2) OR (a.ix = 5 AND b.ix = 4 AND b.f > 2))) AS cut_end FROM lat a, s)
SELECT node_id, surface, beside, cut_end, surface OR beside OR cut_end AS boundary FROM c""")
def prj15_boundary_with_cuts(spark, sf):
    """Boundary nodes: on the grid's surface, beside an invalid node, or at an end of a cut edge."""
    n = lattice(spark, sf)
    top = n.agg(F.max("iz").alias("mz"))
    beside = F.lit(False)
    for a in stencil.AXES:
        for step in (-1, 1):
            beside = beside | F.coalesce(stencil.at((~F.col("node_valid")).cast("int"), a, step) == 1, F.lit(False))
    here, before = F.when(F.col("ix") == 4, F.col("f")), stencil.at(F.when(F.col("ix") == 4, F.col("f")), "ix", -1)
    cut = (F.coalesce(here > 2, F.lit(False)) & stencil.at("f", "ix", 1).isNotNull()) | ((F.col("ix") == 5) & F.coalesce(before > 2, F.lit(False)))
    n = n.withColumns({"beside": F.col("node_valid") & beside, "cut_end": cut}).crossJoin(F.broadcast(top))
    surface = F.col("ix").isin(0, 9) | F.col("iy").isin(0, 9) | (F.col("iz") == 0) | (F.col("iz") == F.col("mz"))
    return n.select("node_id", surface.alias("surface"), "beside", "cut_end", (surface | F.col("beside") | F.col("cut_end")).alias("boundary"))


@query(f"""WITH c AS (SELECT x, y, z, m FROM vox WHERE x % 6 = 3 AND y % 6 = 3 AND z % 6 = 3), f AS (SELECT c.x, c.y, c.z, any_value(c.m) AS centre, count(*) FILTER (v.m) / 343.0 AS fraction FROM c JOIN vox v ON v.x BETWEEN c.x - 3 AND c.x + 3 AND v.y BETWEEN c.y - 3 AND c.y + 3 AND v.z BETWEEN c.z - 3 AND c.z + 3 GROUP BY c.x, c.y, c.z)
SELECT x, y, z, centre, {R('fraction')} AS fraction, centre AND fraction >= 0.5 AS valid FROM f""")
def prj18_valid_subsets(spark, sf):
    """A node is valid if its centre voxel is in the mask and enough of its subset is: box sums over the voxels."""
    v = voxels(spark, sf).select(F.col("x").alias("ix"), F.col("y").alias("iy"), F.col("z").alias("iz"), "m", F.col("m").cast("int").alias("s"))
    s = stencil.box_sums(v, ["s"], 3).where("ix % 6 = 3 and iy % 6 = 3 and iz % 6 = 3").withColumn("fraction", F.col("s") / 343.0)
    return s.select(*[F.col(f"i{a}").alias(a) for a in "xyz"], F.col("m").alias("centre"), r6("fraction").alias("fraction"), (F.col("m") & (F.col("fraction") >= 0.5)).alias("valid"))


@query("""WITH d AS (SELECT node_id, max(greatest(abs(u), abs(v), abs(w))) AS reach FROM meas GROUP BY node_id), b AS (SELECT l.node_id // 100 AS block, 8 + 3 + 4 + CAST(ceil(coalesce(max(d.reach), 0)) AS BIGINT) AS halo, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM lat l LEFT JOIN d USING (node_id) GROUP BY 1)
SELECT block, halo, CAST(bx AS BIGINT) AS bx, CAST(by_ AS BIGINT) AS "by", CAST(bz AS BIGINT) AS bz FROM b, range(8) t(bx), range(8) q(by_), range(3000) s(bz)
WHERE bx BETWEEN floor((x0 - halo) / 64) AND floor((x1 + halo) / 64) AND by_ BETWEEN floor((y0 - halo) / 64) AND floor((y1 + halo) / 64) AND bz BETWEEN floor((z0 - halo) / 64) AND floor((z1 + halo) / 64)""")
def join5_blocks_with_halo(spark, sf):
    """Bricks of each block of nodes in three axes; the halo holds half a subset, the gradient stencil, a search and the
    block's own measured displacement."""
    d = measurements(spark, sf).groupBy("node_id").agg(F.max(F.greatest(F.abs("u"), F.abs("v"), F.abs("w"))).alias("reach"))
    b = lattice(spark, sf).join(d, "node_id", "left").groupBy(F.expr("node_id div 100").alias("block")).agg((15 + F.ceil(F.coalesce(F.max("reach"), F.lit(0.0)))).cast("long").alias("halo"), *[e for a in "xyz" for e in (F.min(a).alias(f"{a}0"), F.max(a).alias(f"{a}1"))])
    span = lambda a: F.explode(F.sequence(F.greatest(F.floor((F.col(f"{a}0") - F.col("halo")) / 64), F.lit(0)), F.floor((F.col(f"{a}1") + F.col("halo")) / 64))).alias(f"b{a}")
    return b.select("*", span("x")).select("*", span("y")).select("block", "halo", "bx", "by", span("z"))


@query(f"""WITH a AS (SELECT * FROM meas WHERE frame = 0), b AS (SELECT * FROM meas WHERE frame = 1), j AS (SELECT l.ix BETWEEN 1 AND 8 AND l.iy BETWEEN 1 AND 8 AS interior, a.status = 0 AND b.status = 0 AS conv, a.u - b.u AS du, a.v - b.v AS dv, a.w - b.w AS dw FROM a JOIN b USING (node_id) JOIN lat l ON l.node_id = a.node_id),
k AS (SELECT name, c, CASE c WHEN 'u' THEN du WHEN 'v' THEN dv ELSE dw END AS d FROM j, (VALUES ('all'), ('converged'), ('interior')) t(name), (VALUES ('u'), ('v'), ('w')) q(c) WHERE name = 'all' OR (name = 'converged' AND conv) OR (name = 'interior' AND conv AND interior))
SELECT name, c AS component, count(*) AS n, {R('avg(d)')} AS bias, {R('sqrt(avg(d * d))')} AS rms, {R('quantile_cont(abs(d), 0.5)')} AS median_abs, {R('quantile_cont(abs(d), 0.95)')} AS p95, {R('max(abs(d))')} AS max FROM k GROUP BY name, c""")
def join12_compare_masks(spark, sf):
    """Two results node by node and component by component, over all nodes, those converged in both, and those inside the grid."""
    at = lambda c, k: F.max(F.when(F.col("frame") == k, F.col(c)))
    j = measurements(spark, sf).where("frame in (0, 1)").groupBy("node_id").agg(*[(at(c, 0) - at(c, 1)).alias(c) for c in "uvw"], F.max("status").alias("worst"), F.count("*").alias("k")).where("k = 2")
    j = j.join(lattice(spark, sf).select("node_id", "ix", "iy"), "node_id")
    conv, inside = F.col("worst") == 0, F.col("ix").between(1, 8) & F.col("iy").between(1, 8)
    names = F.explode(F.array_compact(F.array(F.lit("all"), F.when(conv, "converged"), F.when(conv & inside, "interior")))).alias("name")
    k = stats.unpivot(j.select(names, "u", "v", "w"), ["name"], ["u", "v", "w"]).withColumnRenamed("field", "component").withColumn("d", F.abs("value"))
    k = store.write(k)
    q = stats.quantiles(k, "d", {"median_abs": 0.5, "p95": 0.95}, "name", "component")
    s = k.groupBy("name", "component").agg(F.count("*").alias("n"), F.avg("value").alias("bias"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.max("d").alias("max"))
    return s.join(q, ["name", "component"]).select("name", "component", "n", *[r6(c).alias(c) for c in ("bias", "rms", "median_abs", "p95", "max")])


_SIX = "(abs(h11) + abs(h22) + abs(h33) + abs(h12 + h21) / 2 + abs(h13 + h31) / 2 + abs(h23 + h32) / 2) / 6"


@query(f"WITH {_H_SQL} SELECT frame, {R(f'avg({_SIX})')} AS maer, {R(f'stddev_pop({_SIX})')} AS sder FROM h GROUP BY frame")
def agg4_strain_components(spark, sf):
    """Strain precision over the six components of every node's strain."""
    e = st.infinitesimal(st.tensor())
    m = sum((F.abs(e[i][j]) for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))), F.lit(0.0)) / 6
    return _h(spark, sf).select("frame", m.alias("m")).groupBy("frame").agg(r6(F.avg("m")).alias("maer"), r6(F.stddev_pop("m")).alias("sder"))


@query(f"""WITH e AS (SELECT p_brand AS g, p_size AS b, avg(p_retailprice) AS e1, avg(abs(p_retailprice - 1500)) AS e2 FROM part GROUP BY ALL),
s AS (SELECT g, b, round(coalesce((e1 - avg(e1) OVER w) / nullif(stddev_pop(e1) OVER w, 0), 0) + coalesce((e2 - avg(e2) OVER w) / nullif(stddev_pop(e2) OVER w, 0), 0), 6) AS score FROM e WINDOW w AS (PARTITION BY g)),
n AS (SELECT *, lag(b) OVER v AS b0, lag(score) OVER v AS s0, lead(b) OVER v AS b1, lead(score) OVER v AS s1, row_number() OVER (PARTITION BY g ORDER BY score, b) AS k FROM s WINDOW v AS (PARTITION BY g ORDER BY b)),
d AS (SELECT *, (b - b0) * (b - b0) * (score - s1) - (b - b1) * (b - b1) * (score - s0) AS top, (b - b0) * (score - s1) - (b - b1) * (score - s0) AS bottom FROM n WHERE k = 1)
SELECT g, CAST(b AS BIGINT) AS candidate, {R('CASE WHEN s0 IS NOT NULL AND s1 IS NOT NULL AND abs(bottom) > 1e-12 THEN b - 0.5 * top / bottom ELSE b END')} AS refined FROM d""")
def agg25_refined_choice(spark, sf):
    """The best candidate of each group by two z-scored error norms, refined by the parabola through it and its neighbours."""
    price = F.col("p_retailprice")
    e = table(spark, sf, "part").groupBy(F.col("p_brand").alias("g"), F.col("p_size").alias("b")).agg(F.avg(price).alias("e1"), F.avg(F.abs(price - 1500)).alias("e2"))
    w, v = Window.partitionBy("g"), Window.partitionBy("g").orderBy("b")
    z = lambda c: F.coalesce((F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_pop(c).over(w), F.lit(0.0)), F.lit(0.0))
    n = e.withColumn("score", F.round(z("e1") + z("e2"), 6)).withColumns({"b0": F.lag("b").over(v), "s0": F.lag("score").over(v), "b1": F.lead("b").over(v), "s1": F.lead("score").over(v), "k": F.row_number().over(Window.partitionBy("g").orderBy("score", "b"))}).where("k = 1")
    p, q = F.col("b") - F.col("b0"), F.col("b") - F.col("b1")
    up, down = F.col("score") - F.col("s1"), F.col("score") - F.col("s0")
    bottom = p * up - q * down
    refined = F.when(F.col("s0").isNotNull() & F.col("s1").isNotNull() & (F.abs(bottom) > 1e-12), F.col("b") - 0.5 * (p * p * up - q * q * down) / bottom).otherwise(F.col("b").cast("double"))
    return n.select("g", F.col("b").cast("long").alias("candidate"), r6(refined).alias("refined"))


@query(f"""WITH {_DAYS_SQL}, n AS (SELECT *, lag(y) OVER w AS y0, lead(y) OVER w AS y1 FROM p WINDOW w AS (PARTITION BY box ORDER BY lag)), lo AS (SELECT box, min(lag) AS i, arg_min(y, lag) AS low FROM n WHERE y <= y0 AND y < y1 GROUP BY box),
hi AS (SELECT n.box, min(n.lag) AS j, arg_min(n.y, n.lag) AS height, any_value(low) AS low FROM n JOIN lo USING (box) WHERE n.lag > i AND y >= y0 AND y > y1 GROUP BY n.box)
SELECT box, j AS period, {R('height')} AS height, {R('height - low')} AS rise FROM hi WHERE height >= 0.1 AND height > low + 0.02 ORDER BY height - low DESC, box LIMIT 1""")
def win3_strongest_period(spark, sf):
    """Of all profiles' first real peaks the one that rises most (the pick is the feature)."""
    w = Window.partitionBy("box").orderBy("lag")
    n = _profiles(spark, sf).withColumns({"y0": F.lag("y").over(w), "y1": F.lead("y").over(w)})
    lo = n.where("y <= y0 and y < y1").groupBy("box").agg(F.min(F.struct("lag", "y")).alias("lo"))
    hi = n.join(lo, "box").where("lag > lo.lag and y >= y0 and y > y1").groupBy("box").agg(F.min(F.struct("lag", "y", F.col("lo.y").alias("low"))).alias("h")).where("h.y >= 0.1 and h.y > h.low + 0.02")
    top = hi.orderBy(F.desc(F.col("h.y") - F.col("h.low")), "box").limit(1)
    return top.select("box", F.col("h.lag").alias("period"), r6("h.y").alias("height"), r6(F.col("h.y") - F.col("h.low")).alias("rise"))


@query(f"""WITH {_LEVELS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY size DESC) AS k FROM lv), ref AS (SELECT g, avg(mean) AS reference, 150 + 0.05 * abs(avg(mean)) AS tol FROM r WHERE k <= 3 GROUP BY g),
c AS (SELECT lv.*, reference, tol, max(abs(mean - reference)) OVER (PARTITION BY g ORDER BY size ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS worst, max(size) OVER (PARTITION BY g) AS top FROM lv JOIN ref USING (g)),
s AS (SELECT g, count(*) AS levels, min(size) FILTER (worst <= tol AND top >= 1.2 * size AND spread <= tol) AS settled, min(size) FILTER (worst <= tol) AS held, min(size) FILTER (worst <= tol AND top >= 1.2 * size) AS wide FROM c GROUP BY g)
SELECT g, levels, settled, CASE WHEN levels < 3 THEN 'too few sizes' WHEN settled IS NOT NULL THEN 'settled' WHEN held IS NULL THEN 'still changing' WHEN wide IS NULL THEN 'settles too late' ELSE 'positions differ' END AS reason FROM s""")
def win4_plateau_reason(spark, sf):
    """Whether each group's lengths settle over the sizes, and if not, why."""
    lv = _levels(spark, sf)
    by = Window.partitionBy("g")
    r = lv.withColumn("k", F.row_number().over(by.orderBy(F.desc("size"))))
    ref = F.avg(F.when(F.col("k") <= 3, F.col("mean"))).over(by)
    c = r.withColumn("reference", ref).withColumn("tol", 150 + 0.05 * F.abs("reference"))
    c = c.withColumn("worst", F.max(F.abs(F.col("mean") - F.col("reference"))).over(by.orderBy("size").rowsBetween(Window.currentRow, Window.unboundedFollowing))).withColumn("top", F.max("size").over(by))
    held = F.col("worst") <= F.col("tol")
    wide = held & (F.col("top") >= 1.2 * F.col("size"))
    least = lambda ok: F.min(F.when(ok, F.col("size")))
    s = c.groupBy("g").agg(F.count("*").alias("levels"), least(wide & (F.col("spread") <= F.col("tol"))).alias("settled"), least(held).alias("held"), least(wide).alias("wide"))
    reason = F.when(F.col("levels") < 3, "too few sizes").when(F.col("settled").isNotNull(), "settled").when(F.col("held").isNull(), "still changing").when(F.col("wide").isNull(), "settles too late").otherwise("positions differ")
    return s.select("g", "levels", "settled", reason.alias("reason"))


@query(f"""WITH n AS (SELECT *, lag(f) OVER w AS l, lead(f) OVER w AS h, row_number() OVER (PARTITION BY iz ORDER BY f DESC, node_id) AS k, avg(f * f) OVER (PARTITION BY iz) AS energy FROM lat WINDOW w AS (PARTITION BY iz, iy ORDER BY ix))
SELECT iz AS block, node_id AS peak, {R('f')} AS value, {R('ix + CASE WHEN l IS NOT NULL AND h IS NOT NULL AND l - 2 * f + h < 0 THEN 0.5 * (l - h) / (l - 2 * f + h) ELSE 0 END')} AS refined_ix, {R('f * f / energy')} AS peak_ratio, l IS NULL OR h IS NULL AS clipped FROM n WHERE k = 1""")
def top5_refined_peak(spark, sf):
    """The peak of each layer's map, refined along x by a parabola, and its energy against the map's mean."""
    n = lattice(spark, sf).withColumns({"l": stencil.at("f", "ix", -1), "h": stencil.at("f", "ix", 1)})
    top = n.groupBy("iz").agg(F.max(F.struct("f", (-F.col("node_id")).alias("k"), "ix", "l", "h")).alias("p"), F.avg(F.col("f") * F.col("f")).alias("energy"))
    f, low, high = F.col("p.f"), F.col("p.l"), F.col("p.h")
    off = F.when(low.isNotNull() & high.isNotNull() & (low - 2 * f + high < 0), 0.5 * (low - high) / (low - 2 * f + high)).otherwise(0.0)
    return top.select(F.col("iz").alias("block"), (-F.col("p.k")).alias("peak"), r6(f).alias("value"), r6(F.col("p.ix") + off).alias("refined_ix"), r6(f * f / F.col("energy")).alias("peak_ratio"), (low.isNull() | high.isNull()).alias("clipped"))


@query("SELECT series, frame, count(*) AS n, " + R("avg(u)") + " AS mean, " + R("min(u)") + " AS min, " + R("max(u)") + " AS max FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS series, node_id FROM lat WHERE {v}" for k, v in {"all": "true", **_REGION_SQL, "all_valid": "node_valid"}.items()) + ") r JOIN meas USING (node_id) GROUP BY series, frame")
def set3_every_series(spark, sf):
    """The series of all nodes, of the valid ones and of every region, stacked in one table from one pass."""
    shapes = {"all": F.lit(True), **{k: r.contains() for k, r in REGIONS.items()}, "all_valid": F.col("node_valid")}
    n = lattice(spark, sf).select("node_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in shapes.items()]))).alias("series"))
    return measurements(spark, sf).join(n, "node_id").groupBy("series", "frame").agg(F.count("*").alias("n"), r6(F.avg("u")).alias("mean"), r6(F.min("u")).alias("min"), r6(F.max("u")).alias("max"))


@query(f"""SELECT node_id, {R('x + 1.5 + 0.02 * (x - 56) + 0.01 * (y - 60) + 0.5 + 0.03 * (y - 0.5 + 0.015 * (z - 100) - 60)')} AS wx, {R('y - 0.5 + 0.015 * (z - 100) - 0.25 + 0.02 * (x + 1.5 + 0.02 * (x - 56) + 0.01 * (y - 60) - 56)')} AS wy FROM lat""")
def fn9_composed_warp(spark, sf):
    """Two affine warps one after the other: the second acts on where the first has moved a point."""
    dx, dy, dz = F.col("x") - 56, F.col("y") - 60, F.col("z") - 100
    px, py = F.col("x") + 1.5 + 0.02 * dx + 0.01 * dy, F.col("y") - 0.5 + 0.015 * dz
    return lattice(spark, sf).select("node_id", r6(px + 0.5 + 0.03 * (py - 60)).alias("wx"), r6(py - 0.25 + 0.02 * (px - 56)).alias("wy"))


@query(f"""WITH e AS (SELECT c_custkey AS line, 9.0 AS ex, CAST(c_custkey % 10 AS DOUBLE) AS ey, CAST(c_custkey % 13 AS DOUBLE) AS ez, CAST(greatest(2, ceil(2 * sqrt(81 + (c_custkey % 10) * (c_custkey % 10) + (c_custkey % 13) * (c_custkey % 13))) + 1) AS BIGINT) AS n FROM customer),
pts AS (SELECT line * 1000 + i AS pid, line, i, i * sqrt(ex * ex + ey * ey + ez * ez) / (n - 1) AS distance, i * ex / (n - 1) AS gx, i * ey / (n - 1) AS gy, i * ez / (n - 1) AS gz FROM e, range(100) t(i) WHERE i < n),
cor AS (SELECT pid, floor(gx) + a AS ix, floor(gy) + b AS iy, floor(gz) + c AS iz, (CASE WHEN a = 1 THEN gx - floor(gx) ELSE 1 - (gx - floor(gx)) END) * (CASE WHEN b = 1 THEN gy - floor(gy) ELSE 1 - (gy - floor(gy)) END) * (CASE WHEN c = 1 THEN gz - floor(gz) ELSE 1 - (gz - floor(gz)) END) AS w FROM pts, range(2) p(a), range(2) q(b), range(2) r(c)),
g AS (SELECT pid, sum(w * f) AS s, sum(w) AS k FROM cor JOIN lat USING (ix, iy, iz) WHERE w > 0 GROUP BY pid)
SELECT line, CAST(i AS BIGINT) AS i, {R('distance')} AS distance, CASE WHEN k > 1 - 1e-9 THEN {R('s')} END AS value FROM pts LEFT JOIN g USING (pid)""")
def trj1_line_by_distance(spark, sf):
    """Lines sampled at half-node steps: as many points as the line's length asks for, each with its distance from the start."""
    k = F.col("c_custkey")
    length = F.sqrt((81 + (k % 10) * (k % 10) + (k % 13) * (k % 13)).cast("double"))
    e = table(spark, sf, "customer").select(k.alias("line"), F.lit(9.0).alias("ex"), (k % 10).cast("double").alias("ey"), (k % 13).cast("double").alias("ez"), length.alias("len"), F.greatest(F.lit(2), F.ceil(2 * length) + 1).cast("long").alias("n"))
    p = e.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    at = lambda c: F.col("i") * F.col(c) / (F.col("n") - 1)
    p = p.select("line", "i", at("len").alias("distance"), at("ex").alias("gx"), at("ey").alias("gy"), at("ez").alias("gz"))
    p = _sample(p, _cells(lattice(spark, sf)))
    return p.select("line", "i", r6("distance").alias("distance"), F.when(F.col("cover") > 1 - 1e-9, r6("s")).alias("value"))


# ---- files, archives and streams, over what Spark derives from the tables ----


@query(f"""WITH k AS (SELECT z FROM vox GROUP BY z HAVING count(*) = 1024) SELECT 'stack' AS path, count(*) AS n, {R('avg(v)')} AS mean, {R('stddev_pop(v)')} AS std, {R('min(v)')} AS min, {R('max(v)')} AS max FROM vox WHERE z IN (SELECT z FROM k)""")
def src3_stack_slices(spark, sf):
    """Images of the volume's slices stacked into bricks again, and the stack's summary."""

    def images(batches):
        for b in batches:
            for k in range(0, len(b), 64):
                part, out = b.iloc[k : k + 64], []
                for cells in part["cells"]:
                    raw = io.BytesIO()
                    np.save(raw, np.asarray(cells, "<f4").reshape(32, 32))
                    out.append(raw.getvalue())
                yield part[["path", "z"]].assign(content=out)

    s = voxels(spark, sf).groupBy(F.lit("stack").alias("path"), F.col("z").cast("int").alias("z")).agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("cells")).where("size(cells) = 1024")
    # plain numbers: a batch of cells as structs would be ten million Python objects
    s = s.select("path", "z", F.transform("cells", lambda c: c["v"].cast("float")).alias("cells"))
    bricks = volumes.stack_slices(s.mapInPandas(images, "path string, z int, content binary"), 4)
    return volumes.brick_moments(bricks).select("path", "n", *[r6(c).alias(c) for c in ("mean", "std", "min", "max")])


@query(f"""SELECT 'nodes' AS part, CAST(NULL AS BIGINT) AS frame, count(*) AS n, {R('sum(f)')} AS total FROM lat UNION ALL SELECT 'disp', frame, count(*), {R('sum(CASE WHEN frame = 1 THEN u + 1 ELSE u END)')} FROM meas GROUP BY frame""")
def src8_result_archive(spark, sf):
    """A run's tables written as an archive, one frame written again, and all of it read back with its manifest."""
    folder = f"{store.folder(spark)}/result-{uuid.uuid4().hex}"
    m = measurements(spark, sf)
    volumes.write_result({"nodes": lattice(spark, sf), "disp": m}, folder)
    volumes.write_result({"disp": m.where("frame = 1").withColumn("u", F.col("u") + 1)}, folder)
    back = volumes.read_result(spark, folder, "nodes", "disp")
    nodes = back["nodes"].agg(F.lit("nodes").alias("part"), F.lit(None).cast("long").alias("frame"), F.count("*").alias("n"), r6(F.sum("f")).alias("total"))
    disp = back["disp"].groupBy(F.lit("disp").alias("part"), F.col("frame").cast("long").alias("frame")).agg(F.count("*").alias("n"), r6(F.sum("u")).alias("total"))
    return nodes.unionByName(disp)


@query(f"""WITH c AS (SELECT frame, node_id, count(*) OVER w AS k, sum(u) OVER w AS total FROM meas WHERE frame > 0 WINDOW w AS (PARTITION BY node_id ORDER BY frame)) SELECT frame, count(*) AS nodes, {R('sum(total)')} AS total FROM c WHERE k = frame GROUP BY frame""")
def str1_frames_follow(spark, sf):
    """Pairs of frames arriving as a stream of files: each waits for its reference, then adds to what that one has reached."""
    top = f"{store.folder(spark)}/stream-{uuid.uuid4().hex}"
    pairs = measurements(spark, sf).where("frame > 0").select("frame", "node_id", "u")
    pairs.write.parquet(f"{top}/in")
    schedule = pairs.select("frame").distinct().select("frame", (F.col("frame") - 1).alias("ref"))
    frames.follow(spark.readStream.schema(pairs.schema).parquet(f"{top}/in"), schedule, f"{top}/out", f"{top}/progress").awaitTermination()
    total = spark.read.schema("node_id long, u_total double, frame long").parquet(f"{top}/out/total")
    return total.groupBy("frame").agg(F.count("*").alias("nodes"), r6(F.sum("u_total")).alias("total"))


@query(f"""WITH c AS (SELECT frame, node_id, count(*) OVER w AS k, sum(u) OVER w AS total FROM meas WHERE frame > 0 WINDOW w AS (PARTITION BY node_id ORDER BY frame)), t AS (SELECT frame, count(*) AS have, sum(total) AS total FROM c WHERE k = frame GROUP BY frame), e AS (SELECT frame, count(*) AS nodes FROM meas WHERE frame > 0 GROUP BY frame)
SELECT frame, coalesce(have, 0) AS nodes, {R('total')} AS total, coalesce(have, 0) >= nodes AS complete FROM e LEFT JOIN t USING (frame)""")
def str2_node_state(spark, sf):
    """The same pairs with rows of every frame scattered over batches: totals from state kept by node, and which frames are complete."""
    top = f"{store.folder(spark)}/state-{uuid.uuid4().hex}"
    pairs = measurements(spark, sf).where("frame > 0").select("frame", "node_id", "u")
    pairs.repartition(3).write.parquet(f"{top}/in")  # round robin: each file has rows of every frame
    schedule = pairs.select("frame").distinct().select("frame", (F.col("frame") - 1).alias("ref"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(pairs.schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/in")
        frames.totals(stream, schedule).writeStream.format("parquet").option("checkpointLocation", f"{top}/progress").trigger(availableNow=True).start(f"{top}/out").awaitTermination()
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    total = spark.read.schema("node_id long, frame long, u_total double").parquet(f"{top}/out")
    sums = total.groupBy("frame").agg(r6(F.sum("u_total")).alias("total"))
    return frames.complete(total, pairs.groupBy("frame").agg(F.count("*").alias("nodes"))).join(sums, "frame", "left").select("frame", "nodes", "total", "complete")
