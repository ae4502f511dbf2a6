"""Queries of element integrals and of subsets' normal equations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import elements, precision, stencil
from ..sources.views import lattice, measurements, table, voxels
from .registry import R, query, r6

_SPACING = (8.0, 8.0, 8.0)
_MASS = lambda a: f"(8.0 / 6 * CASE WHEN s.{a} = t.{a} THEN 2 ELSE 1 END)"
_SLOPE = lambda a: f"(s.{a} - 0.5)"
_ELEMENTS_SQL = """v AS (SELECT node_id, ix, iy, iz, f FROM lat WHERE node_valid), c AS (SELECT node_id, f, ix - a AS ex, iy - b AS ey, iz - c AS ez, a, b, c FROM v, range(2) p(a), range(2) q(b), range(2) r(c)),
e AS (SELECT ex, ey, ez FROM c GROUP BY ex, ey, ez HAVING count(*) = 8), k AS (SELECT c.* FROM c JOIN e USING (ex, ey, ez))"""
_GRADIENT_SQL = f"""g AS (SELECT t.node_id, sum({_SLOPE('a')} * {_MASS('b')} * {_MASS('c')} * s.f) / (8.0 * count(*)) AS d_ix, sum({_MASS('a')} * {_SLOPE('b')} * {_MASS('c')} * s.f) / (8.0 * count(*)) AS d_iy,
sum({_MASS('a')} * {_MASS('b')} * {_SLOPE('c')} * s.f) / (8.0 * count(*)) AS d_iz FROM k s JOIN k t USING (ex, ey, ez) GROUP BY t.node_id)"""


@query(f"WITH {_ELEMENTS_SQL}, {_GRADIENT_SQL} SELECT v.node_id, {', '.join(f'{R(d)} AS {d}' for d in ('d_ix', 'd_iy', 'd_iz'))} FROM v LEFT JOIN g ON g.node_id = v.node_id")
def fn6_element_gradient(spark, sf):
    """A field's gradient at valid nodes from the elements around them; null where a node has no whole element."""
    g = elements.nodal_gradient(lattice(spark, sf).where("node_valid"), "f", _SPACING)
    return g.select("node_id", *[r6(c).alias(c) for c in ("d_ix", "d_iy", "d_iz")])


_DIFFERENCE_SQL = ", ".join(f"""CASE WHEN lo{a}.f IS NOT NULL AND hi{a}.f IS NOT NULL THEN (hi{a}.f - lo{a}.f) / 16 WHEN hi{a}.f IS NOT NULL THEN (hi{a}.f - v.f) / 8 WHEN lo{a}.f IS NOT NULL THEN (v.f - lo{a}.f) / 8 END AS h{a}""" for a in "xyz")
_SIDES_SQL = " ".join(f"LEFT JOIN v {s}{a} ON {' AND '.join(f'{s}{a}.i{b} = v.i{b}' + (f' {k} 1' if a == b else '') for b in 'xyz')}" for a in "xyz" for s, k in (("lo", "-"), ("hi", "+")))
_PICK = lambda a: f"coalesce(d_i{a}, h{a})"


@query(f"""WITH {_ELEMENTS_SQL}, {_GRADIENT_SQL}, h AS (SELECT v.node_id, {_DIFFERENCE_SQL} FROM v {_SIDES_SQL})
SELECT h.node_id, CASE WHEN g.node_id IS NOT NULL THEN 'fem' WHEN hx IS NOT NULL AND hy IS NOT NULL AND hz IS NOT NULL THEN 'fd' ELSE 'none' END AS route, {R(f"{_PICK('x')} + ({_PICK('x')} * {_PICK('x')}) / 2")} AS exx, {R(f"{_PICK('y')} / 2")} AS exy, {R(f"{_PICK('z')} / 2")} AS exz
FROM h LEFT JOIN g ON g.node_id = h.node_id""")
def fn6_strain_routes(spark, sf):
    """Green-Lagrange terms of a displacement along x: from elements, beside gaps from finite differences, and which was taken."""
    n = elements.nodal_gradient(lattice(spark, sf).where("node_valid"), "f", _SPACING)
    n = n.withColumnsRenamed({f"d_{a}": f"e_{a}" for a in stencil.AXES})
    n = stencil.gradient(n, "f", "node_valid", 8.0)
    whole = F.col("d_ix").isNotNull() & F.col("d_iy").isNotNull() & F.col("d_iz").isNotNull()
    route = F.when(F.col("e_ix").isNotNull(), "fem").when(whole, "fd").otherwise("none")
    x, y, z = (F.coalesce(f"e_{a}", f"d_{a}") for a in stencil.AXES)
    return n.select("node_id", route.alias("route"), r6(x + x * x / 2).alias("exx"), r6(y / 2).alias("exy"), r6(z / 2).alias("exz"))


def step_input(spark, sf):
    """Mean displacement of every measured node with its finite differences, zero where a side is missing."""
    n = measurements(spark, sf).groupBy("node_id").agg(*[F.avg(c).alias(f"u{i}") for i, c in enumerate("uvw", 1)])
    n = n.join(lattice(spark, sf).select("node_id", *stencil.AXES), "node_id").withColumn("there", F.lit(True))
    for i in (1, 2, 3):
        n = stencil.gradient(n, f"u{i}", "there", 8.0)
        n = n.withColumns({f"f{i}{j}": F.coalesce(f"d_{a}", F.lit(0.0)) for j, a in enumerate(stencil.AXES, 1)}).drop("complete", *[f"d_{a}" for a in stencil.AXES])
    return n


@query()
def job8_global_step(spark, sf):
    """The displacement that fits measured displacements and gradients over all elements, by conjugate gradients."""
    out = elements.global_step(step_input(spark, sf), _SPACING, 4.0, 1.0, 0.5)
    return out.select("node_id", *[r6(f"s{i}").alias(f"s{i}") for i in (1, 2, 3)], F.when(F.col("residual").isNotNull(), F.col("residual") < 1e-8).alias("solved"))


_SIZES_SQL = "SELECT p_partkey AS sample_id, p_size // 2 AS hx, p_size % 7 + 1 AS hy, p_partkey % 5 + 1 AS hz, 1 + p_partkey % 3 AS stride FROM part"
_PLACES = lambda a: f"range(-h{a}, h{a} + 1, stride)"
_SQUARES = lambda a: f"list_sum(list_transform({_PLACES(a)}, lambda k: k * k))"


@query(f"""WITH p AS ({_SIZES_SQL}), m AS (SELECT sample_id, {", ".join(f"len({_PLACES(a)}) AS n{a}, {_SQUARES(a)} AS q{a}" for a in "xyz")} FROM p)
SELECT sample_id, CAST(qx * ny * nz AS BIGINT) AS sxx, CAST(qy * nx * nz AS BIGINT) AS syy, CAST(qz * nx * ny AS BIGINT) AS szz, CAST(nx * ny * nz AS BIGINT) AS n FROM m""")
def fn11_moment_matrix(spark, sf):
    """The diagonal of every sampled subset's moment matrix of (x, y, z, 1)."""
    k = F.col("p_partkey")
    half = {"x": F.expr("p_size div 2"), "y": F.col("p_size") % 7 + 1, "z": k % 5 + 1}
    (nx, qx), (ny, qy), (nz, qz) = (precision.moments(h, 1 + k % 3) for h in half.values())
    out = {"sxx": qx * ny * nz, "syy": qy * nx * nz, "szz": qz * nx * ny, "n": nx * ny * nz}
    return table(spark, sf, "part").select(k.alias("sample_id"), *[F.round(c).cast("long").alias(name) for name, c in out.items()])


def subset_voxels(spark, sf):
    """Voxels by subset of edge 7 with their places from its centre, seven-point gradients and a tenth of the next in x mixed in."""
    v = voxels(spark, sf).select("x", "y", "z", "v")
    for a in "xyz":
        w = Window.partitionBy(*[c for c in "zyx" if c != a]).orderBy(a)
        at = lambda k: F.max("v").over(w.rangeBetween(k, k))  # noqa: B023, E731
        v = v.withColumn(f"g{a}", sum(((at(k) - at(-k)) * c for k, c in ((1, 0.75), (2, -0.15), (3, 1 / 60))), F.lit(0.0)))
        if a == "x":
            v = v.withColumn("d", (9 * F.col("v") + F.coalesce(at(1), F.col("v"))) / 10)
    return v.withColumns({f"t{a}": F.expr(f"{a} div 7") for a in "zyx"} | {f"o{a}": F.col(a) % 7 - 3 for a in "xyz"})


_STEP = lambda k: f"(lead(v, {k}) OVER w{{0}} - lag(v, {k}) OVER w{{0}})"
_SEVEN = f"0.75 * {_STEP(1)} - 0.15 * {_STEP(2)} + {_STEP(3)} / 60"
_TILE = ["tz", "ty", "tx"]


@query(f"""WITH g AS (SELECT x, y, z, v, {", ".join(_SEVEN.format(a) + f" AS g{a}" for a in "xyz")} FROM vox WINDOW wx AS (PARTITION BY z, y ORDER BY x), wy AS (PARTITION BY z, x ORDER BY y), wz AS (PARTITION BY y, x ORDER BY z)),
o AS (SELECT *, z // 7 AS tz, y // 7 AS ty, x // 7 AS tx, x % 7 - 3 AS ox, y % 7 - 3 AS oy, z % 7 - 3 AS oz FROM g WHERE gx IS NOT NULL AND gy IS NOT NULL AND gz IS NOT NULL),
j AS (SELECT tz, ty, tx, [{", ".join(f"g{a} * o{b}" for a in "xyz" for b in "xyz")}, gx, gy, gz] AS r FROM o)
SELECT tz, ty, tx, i, k, count(*) AS n, {R("sum(r[i + 1] * r[k + 1])")} AS value FROM j, range(12) p(i), range(12) q(k) WHERE i <= k GROUP BY tz, ty, tx, i, k""")
def job10_normal_equations(spark, sf):
    """The upper half of every subset's 12 x 12 matrix, a row an entry."""
    sums = precision.normal_equations(subset_voxels(spark, sf), "v", ("gx", "gy", "gz"), ("ox", "oy", "oz"), *_TILE)
    entries = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(k).cast("long").alias("k"), precision.entry(i, k).alias("value")) for i in range(12) for k in range(i, 12)])).alias("e")
    return sums.select(*_TILE, "n", entries).select(*_TILE, "n", "e.i", "e.k", r6("e.value").alias("value"))


@query()
def job10_displacement_deviation(spark, sf):
    """Standard deviations of every subset's displacement if it matched grey values with a tenth of their neighbours in x."""
    v = subset_voxels(spark, sf)
    sums = precision.normal_equations(v, "v", ("gx", "gy", "gz"), ("ox", "oy", "oz"), *_TILE)
    zncc = v.groupBy(*_TILE).agg(F.corr("v", "d").alias("zncc"))
    out = precision.displacement_deviation(sums.join(zncc, _TILE), "zncc", (3, 3, 3))
    return out.select(*_TILE, "n", *[r6(c).alias(c) for c in ("zncc", "su", "sv", "sw")])
