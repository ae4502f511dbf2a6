"""Queries over cut grids and volume files: reachability by bit masks, fits and tests across cuts, volumes as a data source."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import bodies, reach, store
from ..operators import stencil as sl
from ..sources import volume_source
from ..sources.views import lattice
from .jobs import bricks, mask
from .registry import R, query, r6

# ---- volume files ----


def _packed(spark, sf):
    """The embedding volume's bricks as a volume file's bricks."""

    def pack(batches):
        for f in batches:
            yield f.assign(data=[np.asarray(d, "<f4").tobytes() for d in f["data"]])

    b = bricks(spark, sf).select(F.lit("embeddings").alias("path"), *[F.col(c).cast("int").alias(c) for c in ("bz", "by", "bx")], *[F.lit(4).alias(c) for c in ("nz", "ny", "nx")], "data")
    return b.mapInPandas(pack, volume_source.BRICKS)


def _file(spark, sf):
    """The volume written as one file, with NaN where the last layer has no brick."""
    b = _packed(spark, sf)
    layers = b.agg(F.max("bz")).first()[0] + 1
    path = f"{store.folder(spark)}/volume-{uuid.uuid4().hex}.npy"
    volume_source.save_volume(b, path, (4 * layers, 32, 32), edge=4, fill="nan")
    return path


def _brick_sums(b):
    def run(batches):
        for f in batches:
            v = [np.frombuffer(raw, "<f4").astype(float) for raw in f["data"]]
            yield pd.DataFrame({"bz": f["bz"], "by": f["by"], "bx": f["bx"], "n": [int(np.isfinite(x).sum()) for x in v], "mean": [x[np.isfinite(x)].mean() if np.isfinite(x).any() else np.nan for x in v], "last": [x[-1] for x in v]})

    return b.mapInPandas(run, "bz int, by int, bx int, n long, mean double, last double").where("n > 0").select("bz", "by", "bx", "n", r6("mean").alias("mean"), r6("last").alias("last"))


_BRICK_SQL = f"SELECT CAST(z // 4 AS INT) AS bz, CAST(y // 4 AS INT) AS by, CAST(x // 4 AS INT) AS bx, count(*) AS n, {R('avg(v)')} AS mean, {R('max_by(v, (z * 32 + y) * 32 + x)')} AS last FROM vox"


@query(f"{_BRICK_SQL} GROUP BY ALL")
def src2_volume_file(spark, sf):
    """The volume written as a file brick by brick, and read back by byte offset."""
    return _brick_sums(volume_source.open_volumes(spark, _file(spark, sf), edge=4))


@query(f"{_BRICK_SQL} WHERE z // 4 BETWEEN 2 AND 5 AND y // 4 < 5 AND x // 4 >= 3 GROUP BY ALL")
def src6_volume_crop(spark, sf):
    """A box of bricks of a volume file; only the bars that hold it are read."""
    b = volume_source.open_volumes(spark, _file(spark, sf), edge=4)
    return _brick_sums(b.where("bz >= 2 and bz <= 5 and by < 5 and bx >= 3"))


# ---- reachability ----

#: An edge is cut where the field jumps by more than this.
JUMP = 1.2


def _cut_lattice(spark, sf):
    """Nodes with their uncut edges, and what each reaches in its window."""
    n = lattice(spark, sf).select("node_id", *sl.AXES, "f", "node_valid")
    n = n.withColumns({f"ok_{a}": F.coalesce(F.abs(sl.at("f", a, 1) - F.col("f")) <= JUMP, F.lit(False)) for a in sl.AXES})
    return reach.reachable(n)


_EDGES = f"""e AS (SELECT a.node_id AS p, b.node_id AS q, CASE WHEN a.ix < b.ix THEN 0 WHEN a.iy < b.iy THEN 1 ELSE 2 END AS axis FROM lat a JOIN lat b ON (b.ix - a.ix, b.iy - a.iy, b.iz - a.iz) IN ((1, 0, 0), (0, 1, 0), (0, 0, 1)) AND abs(a.f - b.f) <= {JUMP}
 WHERE b.ix BETWEEN a.ix AND a.ix + 1 AND b.iy BETWEEN a.iy AND a.iy + 1 AND b.iz BETWEEN a.iz AND a.iz + 1),
s AS (SELECT p, q, axis, 1 AS d FROM e UNION ALL SELECT q, p, axis, -1 FROM e),
flood AS (SELECT node_id AS c, node_id AS tgt, 0 AS dx, 0 AS dy, 0 AS dz FROM lat UNION SELECT c, q, dx + CASE WHEN axis = 0 THEN d ELSE 0 END, dy + CASE WHEN axis = 1 THEN d ELSE 0 END, dz + CASE WHEN axis = 2 THEN d ELSE 0 END FROM flood JOIN s ON p = tgt
 WHERE abs(dx + CASE WHEN axis = 0 THEN d ELSE 0 END) <= 1 AND abs(dy + CASE WHEN axis = 1 THEN d ELSE 0 END) <= 1 AND abs(dz + CASE WHEN axis = 2 THEN d ELSE 0 END) <= 1),
direct AS (SELECT node_id AS c, node_id AS tgt, 0 AS dx, 0 AS dy, 0 AS dz FROM lat UNION SELECT c, q, dx + CASE WHEN axis = 0 THEN d ELSE 0 END, dy + CASE WHEN axis = 1 THEN d ELSE 0 END, dz + CASE WHEN axis = 2 THEN d ELSE 0 END FROM direct JOIN s ON p = tgt
 WHERE CASE axis WHEN 0 THEN dx WHEN 1 THEN dy ELSE dz END = 0)"""


@query(f"""WITH RECURSIVE {_EDGES}, b AS (SELECT c, sum(CAST(1 AS BIGINT) << ((dz + 1) * 9 + (dy + 1) * 3 + dx + 1)) AS m, count(*) AS n FROM flood GROUP BY c), o AS (SELECT c, sum(CAST(1 AS BIGINT) << ((dz + 1) * 9 + (dy + 1) * 3 + dx + 1)) AS m FROM direct GROUP BY c)
SELECT b.c AS node_id, CAST(b.m AS BIGINT) AS flood, CAST(o.m AS BIGINT) AS direct, b.n AS reached FROM b JOIN o USING (c)""")
def join3_reachable(spark, sf):
    """Which of its 26 neighbours each node reaches over uncut edges inside the window, by any way and by direct ones."""
    return _cut_lattice(spark, sf).select("node_id", "flood", "direct", F.bit_count("flood").cast("long").alias("reached"))


@query(f"""WITH RECURSIVE {_EDGES}, w AS (SELECT c, dx, dy, dz, l.f AS u FROM flood JOIN lat l ON l.node_id = tgt AND l.node_valid JOIN lat k ON k.node_id = c AND k.node_valid),
t AS (SELECT c, count(*) AS n, sum(dx) AS x, sum(dy) AS y, sum(dz) AS z, sum(dx * dx) AS xx, sum(dy * dy) AS yy, sum(dz * dz) AS zz, sum(dx * dy) AS xy, sum(dx * dz) AS xz, sum(dy * dz) AS yz, sum(u) AS u, sum(u * dx) AS ux, sum(u * dy) AS uy, sum(u * dz) AS uz FROM w GROUP BY c),
g AS (SELECT c, n, CASE WHEN n * xx = x * x THEN 1 ELSE n * xx - x * x END AS a, CASE WHEN n * yy = y * y THEN 1 ELSE n * yy - y * y END AS e, CASE WHEN n * zz = z * z THEN 1 ELSE n * zz - z * z END AS i, n * xy - x * y AS b, n * xz - x * z AS k, n * yz - y * z AS h, n * ux - u * x AS p, n * uy - u * y AS q, n * uz - u * z AS r FROM t),
d AS (SELECT *, a * (e * i - h * h) - b * (b * i - h * k) + k * (b * h - e * k) AS det FROM g)
SELECT node_id, CASE WHEN n >= 5 AND det <> 0 THEN {R('((e * i - h * h) * p + (k * h - b * i) * q + (b * h - k * e) * r) / det / 8')} END AS d_ix, CASE WHEN n >= 5 AND det <> 0 THEN {R('((h * k - b * i) * p + (a * i - k * k) * q + (k * b - a * h) * r) / det / 8')} END AS d_iy,
 CASE WHEN n >= 5 AND det <> 0 THEN {R('((b * h - e * k) * p + (b * k - a * h) * q + (a * e - b * b) * r) / det / 8')} END AS d_iz, coalesce(n = 27, false) AS complete FROM lat LEFT JOIN d ON c = node_id""")
def win7_plane_fit_cut(spark, sf):
    """Plane-fit gradients over the nodes on a node's own side of the cuts."""
    g = reach.plane_fit(_cut_lattice(spark, sf), "f", "node_valid", 8.0)
    return g.select("node_id", *[r6(f"d_{a}").alias(f"d_{a}") for a in sl.AXES], "complete")


@query(f"""WITH RECURSIVE {_EDGES}, v AS (SELECT node_id, CASE WHEN node_valid THEN f END AS f FROM lat), w AS (SELECT c, tgt FROM direct WHERE tgt <> c),
m AS (SELECT c, count(f) AS n, median(f) AS m FROM w JOIN v ON v.node_id = tgt GROUP BY c), o AS (SELECT v.node_id, coalesce(n, 0) AS n, abs(f - m) AS d FROM v LEFT JOIN m ON c = v.node_id),
k AS (SELECT c, median(d) AS m FROM w JOIN o ON o.node_id = tgt GROUP BY c)
SELECT node_id, {R('CASE WHEN n >= 6 THEN coalesce(d / (m + 0.1), 0) ELSE 0 END')} AS fluctuation, CASE WHEN n >= 6 THEN coalesce(d / (m + 0.1), 0) ELSE 0 END > 2 AS outlier FROM o LEFT JOIN k ON c = node_id""")
def win10_median_cut(spark, sf):
    """The median test with the neighbours on a node's own side of the cuts."""
    n = _cut_lattice(spark, sf).withColumn("g", F.when(F.col("node_valid"), F.col("f")))
    return reach.fluctuation(n, "g").select("node_id", r6("fluctuation").alias("fluctuation"), (F.col("fluctuation") > 2).alias("outlier"))


# ---- bodies, holes and elements across gaps ----


def _counts(kept):
    n = lambda c: F.size(F.filter("mask", lambda x: x == c)).cast("long")
    return kept.select("bz", "by", "bx", n(True).alias("voxels"))


_SIDES = "(VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) n(a, b, c)"


def _outside(sides: str) -> str:
    """Voxels without material that reach the border."""
    return f"""p AS (SELECT x, y, z, v > (SELECT avg(v) FROM vox) AS m FROM vox), o AS (SELECT x, y, z FROM p WHERE NOT m AND EXISTS (SELECT 1 FROM {sides} WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.x = p.x + a AND q.y = p.y + b AND q.z = p.z + c))
 UNION SELECT p.x, p.y, p.z FROM o JOIN {sides} ON true JOIN p ON p.x = o.x + a AND p.y = o.y + b AND p.z = o.z + c AND NOT p.m)"""


#: Components of voxels k (rank, x, y, z) with edges e (f, g): floods from a lattice of seeds, then what they leave by itself.
COMPONENTS = """i AS (SELECT rank AS seed, rank FROM k WHERE x % 8 = 0 AND y % 8 = 0 AND z % 8 = 0 UNION SELECT seed, g FROM i JOIN e ON f = rank), j AS (SELECT rank, min(seed) AS lab FROM i GROUP BY rank),
u AS (SELECT rank AS seed, rank FROM k WHERE rank NOT IN (SELECT rank FROM j) UNION SELECT seed, g FROM u JOIN e ON f = rank), l AS (SELECT rank, lab FROM j UNION ALL SELECT rank, min(seed) FROM u GROUP BY rank)"""


@query(f"""WITH RECURSIVE {_outside(_SIDES)}, k AS (SELECT (z * 32 + y) * 32 + x AS id, ((z // 4 * 8 + y // 4) * 8 + x // 4) * 64 + (z % 4 * 4 + y % 4) * 4 + x % 4 AS rank, x, y, z FROM p WHERE m OR NOT EXISTS (SELECT 1 FROM o WHERE o.x = p.x AND o.y = p.y AND o.z = p.z)),
e AS (SELECT s.rank AS f, t.rank AS g FROM k s JOIN {_SIDES} ON true JOIN k t ON t.x = s.x + a AND t.y = s.y + b AND t.z = s.z + c),
{COMPONENTS},
z AS (SELECT lab FROM l GROUP BY lab ORDER BY count(*) DESC, min(rank) LIMIT 1)
SELECT CAST(k.z // 4 AS BIGINT) AS bz, CAST(k.y // 4 AS BIGINT) AS by, CAST(k.x // 4 AS BIGINT) AS bx, count(*) FILTER (l.lab = (SELECT lab FROM z)) AS voxels FROM k JOIN l ON l.rank = k.rank GROUP BY ALL""")
def agg21_auto_mask(spark, sf):
    """Voxels above the mean, their holes filled, the largest body kept; counted by brick."""
    return _counts(bodies.clean_mask(mask(spark, sf, None), 4))


@query(f"""WITH RECURSIVE {_outside(_SIDES.replace(', (0, 0, 1), (0, 0, -1)', ''))} SELECT CAST(p.z // 4 AS BIGINT) AS bz, CAST(p.y // 4 AS BIGINT) AS by, CAST(p.x // 4 AS BIGINT) AS bx, count(*) FILTER (m OR o.x IS NULL) AS voxels FROM p LEFT JOIN o ON o.x = p.x AND o.y = p.y AND o.z = p.z GROUP BY ALL""")
def prj12_slice_fill(spark, sf):
    """Holes filled slice by slice; counted by brick."""
    return _counts(bodies.clean_mask(mask(spark, sf, None), 4, keep_largest=False, axes=(1, 2)))


_LEVEL = -0.06
_ELEMENTS = f"""p AS (SELECT x, y, z, v > {_LEVEL} AS m FROM vox), c AS (SELECT x // 4 AS ix, y // 4 AS iy, z // 4 AS iz FROM vox a WHERE x % 4 = 0 AND y % 4 = 0 AND z % 4 = 0),
el AS (SELECT ix, iy, iz FROM c JOIN p ON p.x BETWEEN 4 * ix AND 4 * ix + 4 AND p.y BETWEEN 4 * iy AND 4 * iy + 4 AND p.z BETWEEN 4 * iz AND 4 * iz + 4 GROUP BY ALL HAVING count(*) = 125),
fl AS (SELECT ix, iy, iz, 4 * ix AS x, 4 * iy AS y, 4 * iz AS z FROM el JOIN p ON p.x = 4 * ix AND p.y = 4 * iy AND p.z = 4 * iz AND p.m
 UNION SELECT ix, iy, iz, p.x, p.y, p.z FROM fl JOIN {_SIDES} ON true JOIN p ON p.x = fl.x + a AND p.y = fl.y + b AND p.z = fl.z + c AND p.m WHERE p.x BETWEEN 4 * ix AND 4 * ix + 4 AND p.y BETWEEN 4 * iy AND 4 * iy + 4 AND p.z BETWEEN 4 * iz AND 4 * iz + 4),
br AS (SELECT el.ix, el.iy, el.iz, count(fl.x) FILTER (fl.x % 4 = 0 AND fl.y % 4 = 0 AND fl.z % 4 = 0) < 8 AS bridging FROM el LEFT JOIN fl ON fl.ix = el.ix AND fl.iy = el.iy AND fl.iz = el.iz GROUP BY el.ix, el.iy, el.iz)"""


@query(f"WITH RECURSIVE {_ELEMENTS} SELECT iz, iy, ix, bridging FROM br")
def join11_bridging_elements(spark, sf):
    """Elements of a node grid whose corners the material in their box doesn't join."""
    return bodies.bridging(mask(spark, sf, _LEVEL), 4, 4)


@query(f"""WITH RECURSIVE {_ELEMENTS}, g AS (SELECT 'iz' AS axis, iz, iy + u AS iy, ix + v AS ix, bridging FROM br, range(2) q(u), range(2) w(v) UNION ALL SELECT 'iy', iz + u, iy, ix + v, bridging FROM br, range(2) q(u), range(2) w(v) UNION ALL SELECT 'ix', iz + u, iy + v, ix, bridging FROM br, range(2) q(u), range(2) w(v))
SELECT iz, iy, ix, axis, bool_and(bridging) AS cut FROM g GROUP BY iz, iy, ix, axis""")
def join11_mask_cut_edges(spark, sf):
    """Edges of the node grid that the mask cuts: all elements that hold them bridge a gap."""
    return bodies.cut_edges(bodies.bridging(mask(spark, sf, _LEVEL), 4, 4))
