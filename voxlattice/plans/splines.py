"""Cubic interpolation of grid fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spline
from ..sources.views import lattice, table
from .registry import R, query, r6


def _prefilter_sql(source: str, name: str, axis: str) -> str:
    """Coefficients along an axis as a weighted sum over the line's odd reflections; the weights fall by 0.268 a node."""
    a, b = (x for x in ("ix", "iy", "iz") if x != axis)
    return f"""{name}m AS (SELECT max({axis}) AS m FROM {source}), {name}x AS (SELECT t.ix, t.iy, t.iz, w, (t.{axis} + k) - 2 * m * CAST(floor((t.{axis} + k) / (2.0 * m)) AS BIGINT) AS r, CAST(floor((t.{axis} + k) / (2.0 * m)) AS BIGINT) AS q, m FROM {source} t, {name}m, ker),
{name} AS (SELECT t.ix, t.iy, t.iz, sum(w * (CASE WHEN r <= m THEN s.f ELSE 2 * e.f - s.f END + 2 * q * (e.f - b.f))) AS f FROM {name}x t JOIN {source} s ON s.{axis} = CASE WHEN r <= m THEN r ELSE 2 * m - r END AND s.{a} = t.{a} AND s.{b} = t.{b}
 JOIN {source} b ON b.{axis} = 0 AND b.{a} = t.{a} AND b.{b} = t.{b} JOIN {source} e ON e.{axis} = m AND e.{a} = t.{a} AND e.{b} = t.{b} GROUP BY t.ix, t.iy, t.iz)"""


def _taps_sql(g: str, axis: str) -> str:
    """(pid, i, w) along an axis: the four nodes around a point, beyond the border as 2 c(0) - c(1), points outside reflected."""
    return f"""{axis}u AS (SELECT pid, CAST(m AS DOUBLE) AS n, greatest(least({g}, m + least(10, m)), -least(10, m)) AS u FROM pts, {axis}cm),
{axis}r AS (SELECT pid, n, CASE WHEN u < 0 THEN -u WHEN u > n THEN 2 * n - u ELSE u END AS r, CASE WHEN u < 0 OR u > n THEN -1 ELSE 1 END AS sg, CASE WHEN u < 0 THEN 0 ELSE n END AS rim FROM {axis}u),
{axis}i AS (SELECT *, least(floor(r), n - 1) AS i, r - least(floor(r), n - 1) AS t FROM {axis}r),
{axis}w AS (SELECT *, (1 - t) * (1 - t) * (1 - t) / 6 AS w0, (3 * t * t * t - 6 * t * t + 4) / 6 AS w1, (-3 * t * t * t + 3 * t * t + 3 * t + 1) / 6 AS w2, t * t * t / 6 AS w3 FROM {axis}i),
{axis}t AS (SELECT pid, CAST(i AS BIGINT) AS {axis}, sum(w) AS w FROM (SELECT pid, i, sg * w1 AS w FROM {axis}w UNION ALL SELECT pid, i + 1, sg * w2 FROM {axis}w UNION ALL SELECT pid, i - 1, sg * w0 FROM {axis}w WHERE i > 0 UNION ALL SELECT pid, 0, sg * 2 * w0 FROM {axis}w WHERE i = 0 UNION ALL SELECT pid, 1, -sg * w0 FROM {axis}w WHERE i = 0
 UNION ALL SELECT pid, i + 2, sg * w3 FROM {axis}w WHERE i + 1 < n UNION ALL SELECT pid, n, sg * 2 * w3 FROM {axis}w WHERE i + 1 = n UNION ALL SELECT pid, n - 1, -sg * w3 FROM {axis}w WHERE i + 1 = n UNION ALL SELECT pid, rim, 2 FROM {axis}w WHERE sg < 0) q GROUP BY pid, i)"""


@query(f"""WITH pts AS (SELECT p_partkey AS pid, (p_partkey % 37) / 4.0 - 1.5 AS gx, (p_partkey % 29) / 2.5 - 1.0 AS gy, (p_partkey % 41) / 3.1 AS gz FROM part), ker AS (SELECT k, sqrt(3.0) * pow(sqrt(3.0) - 2, abs(k)) AS w FROM range(-26, 27) t(k)),
src AS (SELECT ix, iy, iz, f FROM lat), {_prefilter_sql('src', 'ixc', 'ix')}, {_prefilter_sql('ixc', 'iyc', 'iy')}, {_prefilter_sql('iyc', 'izc', 'iz')}, {_taps_sql('gx', 'ix')}, {_taps_sql('gy', 'iy')}, {_taps_sql('gz', 'iz')}
SELECT pid, {R('sum(ixt.w * iyt.w * izt.w * f)')} AS value FROM ixt JOIN iyt USING (pid) JOIN izt USING (pid) JOIN izc USING (ix, iy, iz) GROUP BY pid""")
def join6_cubic(spark, sf):
    """Cubic spline values of a dense grid field at points inside the grid and a little beyond it."""
    k = F.col("p_partkey")
    points = table(spark, sf, "part").select(k.alias("pid"), ((k % 37) / 4.0 - 1.5).alias("gx"), ((k % 29) / 2.5 - 1.0).alias("gy"), ((k % 41) / 3.1).alias("gz"))
    return spline.interpolate(points, lattice(spark, sf), "f").select("pid", r6("value").alias("value"))
