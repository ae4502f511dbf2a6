"""Neighbours on the node grid: exact neighbours by range frames, so gaps and borders give null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

AXES = ("ix", "iy", "iz")


def line(axis: str, *keys: str):
    """The grid line through a node along an axis (keys: sample, frame)."""
    return Window.partitionBy(*keys, *[a for a in AXES if a != axis]).orderBy(axis)


def at(value: Column | str, axis: str, step: int, *keys: str) -> Column:
    """The value `step` nodes along an axis, or null where there is no such node."""
    return F.max(value).over(line(axis, *keys).rangeBetween(step, step))


def erode(body: DataFrame, flag: str, layers: int, *keys: str) -> DataFrame:
    """The body without its outermost layers: every node of a full (2k+1)-cube around stays; outside counts as not body."""
    out, name = body.withColumn("_in", F.col(flag).cast("int")), "_in"
    for a in AXES:
        n = F.sum(name).over(line(a, *keys).rangeBetween(-layers, layers))
        out = out.withColumn("_in", (n == 2 * layers + 1).cast("int"))
    return out.withColumn("core", F.col("_in") == 1).drop("_in")


def bounded(nodes: DataFrame) -> DataFrame:
    """The rows that have a place, with the grid's bounds along the first two axes beside them, as `with_gaps` needs them."""
    rows = nodes.where(" and ".join(f"{a} is not null" for a in AXES))
    box = rows.agg(*[f(a).alias(f"_{k}_{a}") for a in AXES[:2] for f, k in ((F.min, "lo"), (F.max, "hi"))])  # one row
    return rows.crossJoin(F.broadcast(box))


def with_gaps(nodes: DataFrame, axis: str, reach: int, *keys: str) -> DataFrame:
    """The rows and, within reach of one along the axis and between `_lo` and `_hi` of that axis, a row for every place without one."""
    here, w = F.col(axis), line(axis, *keys)
    after = F.least(here + reach, F.lead(axis).over(w) - 1, F.col(f"_hi_{axis}"))
    before = F.greatest(here - reach, F.lag(axis).over(w) + reach + 1, F.col(f"_lo_{axis}"))
    places = F.concat(F.array(here), F.when(after > here, F.sequence(here + 1, after)).otherwise(F.array()), F.when(before < here, F.sequence(before, here - 1)).otherwise(F.array()))
    kept = [c for c in nodes.columns if c in keys or c in AXES or c.startswith(("_lo_", "_hi_"))]
    rows = nodes.withColumn("_places", places).withColumn("_at", F.explode("_places")).drop("_places")
    return rows.select(*[(F.col("_at") if c == axis else F.col(c) if c in kept else F.when(F.col("_at") == here, F.col(c))).alias(c) for c in nodes.columns])


def box_sums(nodes: DataFrame, columns: list[str], reach: int, *keys: str, gaps: bool = True) -> DataFrame:
    """The columns summed over each node's (2 * reach + 1)-cube, one axis after the other; nodes that aren't there add nothing.

    Along the first two axes a sum is also kept at places without a node, since nodes beside them need it; without `gaps`
    it is not, which is right for nodes whose cube is full.
    """
    names = nodes.columns
    rows = nodes.withColumn("_node", F.lit(True))
    rows = bounded(rows) if gaps else rows.where(" and ".join(f"{a} is not null" for a in AXES))
    for a in AXES:
        if gaps and a != AXES[-1]:
            rows = with_gaps(rows, a, reach, *keys)
        w = line(a, *keys).rangeBetween(-reach, reach)
        rows = rows.withColumns({c: F.sum(c).over(w) for c in columns})
    return rows.where("_node").select(*names)


def weighted(value: str, axis: str, weights: dict[int, float], *keys: str) -> Column:
    """A weighted sum along an axis; beyond a line's ends the end's value is repeated."""
    w = line(axis, *keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = {-1: F.first(value).over(w), 1: F.last(value).over(w)}
    return sum((c * (F.col(value) if not k else F.coalesce(at(value, axis, k, *keys), ends[1 if k > 0 else -1])) for k, c in weights.items()), F.lit(0.0))


def gradient(nodes: DataFrame, value: str, valid: str, spacing: float, *keys: str) -> DataFrame:
    """Finite differences along each axis: central, one-sided beside a gap, null alone; `complete` if all are central."""
    v = F.when(F.col(valid), F.col(value))
    complete = F.lit(True)
    for a in AXES:
        lo, hi = at(v, a, -1, *keys), at(v, a, 1, *keys)
        d = F.when(lo.isNotNull() & hi.isNotNull(), (hi - lo) / (2 * spacing)).when(hi.isNotNull(), (hi - v) / spacing).when(lo.isNotNull(), (v - lo) / spacing)
        nodes = nodes.withColumn(f"d_{a}", F.when(F.col(valid), d))
        complete = complete & lo.isNotNull() & hi.isNotNull()
    return nodes.withColumn("complete", complete & F.col(valid))


def offsets(reach: int, centre: bool = False) -> Column:
    """An array of the (dx, dy, dz) within a cube."""
    r = range(-reach, reach + 1)
    every = [(a, b, c) for c in r for b in r for a in r if centre or (a, b, c) != (0, 0, 0)]
    return F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz")) for a, b, c in every])
