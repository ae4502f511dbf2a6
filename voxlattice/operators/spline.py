"""Cubic B-splines on the node grid: coefficients along the axes, then 16 weighted runs of nodes a point.

Beyond a border the field goes on by odd reflection, f(-i) = 2 f(0) - f(i), so linear fields are exact up to the border; for a
spline that means no curvature there, which closes each line's equations. Values must be dense: fill gaps before.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stencil import AXES
from .store import write

#: Cells beyond the border after which a point keeps the last value.
REACH = 10
#: Nodes of a line that are solved together, and how many on either side take part: a node's weight falls by 0.268 a step, to 1e-23
#: over these, so that the rest of a line doesn't show in a double.
LINE, BESIDE = 512, 40
#: Nodes of a line that a point meets in one row; LINE is a multiple of it.
RUN = 8
#: Nodes that Python works on at once.
AT_ONCE = 1_000_000


def solve_lines(f: np.ndarray) -> np.ndarray:
    """Coefficients of lines (rows): (c[i-1] + 4 c[i] + c[i+1]) / 6 = f[i] inside, c = f at both ends."""
    c = f.copy()
    n = f.shape[1]
    if n < 3:
        return c
    right = 6 * f[:, 1:-1]
    right[:, 0] -= f[:, 0]
    right[:, -1] -= f[:, -1]
    share = np.zeros(n - 2)
    share[0] = 0.25
    for i in range(1, n - 2):
        share[i] = 1 / (4 - share[i - 1])
    out = np.empty_like(right)
    out[:, 0] = right[:, 0] * share[0]
    for i in range(1, n - 2):
        out[:, i] = (right[:, i] - out[:, i - 1]) * share[i]
    for i in range(n - 4, -1, -1):
        out[:, i] -= share[i] * out[:, i + 1]
    c[:, 1:-1] = out
    return c


def _stretches(nodes: DataFrame, axis: str, low: int, high: int) -> DataFrame:
    """Coefficients along an axis, stretch by stretch of its lines: the other axes, `first`, `last` and number `n` of a stretch's own nodes,
    and `c` from node `start` on, one before the own nodes to two after them where the line has these.

    A stretch with a gap or a missing value is `bad`: null coefficients of its own nodes only, which are listed in `at`.
    """
    others, length, stretches = [a for a in AXES if a != axis], LINE, (high - low) // LINE + 1
    place = F.col(axis) - low
    near = F.sequence(F.greatest(F.floor((place - BESIDE) / LINE), F.lit(0)), F.least(F.floor((place + BESIDE) / LINE), F.lit(stretches - 1)))
    spread = nodes.select(*others, axis, "c", (F.explode(near) if stretches > 1 else F.lit(0).cast("long")).alias("block"))
    lines = spread.groupBy(*others, "block").agg(F.sort_array(F.collect_list(F.struct(axis, "c"))).alias("line"))
    lines = lines.select(*others, "block", F.transform("line", lambda p: p[axis]).alias("at"), F.transform("line", lambda p: p["c"]).alias("c"))

    def solve(at: np.ndarray, c: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of lines of one length: which have own nodes, their first, last and number, the start of their coefficients, bad ones, and which coefficients count."""
        whole = (np.diff(at, axis=1) == 1).all(1) & np.isfinite(c).all(1)
        c[~whole] = np.nan
        c[whole] = solve_lines(c[whole])
        own = (at - low) // length == block[:, None]
        first, last, n = own.argmax(1), at.shape[1] - 1 - own[:, ::-1].argmax(1), own.sum(1)
        i = np.arange(at.shape[1])
        kept = np.where(whole[:, None], (i >= first[:, None] - 1) & (i <= last[:, None] + 2), own)
        rows = np.arange(len(at))
        return n > 0, at[rows, first], at[rows, last], n, at[rows, kept.argmax(1)], ~whole, kept

    def run(batches):
        for batch in batches:
            at = 0
            sizes = np.diff(batch.column("at").offsets.to_numpy())
            while at < len(sizes):
                some = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), AT_ONCE, "right")))
                part = batch.slice(at, some)
                at += some
                counts = np.diff(part.column("at").offsets.to_numpy())
                begin = np.cumsum(counts) - counts
                places, values = part.column("at").flatten().to_numpy(zero_copy_only=False), part.column("c").flatten().to_numpy(zero_copy_only=False).astype(float)
                block = part.column("block").to_numpy()
                for size in np.unique(counts):
                    rows = np.flatnonzero(counts == size)
                    cells = begin[rows][:, None] + np.arange(size)
                    i, c = places[cells], values[cells]
                    there, first, last, n, start, bad, kept = solve(i, c, block[rows])
                    i, c, kept, rows = i[there], c[there], kept[there], rows[there]
                    ends = lambda k: pa.array(np.concatenate([[0], np.cumsum(k)]), pa.int32())
                    gaps = kept & bad[there][:, None]
                    yield pa.RecordBatch.from_arrays(
                        [*[part.column(a).take(pa.array(rows)) for a in others], *[pa.array(v[there], pa.int64()) for v in (first, last, n, start)], pa.array(bad[there])]
                        + [pa.ListArray.from_arrays(ends(kept.sum(1)), pa.array(c[kept], from_pandas=True)), pa.ListArray.from_arrays(ends(gaps.sum(1)), pa.array(i[gaps], pa.int64()))],
                        names=[*others, "first", "last", "n", "start", "bad", "c", "at"],
                    )

    out = lines.mapInArrow(run, ", ".join(f"{a} long" for a in others) + ", first long, last long, n long, start long, bad boolean, c array<double>, at array<long>")
    if stretches == 1:
        return out
    # a gap anywhere in a line voids all its stretches
    out = write(out)
    void = out.groupBy(*others).agg(F.bool_or("bad").alias("gap"), F.min("first").alias("lo"), F.max("last").alias("hi"), F.sum("n").alias("k")).where("gap or k <> hi - lo + 1").select(*others, F.lit(True).alias("void"))
    if not void.limit(1).count():
        return out
    nodes_of = F.when(F.col("bad"), F.col("at")).otherwise(F.sequence("first", "last"))
    lost = F.coalesce(F.col("void"), F.lit(False))
    out = out.join(void, others, "left").withColumn("at", F.when(lost, nodes_of).otherwise(F.col("at")))
    return out.withColumns({"bad": lost, "c": F.when(lost, F.transform("at", lambda i: F.lit(None).cast("double"))).otherwise(F.col("c"))}).drop("void")


def _nodes(stretches: DataFrame, axis: str) -> DataFrame:
    """(ix, iy, iz, c) of the own nodes of stretches."""
    own = F.when(F.col("bad"), F.transform("at", lambda i: F.struct(i.alias("i"), F.lit(None).cast("double").alias("c"))))
    own = own.otherwise(F.transform(F.sequence("first", "last"), lambda i: F.struct(i.alias("i"), F.get("c", (i - F.col("start")).cast("int")).alias("c"))))
    others = [a for a in AXES if a != axis]
    return stretches.select(*others, F.explode(own).alias("p")).select(*others, F.col("p.i").alias(axis), F.col("p.c").alias("c")).select(*AXES, "c")


def _runs(stretches: DataFrame, low: int, high: int) -> DataFrame:
    """(ix, iy, run, start, c): the coefficients that a cell of a run needs, from node `start` on; beyond the grid's ends 2 c(0) - c(1)."""
    s = stretches.where("not bad").select("ix", "iy", "first", "last", "start", "c")
    if low == high:  # a constant
        return s.select("ix", "iy", F.lit(0).cast("long").alias("run"), (F.col("start") - 1).alias("start"), F.array_repeat(F.get("c", F.lit(0)), 4).alias("c"))
    beyond = lambda a, b: F.array(2 * F.try_element_at("c", F.lit(a)) - F.try_element_at("c", F.lit(b)))
    s = s.withColumns({"head": F.when(F.col("first") == low, beyond(1, 2)).otherwise(F.array().cast("array<double>")), "tail": F.when(F.col("last") == high, beyond(-1, -2)).otherwise(F.array().cast("array<double>"))})
    s = s.select("ix", "iy", "first", "last", (F.col("start") - F.size("head")).alias("start"), F.concat("head", "c", "tail").alias("c"))
    runs = F.explode(F.sequence(F.floor((F.col("first") - low) / RUN), F.floor((F.col("last") - low) / RUN))).alias("run")
    s = s.select("ix", "iy", "start", "c", runs).withColumn("from", F.greatest("start", low + F.col("run") * RUN - 1))
    return s.select("ix", "iy", "run", F.col("from").alias("start"), F.slice("c", (F.col("from") - F.col("start") + 1).cast("int"), F.lit(RUN + 3)).alias("c"))


def _step(kept: Column, step: Callable[[Column], Column]) -> Column:
    """`step` of a value that is computed once, however often the step names it."""
    return F.get(F.transform(F.array(kept), step), F.lit(0))


def taps(g: Column, low: Column, high: Column) -> Column:
    """The nodes (i, w) along an axis whose weighted coefficients give the value at grid coordinate g.

    Place, cell and weights are steps of their own: written into one another they would grow with the product of their uses.
    """
    n = (high - low).cast("double")
    far = F.least(F.lit(float(REACH)), n)

    def reflect(u: Column) -> Column:
        beyond = (u < 0) | (u > n)
        r = F.when(u < 0, -u).when(u > n, 2 * n - u).otherwise(u)
        return F.struct(r.alias("r"), beyond.alias("beyond"), F.when(u < 0, low).otherwise(high).cast("long").alias("rim"))

    def cell(s: Column) -> Column:
        i = F.least(F.floor(s["r"]), F.greatest(n - 1, F.lit(0.0)).cast("long")).cast("double")
        return F.struct(s["r"].alias("r"), s["beyond"].alias("beyond"), s["rim"].alias("rim"), i.alias("i"))

    def weigh(s: Column) -> Column:
        t = s["r"] - s["i"]
        w = [(1 - t) * (1 - t) * (1 - t) / 6, (3 * t * t * t - 6 * t * t + 4) / 6, (-3 * t * t * t + 3 * t * t + 3 * t + 1) / 6, t * t * t / 6]
        return F.struct(s["beyond"].alias("beyond"), s["rim"].alias("rim"), s["i"].alias("i"), *[v.alias(f"w{k}") for k, v in enumerate(w)])

    def rows(s: Column) -> Column:
        i, side, w = s["i"], F.when(s["beyond"], -1.0).otherwise(1.0), [s[f"w{k}"] for k in range(4)]
        first, last = i == 0, i + 1 == n
        # a coefficient beyond the border is 2 c(0) - c(1)
        weights = [(F.when(first, i).otherwise(i - 1), F.when(first, 2 * w[0]).otherwise(w[0])), (i + 1, F.when(first, -w[0]).otherwise(0.0)), (i, w[1]), (i + 1, w[2]), (F.when(last, i + 1).otherwise(i + 2), F.when(last, 2 * w[3]).otherwise(w[3])), (i, F.when(last, -w[3]).otherwise(0.0))]
        out = [F.struct((low + k).cast("long").alias("i"), (side * v).alias("w")) for k, v in weights]
        return F.array(*out, F.struct(s["rim"].alias("i"), F.when(s["beyond"], 2.0).otherwise(0.0).alias("w")))

    u = F.greatest(F.least(g - low, n + far), -far)
    some = F.filter(_step(_step(_step(_step(u, reflect), cell), weigh), rows), lambda x: x["w"] != 0)
    return F.when(n > 0, some).otherwise(F.array(F.struct(low.cast("long").alias("i"), F.lit(1.0).alias("w"))))


def interpolate(points: DataFrame, nodes: DataFrame, value: str, ident: str = "pid") -> DataFrame:
    """(ident, value): the spline of a dense grid field at points (gx, gy, gz in cells of the grid); null beside missing values."""
    ends = nodes.agg(*[f(a).cast("long").alias(f"{a}_{k}") for a in AXES for f, k in ((F.min, "lo"), (F.max, "hi"))]).first()
    low, high = ({a: ends[f"{a}_{k}"] or 0 for a in AXES} for k in ("lo", "hi"))
    c = nodes.select(*[F.col(a).cast("long").alias(a) for a in AXES], F.col(value).cast("double").alias("c"))
    for a in AXES[:2]:
        c = _nodes(_stretches(c, a, low[a], high[a]), a)
    c = _runs(_stretches(c, "iz", low["iz"], high["iz"]), low["iz"], high["iz"])

    p = points.select(ident, "gx", "gy", "gz")
    for a in AXES[:2]:
        p = p.withColumn(f"t{a}", taps(F.col(f"g{a[1]}").cast("double"), F.lit(low[a]), F.lit(high[a])))
    for a in AXES[:2]:
        p = p.withColumn(f"_{a}", F.explode(f"t{a}")).drop(f"t{a}")
    # along z a point outside is reflected, less twice the value on the rim: one place or two, each with its sign
    n = float(high["iz"] - low["iz"])
    u = F.greatest(F.least(F.col("gz").cast("double") - low["iz"], F.lit(n + min(REACH, n))), F.lit(-float(min(REACH, n))))
    place = lambda r, side: F.struct(r.alias("r"), F.lit(side).alias("side"))
    inside, below, above = F.array(place(F.col("u"), 1.0)), F.array(place(-F.col("u"), -1.0), place(F.lit(0.0), 2.0)), F.array(place(2 * n - F.col("u"), -1.0), place(F.lit(n), 2.0))
    p = p.withColumn("u", u).withColumn("_z", F.explode(F.when(F.col("u") < 0, below).when(F.col("u") > n, above).otherwise(inside)))
    cell = F.least(F.floor("r"), F.lit(max(n - 1, 0)).cast("long"))
    rows = p.select(ident, *[F.col(f"_{a}.i").alias(a) for a in AXES[:2]], (F.col("_ix.w") * F.col("_iy.w") * F.col("_z.side")).alias("w"), F.col("_z.r").alias("r"))
    rows = rows.withColumn("run", F.floor(cell / RUN)).join(c.hint("merge"), ["ix", "iy", "run"], "left")
    rows = rows.withColumn("i", cell).select(ident, "w", "c", (F.col("r") - F.col("i")).alias("t"), (F.col("i") + low["iz"] - F.col("start")).cast("int").alias("k"))
    t = F.col("t")
    weights = [(1 - t) * (1 - t) * (1 - t) / 6, (3 * t * t * t - 6 * t * t + 4) / 6, (-3 * t * t * t + 3 * t * t + 3 * t + 1) / 6, t * t * t / 6]
    # a node without weight may be missing
    part = sum((F.when(w != 0, w * F.get("c", F.col("k") + (j - 1))).otherwise(0.0) for j, w in enumerate(weights)), F.lit(0.0))
    sums = rows.withColumn("v", F.col("w") * part).groupBy(ident).agg(F.sum("v").alias("value"), F.count_if(F.col("v").isNull()).alias("lost"))
    return sums.select(ident, F.when(F.col("lost") == 0, F.col("value")).alias("value"))
