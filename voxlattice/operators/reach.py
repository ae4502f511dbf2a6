"""Neighbourhoods of 3x3x3 nodes as columns: values as arrays, cut edges as bit masks, and what a node reaches in its window.

Cell (dx, dy, dz) of a window is bit and array place (dz + 1) * 9 + (dy + 1) * 3 + dx + 1. Everything is gathered by three
passes along grid lines, so no node is copied 27 times and nothing is joined.
"""

from __future__ import annotations

from itertools import permutations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stencil import AXES, bounded, line, with_gaps

CENTRE = 13
STEPS = {"ix": 1, "iy": 3, "iz": 9}
CELLS = [(dx, dy, dz) for dz, dy, dx in product((-1, 0, 1), repeat=3)]


def cells(test) -> int:
    """The mask of the cells for which test(dx, dy, dz) holds."""
    return sum(1 << k for k, c in enumerate(CELLS) if test(*c))


#: Cells whose step along an axis stays inside the window.
INNER = {"ix": cells(lambda dx, dy, dz: dx < 1), "iy": cells(lambda dx, dy, dz: dy < 1), "iz": cells(lambda dx, dy, dz: dz < 1)}


def _shifted(value: Column, axis: str, step: int, keys: tuple[str, ...]) -> Column:
    return value if step == 0 else F.first(value).over(line(axis, *keys).rangeBetween(step, step))


def around(nodes: DataFrame, columns: list[str], *keys: str, clamp: bool = False, gaps: bool = False) -> DataFrame:
    """Columns <name>_around: the 27 values of each node's window; null where there is no node, or with `clamp` the nearest one's.

    With `gaps` values are also passed on over places of the grid without a node; without it all nodes have to be rows.
    """
    held = nodes.withColumns({f"{c}_around": F.array(c) for c in columns})
    held = bounded(held.withColumn("_node", F.lit(True))) if gaps else held
    for k, a in enumerate(AXES):
        held = with_gaps(held, a, 1, *keys) if gaps and a != AXES[-1] else held
        none = lambda c, n=3**k: F.array_repeat(F.lit(None).cast(nodes.schema[c].dataType), n)
        own = lambda c: F.coalesce(f"{c}_around", none(c)) if gaps else F.col(f"{c}_around")  # noqa: B023, E731
        side = lambda c, s: F.coalesce(_shifted(F.col(f"{c}_around"), a, s, keys), own(c) if clamp else none(c))  # noqa: B023, E731
        held = held.withColumns({f"{c}_around": F.concat(side(c, -1), own(c), side(c, 1)) for c in columns})
    return held.where("_node").select(*nodes.columns, *[f"{c}_around" for c in columns]) if gaps else held


def window_masks(nodes: DataFrame, flags: list[str], *keys: str) -> DataFrame:
    """Columns <flag>_mask: the cells of each node's window whose node has the flag."""
    held = nodes.withColumns({f"{c}_mask": F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in flags})
    for a in AXES:
        part = lambda c, s: F.shiftleft(F.coalesce(_shifted(F.col(f"{c}_mask"), a, s, keys), F.lit(0).cast("long")), STEPS[a] * (s + 1))  # noqa: B023, E731
        held = held.withColumns({f"{c}_mask": part(c, -1).bitwiseOR(part(c, 0)).bitwiseOR(part(c, 1)) for c in flags})
    return held


def _edges(axis: str) -> Column:
    """Cells from which the edge along an axis leads to another cell of the window."""
    return F.col(f"ok_{axis}_mask").bitwiseAND(F.lit(INNER[axis]))


def _step(held: Column, axis: str) -> Column:
    """What is reached from `held` by one step along an axis, either way."""
    e, n = _edges(axis), STEPS[axis]
    return F.shiftleft(held.bitwiseAND(e), n).bitwiseOR(F.shiftright(held, n).bitwiseAND(e))


def reachable(nodes: DataFrame, *keys: str) -> DataFrame:
    """Masks of what each node reaches inside its window over uncut edges.

    nodes have ok_ix, ok_iy and ok_iz: whether the edge to the next node along that axis exists and is uncut.
    `flood` takes any way inside the window; `direct` only ways that use each axis once, in some order. Both hold the
    node itself.
    """
    held = window_masks(nodes, [f"ok_{a}" for a in AXES], *keys)
    start = F.lit(1 << CENTRE).cast("long")

    def spread(m, _):
        out = m
        for a in AXES:
            out = out.bitwiseOR(_step(m, a))
        return out

    # no way inside the window has more than 26 steps
    flood = F.aggregate(F.sequence(F.lit(1), F.lit(26)), start, spread)
    held = held.withColumn("flood", flood)
    names = []
    for order in permutations(AXES):
        at: Column = start
        for k, a in enumerate(order):
            name = "_" + "".join(x[1] for x in order[: k + 1])
            if name not in names:
                names.append(name)
                held = held.withColumn(name, at.bitwiseOR(_step(at, a)))
            at = F.col(name)
    last = [n for n in names if len(n) == 4]
    direct = F.col(last[0])
    for n in last[1:]:
        direct = direct.bitwiseOR(F.col(n))
    return held.withColumn("direct", direct).drop(*names, *[f"ok_{a}_mask" for a in AXES])


def within(values: Column, mask: Column) -> Column:
    """The array's values at the cells of a mask, null elsewhere."""
    return F.transform(values, lambda v, k: F.when(F.call_function("shiftright", mask, k).bitwiseAND(F.lit(1)) == 1, v))


def median(values: Column) -> Column:
    """The middle of an array's values that are not null, or the mean of the two middle ones; null for none."""
    s = F.array_sort(F.array_compact(values))
    n = F.size(s)
    at = lambda k: F.get(s, k.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2


def plane_fit(nodes: DataFrame, value: str, valid: str, spacing: float, *keys: str, least: int = 5) -> DataFrame:
    """d_ix, d_iy, d_iz: the plane fitted to the valid nodes that a node reaches (`flood`), and `complete` if all 27 are.

    nodes have passed `reachable`. Fewer than `least` such nodes, or an invalid node, give null; an axis along which they
    don't extend gives 0; nodes that lie on a plane across the axes don't fix a gradient and give null.
    """
    held = window_masks(nodes.withColumn("_v", F.when(F.col(valid), F.col(value))).withColumn("_ok", F.col("_v").isNotNull()), ["_ok"], *keys)
    held = around(held, ["_v"], *keys)
    mask = F.col("flood").bitwiseAND(F.col("_ok_mask"))
    held = held.withColumn("_m", mask).withColumn("_u", within(F.col("_v_around"), mask))
    count = lambda c: F.bit_count(F.col("_m").bitwiseAND(F.lit(c))).cast("long")
    sign = lambda f: count(cells(lambda *d: f(*d) > 0)) - count(cells(lambda *d: f(*d) < 0))
    axis = {"x": lambda x, y, z: x, "y": lambda x, y, z: y, "z": lambda x, y, z: z}
    n = F.bit_count("_m").cast("long")
    weigh = lambda f: F.aggregate(F.zip_with("_u", F.array(*[F.lit(float(f(*c))) for c in CELLS]), lambda v, w: F.coalesce(v, F.lit(0.0)) * w), F.lit(0.0), lambda s, v: s + v)
    sums = {"n": n, "u": weigh(lambda *d: 1)}
    for a, f in axis.items():
        sums[a], sums[f"u{a}"], sums[f"{a}{a}"] = sign(f), weigh(f), count(cells(lambda *d, f=f: f(*d) != 0))
    for a, b in ("xy", "xz", "yz"):
        sums[a + b] = sign(lambda *d, f=axis[a], g=axis[b]: f(*d) * g(*d))
    held = held.withColumns({f"_s{k}": v for k, v in sums.items()})
    s = lambda k: F.col(f"_s{k}")
    # scaled by n, so that the matrix is of whole numbers
    m = {a + b: s("n") * s(a + b) - s(a) * s(b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")}
    m |= {a + a: F.when(m[a + a] == 0, 1).otherwise(m[a + a]) for a in "xyz"}
    r = {a: s("n") * s(f"u{a}") - s("u") * s(a) for a in "xyz"}
    held = held.withColumns({f"_m{k}": v for k, v in m.items()} | {f"_r{k}": v for k, v in r.items()})
    c = lambda a, b: F.col(f"_m{''.join(sorted(a + b))}")
    minor = lambda a, b, p, q: c(a, p) * c(b, q) - c(a, q) * c(b, p)
    inverse = {"xx": minor("y", "z", "y", "z"), "yy": minor("x", "z", "x", "z"), "zz": minor("x", "y", "x", "y"), "xy": -minor("x", "z", "y", "z"), "xz": minor("x", "y", "y", "z"), "yz": -minor("x", "y", "x", "z")}
    det = c("x", "x") * inverse["xx"] + c("x", "y") * inverse["xy"] + c("x", "z") * inverse["xz"]
    usable = F.col(valid) & (s("n") >= least) & (det != 0)
    d = {f"d_i{a}": F.when(usable, sum((inverse["".join(sorted(a + b))] * F.col(f"_r{b}") for b in "xyz"), F.lit(0.0)) / det / spacing) for a in "xyz"}
    held = held.withColumns(d | {"complete": F.col(valid) & (s("n") == 27)})
    return held.drop(*[x for x in held.columns if x.startswith("_")])


def fluctuation(nodes: DataFrame, value: str, *keys: str, eps: float = 0.1, least: int = 6) -> DataFrame:
    """`fluctuation`: a node's distance from the median of the neighbours it reaches directly, over the median of theirs.

    nodes have passed `reachable`; null values are left out. Nodes with fewer than `least` such neighbours are not judged
    and get 0, as do null ones.
    """
    mine = F.col("direct").bitwiseAND(F.lit(~(1 << CENTRE)))
    held = around(nodes, [value], *keys).withColumn("_near", within(F.col(f"{value}_around"), mine)).drop(f"{value}_around")
    held = held.withColumn("_count", F.size(F.array_compact("_near"))).withColumn("_off", F.abs(F.col(value) - median(F.col("_near")))).drop("_near")
    held = around(held, ["_off"], *keys)
    nf = F.col("_off") / (median(within(F.col("_off_around"), mine)) + eps)
    return held.withColumn("fluctuation", F.when(F.col("_count") >= least, F.coalesce(nf, F.lit(0.0))).otherwise(0.0)).drop("_count", "_off", "_off_around")
