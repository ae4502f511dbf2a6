"""Integral volumes: sums and lag products of any box from eight lookups, however large the box.

Prefix sums are built one axis after the other on two levels: within a brick in memory, and along a line of bricks by the
running sum of their last planes, so a shuffle holds planes of bricks, not voxels. After three axes a brick's value at a
voxel is the sum over everything up to it. Fields: 1, v, v * v, and v times the value h voxels on along an axis.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import KEY, map_blocks
from .store import write

_AXES = ("z", "y", "x")
_BRICK = "bz long, by long, bx long, data binary"


def fields(lags: int) -> list[tuple[str, int]]:
    """The fields of an integral volume in their order: (name, lag)."""
    return [("n", 0), ("v", 0), ("vv", 0), *((a, h) for a in _AXES for h in range(1, lags + 1))]


def _products(bricks: DataFrame, edge: int, lags: int, centre: float) -> DataFrame:
    def work(key, boxes):
        grown = boxes["data"] - centre
        own = grown[(slice(lags, lags + edge),) * 3]
        out = [np.isfinite(own).astype(float), own, own * own]
        for a in range(3):
            for h in range(1, lags + 1):
                at = [slice(lags, lags + edge)] * 3
                at[a] = slice(lags + h, lags + h + edge)
                out.append(own * grown[tuple(at)])
        return pd.DataFrame([(*key, np.nan_to_num(np.stack(out)).tobytes())], columns=["bz", "by", "bx", "data"])

    return map_blocks(bricks, edge, lags, work, _BRICK)


def _along(bricks: DataFrame, edge: int, k: int, axis: int) -> DataFrame:
    """Running sums along an axis: in every brick, then over the bricks before it on its line."""
    shape = (k, edge, edge, edge)

    def inside(batches):
        for f in batches:
            sums = [np.frombuffer(raw, float).reshape(shape).cumsum(axis + 1) for raw in f["data"]]
            yield f[KEY].assign(data=[s.tobytes() for s in sums], last=[np.take(s, -1, axis + 1).tobytes() for s in sums])

    held = write(bricks.mapInPandas(inside, f"{_BRICK}, last binary"))
    across = KEY[axis]

    def before(frame: pd.DataFrame) -> pd.DataFrame:
        """One line of bricks: what lies before each."""
        frame = frame.sort_values(across)
        total, out = np.zeros(k * edge * edge), []
        for raw in frame["last"]:
            out.append(total.tobytes())
            total = total + np.frombuffer(raw, float)
        return frame[KEY].assign(before=out)

    sums = held.select(*KEY, "last").groupBy(*[c for c in KEY if c != across]).applyInPandas(before, "bz long, by long, bx long, before binary")

    def add(batches):
        for f in batches:
            yield f[KEY].assign(data=[(np.frombuffer(d, float).reshape(shape) + np.expand_dims(np.frombuffer(b, float).reshape(k, edge, edge), axis + 1)).tobytes() for d, b in zip(f["data"], f["before"])])

    return held.select(*KEY, "data").join(sums, KEY).mapInPandas(add, _BRICK)


def integral_volume(bricks: DataFrame, edge: int, lags: int, centre: float = 0.0) -> DataFrame:
    """(bz, by, bx, data): prefix sums of all fields, float64 by field, z, y, x. `centre` is taken off the values before."""
    out = _products(bricks, edge, lags, centre)
    for axis in (2, 1, 0):
        out = _along(out, edge, len(fields(lags)), axis)
    return write(out)


def box_sums(integral: DataFrame, edge: int, lags: int, parts: DataFrame) -> DataFrame:
    """parts (part, field, z0, z1, y0, y1, x0, x1; ends exclusive) with `total`; null where a corner lies in no brick."""
    k = len(fields(lags))
    corner = [F.struct(*[(F.col(f"{a}{e}") - 1).alias(a) for a, e in zip(_AXES, ends)], F.lit((-1) ** (3 - sum(ends))).alias("sign")) for ends in np.ndindex(2, 2, 2)]
    c = parts.select("part", "field", F.explode(F.array(*corner)).alias("c")).select("part", "field", "c.*").where("z >= 0 and y >= 0 and x >= 0")
    # equal corners of many boxes are looked up once
    place = (F.pmod("z", F.lit(edge)) * edge + F.pmod("y", F.lit(edge))) * edge + F.pmod("x", F.lit(edge))
    c = write(c.select("part", "sign", *[F.floor(F.col(a) / edge).alias(f"b{a}") for a in _AXES], (F.col("field") * edge**3 + place).cast("int").alias("at")))
    wanted = c.select(*KEY, "at").distinct()

    def look(key, points: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(points):
            return pd.DataFrame({**{x: [] for x in KEY}, "at": [], "value": []})
        return points.assign(value=np.frombuffer(held["data"].iloc[0], float)[points["at"].to_numpy()])

    found = wanted.groupBy(*KEY).cogroup(integral.groupBy(*KEY)).applyInPandas(look, "bz long, by long, bx long, at int, value double")
    sums = c.join(found, [*KEY, "at"], "left").groupBy("part").agg(F.sum(F.col("sign") * F.col("value")).alias("total"), F.count_if(F.col("value").isNull()).alias("lost"))
    return parts.join(sums, "part").withColumn("total", F.when(F.col("lost") == 0, F.col("total"))).drop("lost")


def box_correlation(integral: DataFrame, edge: int, lags: int, boxes: DataFrame) -> DataFrame:
    """(box, axis, lag, pairs, rho): autocorrelation of each box (box, z0, z1, y0, y1, x0, x1) about its own mean.

    A pair counts where both voxels lie in the box. Boxes that hold a missing voxel are left out.
    """
    order = {f: i for i, f in enumerate(fields(lags))}
    bounds = [f"{a}{e}" for a in _AXES for e in (0, 1)]
    whole = [F.struct(F.lit(name).alias("kind"), F.lit("").alias("axis"), F.lit(0).alias("lag"), F.lit(order[name, 0]).alias("field"), *bounds) for name in ("n", "v", "vv")]
    for a in _AXES:
        for h in range(1, lags + 1):
            for kind, field, shift in (("product", order[a, h], {f"{a}1": -h}), ("first", order["v", 0], {f"{a}1": -h}), ("second", order["v", 0], {f"{a}0": h})):
                moved = [(F.col(b) + shift[b]).alias(b) if b in shift else F.col(b) for b in bounds]
                whole.append(F.struct(F.lit(kind).alias("kind"), F.lit(a).alias("axis"), F.lit(h).alias("lag"), F.lit(field).alias("field"), *moved))
    rows = boxes.select("box", *[F.col(b).cast("long").alias(b) for b in bounds])
    parts = rows.select("box", F.explode(F.array(*whole)).alias("p")).select("box", "p.*").where("z1 > z0 and y1 > y0 and x1 > x0")
    parts = write(parts.withColumn("part", F.concat_ws("/", F.col("box").cast("string"), "kind", "axis", F.col("lag").cast("string"))))
    sums = box_sums(integral, edge, lags, parts.drop("box", "kind", "axis", "lag")).select("part", "total", ((F.col("z1") - F.col("z0")) * (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))).alias("size"))
    sums = write(parts.select("part", "box", "kind", "axis", "lag").join(sums, "part"))
    pick = lambda kind, c="total": F.max(F.when(F.col("kind") == kind, F.col(c)))
    means = sums.where("axis = ''").groupBy("box").agg(pick("n").alias("n"), pick("n", "size").alias("size"), (pick("v") / pick("n")).alias("mean"), (pick("vv") / pick("n")).alias("square")).where("n = size")
    means = means.select("box", "n", "mean", (F.col("square") - F.col("mean") * F.col("mean")).alias("variance"))
    pairs = sums.where("axis <> ''").groupBy("box", "axis", "lag").agg(pick("product", "size").alias("pairs"), pick("product").alias("p"), (pick("first") + pick("second")).alias("s"))
    cov = F.col("p") / F.col("pairs") - F.col("mean") * F.col("s") / F.col("pairs") + F.col("mean") * F.col("mean")
    lagged = pairs.join(means, "box").select("box", "axis", "lag", "pairs", F.when(F.col("variance") > 0, cov / F.col("variance")).alias("rho"))
    zero = means.select("box", F.explode(F.array(*map(F.lit, _AXES))).alias("axis"), F.lit(0).alias("lag"), F.col("n").cast("long").alias("pairs"), F.when(F.col("variance") > 0, 1.0).alias("rho"))
    return lagged.union(zero)
