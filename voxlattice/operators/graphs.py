"""Connected components and harmonic filling on the node grid."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import schwarz
from .relax import conjugate_gradient, laplace_product
from .stencil import AXES
from .store import write


def grid_components(nodes: DataFrame, ident: str = "node_id") -> DataFrame:
    """(node, component) of nodes that touch along an axis: the smallest id reachable, by rounds of least labels and jumps."""
    keys = nodes.select(F.col(ident).alias("node"), *AXES)
    sides = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.lit(c).alias("z")) for a, b, c in sides])).alias("d")
    shifted = keys.select(F.col("node").alias("other"), near, *AXES).select("other", *[(F.col(a) + F.col(f"d.{a[1]}")).alias(a) for a in AXES])
    edges = write(keys.join(shifted, list(AXES)).select("node", "other"))
    return least_labels(edges, write(keys.select("node", F.col("node").alias("component"))))


def least_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, component): the least label that each node reaches over edges (node, other), given both ways.

    Each round takes the least label among a node and its neighbours and then that label's own, and is written.
    """
    while True:
        least = edges.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("m"))
        step = labels.join(least, "node", "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("m", "component")).alias("component"))
        up = step.select(F.col("node").alias("parent"), F.col("component").alias("above"))
        new = write(step.join(up, F.col("component") == F.col("parent")).select("node", "was", F.least("component", "above").alias("component")))
        labels = new.select("node", "component")
        if not new.where("was <> component").limit(1).count():
            return labels


def harmonic_fill(nodes: DataFrame, value: str, ident: str = "node_id", largest: int = schwarz.SIZE**3) -> DataFrame:
    """(node, filled): missing nodes take the mean of their direct neighbours; see `harmonic_fills`."""
    return harmonic_fills(nodes, [value], ident, largest).select("node", F.col(value).alias("filled"))


def harmonic_fills(nodes: DataFrame, values: list[str], ident: str = "node_id", largest: int = schwarz.SIZE**3, tolerance: float = 1e-12) -> DataFrame:
    """(node, values): the nodes where the first value is missing, and with it all others, as means of their direct neighbours.

    All gaps and values are one grid system, solved in overlapping boxes of up to `largest` places; what reaches too far for
    that is finished by conjugate gradients over the missing nodes. A gap without a known neighbour stays null: beside the
    values runs a field that is one at every known node, which becomes one in all other gaps and nought there.
    """
    size = max(1, int(round(largest ** (1 / 3))))
    held = {v: f"_v{i}" for i, v in enumerate(values)}
    systems = [*held.values(), "_one"]
    rows = nodes.select(F.col(ident).alias("node_id"), *AXES, F.col(values[0]).isNull().alias("gap"), *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(c) for v, c in held.items()])
    schema = StructType([*rows.select("node_id", *AXES).schema.fields, *(StructField(c, DoubleType()) for c in ("diagonal", *(f"b_{s}" for s in systems)))])

    def sides(frame: pd.DataFrame, box: schwarz.Box) -> pd.DataFrame:
        """Of the box's own missing nodes the number of nodes around, and what the known ones add up to."""
        mine = box.own & frame["gap"].to_numpy(bool)
        known = box.columns["there"] & ~box.columns["gap"]
        out = frame.loc[mine, ["node_id", *AXES]].copy()
        total = lambda v: schwarz.around(v).ravel()[box.at[mine]]
        out["diagonal"] = np.maximum(total(box.columns["there"].astype(float)), 1.0)  # a node by itself is a gap by itself
        for c in held.values():
            out[f"b_{c}"] = total(np.where(known, box.columns[c], 0.0))
        return out.assign(b__one=total(known.astype(float)))

    gaps = schwarz.boxed(rows, [], size, 1, ["gap", *held.values()], sides, schema)

    def finish(state: DataFrame) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(s).alias("system"), F.col(f"b_{s}").alias("b"), F.col(f"x_{s}").alias("start")) for s in systems])).alias("s")
        stacked = write(state.select("node_id", *AXES, "diagonal", each).select("node_id", *AXES, "diagonal", "s.*"))
        found = conjugate_gradient(stacked, laplace_product(1.0, ["system"]), ["system"], tolerance)
        return found.groupBy("node_id").agg(*[F.max(F.when(F.col("system") == s, F.col("solution"))).alias(f"x_{s}") for s in systems])

    done = schwarz.solve(gaps, [], schwarz.laplace(1.0), ["diagonal"], systems, tolerance, finish, size)
    return done.select(F.col("node_id").alias("node"), *[F.when(F.col("x__one") > 0.5, F.col(f"x_{c}")).alias(v) for v, c in held.items()])
