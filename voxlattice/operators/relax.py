"""Linear systems over grid neighbours, solved by conjugate gradients as stencil joins and sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, write
from .stencil import AXES

_SIDES = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]


def neighbour_sums(rows: DataFrame, keys: list[str], *sums: tuple[str, str]) -> DataFrame:
    """(keys, ix, iy, iz, names): at each place, sums of columns over the rows that touch it along an axis."""
    near = F.explode(F.array(*[F.struct(*[F.lit(k).alias(a) for a, k in zip(AXES, s)]) for s in _SIDES])).alias("d")
    spread = rows.select(*keys, *AXES, *[c for c, _ in sums], near)
    spread = spread.select(*keys, *[(F.col(a) + F.col(f"d.{a}")).alias(a) for a in AXES], *[c for c, _ in sums])
    return spread.groupBy(*keys, *AXES).agg(*[F.sum(c).alias(n) for c, n in sums])


def laplace_product(off: float, keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Adds ap = diagonal * p - off * (sum of p at the rows around), by one stencil join."""

    def product(state: DataFrame) -> DataFrame:
        around = neighbour_sums(state, keys, ("p", "_near"))
        ap = F.col("diagonal") * F.col("p") - off * F.coalesce("_near", F.lit(0.0))
        return state.join(around, [*keys, *AXES], "left").withColumn("ap", ap).drop("_near")

    return product


def conjugate_gradient(rows: DataFrame, product: Callable[[DataFrame], DataFrame], keys: list[str], tolerance: float = 1e-10, patience: int = 100) -> DataFrame:
    """rows (keys, ix, iy, iz, node_id, diagonal, b) with `solution` and `residual`: A x = b, where product(rows) adds ap = A p.

    A is symmetric and positive. The systems of all keys run side by side. A round is one product and one sum over each key,
    written to the shared folder; the round before is deleted then, and the driver sees a row a key. Rounds end when every
    key's residual is within the tolerance of its b, or has not fallen for `patience` rounds; `residual` tells which.
    A column `start`, if there is one, says where x begins.
    """
    if "start" in rows.columns:
        begun = product(rows.withColumn("p", F.col("start"))).withColumns({"x": F.col("start"), "r": F.col("b") - F.col("ap")})
        rows = rows.drop("start")
        state = begun.select(*rows.columns, "x", "r", (F.col("r") / F.col("diagonal")).alias("p"))
    else:
        state = rows.withColumns({"x": F.lit(0.0), "r": F.col("b"), "p": F.col("b") / F.col("diagonal")})
    best, since, before = float("inf"), 0, ()
    while True:
        state = write(product(state))
        discard(*before)
        total = lambda c: F.sum(c / F.col("diagonal"))
        r, ap = F.col("r"), F.col("ap")
        sums = state.groupBy(*keys).agg(total(r * r).alias("rz"), F.sum(F.col("p") * ap).alias("pap"), total(r * ap).alias("rap"), total(ap * ap).alias("aap"), F.sqrt(F.sum(r * r)).alias("_r"), F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("_b"))
        sums = write(sums.withColumn("left", F.when(F.col("_b") > 0, F.col("_r") / F.col("_b")).otherwise(0.0)))
        worst = sums.agg(F.max("left")).first()[0] or 0.0
        best, since = (worst, 0) if worst < best else (best, since + 1)
        if worst <= tolerance or since >= patience:
            return state.join(sums.select(*keys, F.col("left").alias("residual")), keys).select(*rows.columns, F.col("x").alias("solution"), "residual")
        # what the sum over the new residual will be follows from this round's sums
        step = F.when((F.col("pap") > 0) & (F.col("left") > tolerance), F.col("rz") / F.col("pap")).otherwise(0.0)
        after = F.col("rz") - 2 * F.col("_step") * F.col("rap") + F.col("_step") * F.col("_step") * F.col("aap")
        before = (state, sums)
        sums = sums.withColumn("_step", step).withColumn("_turn", F.when(F.col("rz") > 0, F.greatest(after, F.lit(0.0)) / F.col("rz")).otherwise(0.0))
        j = state.join(sums.select(*keys, "_step", "_turn"), keys)
        new_r = r - F.col("_step") * ap
        state = j.select(*rows.columns, (F.col("x") + F.col("_step") * F.col("p")).alias("x"), new_r.alias("r"), (new_r / F.col("diagonal") + F.col("_turn") * F.col("p")).alias("p"))
