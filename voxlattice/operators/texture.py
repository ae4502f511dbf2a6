"""Correlation lengths of profiles and decisions over sizes, by window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def crossings(profiles: DataFrame, thresholds: tuple[float, ...], *keys: str) -> DataFrame:
    """(keys, threshold, value, status): the first strict downward crossing of y over lag through each threshold.

    An exact hit gives its own lag ('plateau' if the sample before equals it too). The search ends at the first null.
    Fewer than two samples, or a start below the threshold, are 'invalid'.
    """
    w = Window.partitionBy(*keys).orderBy("lag")
    ahead = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = profiles.withColumn("_gap", F.max(F.col("y").isNull().cast("int")).over(ahead)).where("_gap = 0")
    p = p.withColumns({"_n": F.count("*").over(Window.partitionBy(*keys)), "_y0": F.lag("y").over(w), "_y1": F.lead("y").over(w), "_x1": F.lead("lag").over(w), "_first": F.first("y").over(w)})
    p = p.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    hit = (F.col("y") >= F.col("threshold")) & (F.col("_y1") < F.col("threshold"))
    at = F.when(F.col("y") == F.col("threshold"), F.col("lag").cast("double")).otherwise(F.col("lag") + (F.col("y") - F.col("threshold")) / (F.col("y") - F.col("_y1")) * (F.col("_x1") - F.col("lag")))
    flat = (F.col("y") == F.col("threshold")) & (F.col("_y0") == F.col("threshold"))
    first = F.min(F.when(hit, F.struct("lag", at.alias("value"), F.when(flat, "plateau").otherwise("crossed").alias("status")))).alias("c")
    bad = F.max((F.col("_n") < 2) | (F.col("_first") < F.col("threshold"))).alias("bad")
    out = p.groupBy(*keys, "threshold").agg(first, bad)
    return out.select(*keys, "threshold", F.when(~F.col("bad"), F.col("c.value")).alias("value"), F.when(F.col("bad"), "invalid").otherwise(F.coalesce("c.status", F.lit("not_crossed"))).alias("status"))


def plateau(levels: DataFrame, key: str, reference_sizes: int, absolute: float, relative: float, span: float) -> DataFrame:
    """(key, reference, tolerance, settled): the least size from which every mean stays in the band; null if none does."""
    order = Window.partitionBy(key).orderBy("size")
    last = Window.partitionBy(key).orderBy(F.desc("size"))
    finite = levels.where(F.col("mean").isNotNull()).withColumn("_k", F.row_number().over(last)).where(F.col("_k") <= reference_sizes)
    ref = finite.groupBy(key).agg(F.avg("mean").alias("reference")).withColumn("tolerance", absolute + relative * F.abs("reference"))
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    c = levels.join(ref, key).withColumns({"_worst": F.max(F.abs(F.col("mean") - F.col("reference"))).over(after), "_all": F.min(F.col("mean").isNotNull().cast("int")).over(after), "_top": F.max("size").over(Window.partitionBy(key))})
    ok = (F.col("_all") == 1) & (F.col("_worst") <= F.col("tolerance")) & (F.col("_top") >= span * F.col("size")) & (F.col("spread").isNull() | (F.col("spread") <= F.col("tolerance")))
    return c.groupBy(key, "reference", "tolerance").agg(F.min(F.when(ok, F.col("size"))).alias("settled"))


def cv_window(levels: DataFrame, key: str, window: int, cv: float, absolute: float) -> DataFrame:
    """(key, settled, reference): the first of `window` consecutive stable lengths whose later windows are stable too.

    A later window with a missing length breaks the persistence, one with a mean of zero doesn't.
    """
    order = Window.partitionBy(key).orderBy("size")
    back = order.rowsBetween(-(window - 1), 0)
    w = levels.withColumns({"_start": F.first("size").over(back), "_rows": F.count("*").over(back), "_k": F.count("mean").over(back), "_mu": F.avg("mean").over(back), "_sd": F.stddev_pop("mean").over(back)}).where(F.col("_rows") == window)
    stable = F.when(F.col("_k") < window, F.lit(False)).when(F.col("_mu") <= 1e-12, F.lit(None)).otherwise((F.col("_sd") / F.col("_mu") <= cv) | (F.col("_sd") <= absolute))
    w = w.withColumn("_stable", stable)
    w = w.withColumn("_holds", F.min(F.coalesce("_stable", F.lit(True)).cast("int")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)) == 1)
    good = F.coalesce(F.col("_stable"), F.lit(False)) & F.col("_holds")
    first = F.min(F.when(good, F.struct("size", F.col("_start").alias("start"), F.col("_mu").alias("mu")))).alias("f")
    return w.groupBy(key).agg(first).select(key, F.col("f.start").alias("settled"), F.col("f.mu").alias("reference"))
