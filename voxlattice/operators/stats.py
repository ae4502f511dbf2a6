"""Statistics of node fields: values that are null or not finite are missing, deviations are of the population, percentiles interpolate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store


#: Values of one key that a task may count exactly in memory.
COUNTED = 200_000
BINS = 1024


def quantiles(rows: DataFrame, value: str, probs: dict[str, float], *keys: str, most: int = COUNTED) -> DataFrame:
    """(keys, names of probs): exact quantiles, interpolated between neighbouring ranks; missing values are left out.

    rows should be a stored table. Where no key has more than `most` values each key's are counted in memory, once for
    all quantiles. Beyond it every wanted rank is bracketed instead: a histogram of each bracket, made by all tasks
    together, says which bin holds the rank, and that bin's extremes are the next bracket, until they are equal. Both
    give the same numbers.
    """
    rows = rows.select(*keys, finite(value).alias("v")).where("v is not null")
    ends = store.write(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    if (ends.agg(F.max("n")).first()[0] or 0) <= most:
        return _counted(rows, probs, *keys)
    return _bracketed(rows, ends, probs, *keys)


def finite(value: str) -> Column:
    """The value, or null where it isn't a finite number."""
    v = F.col(value).cast("double")
    return F.when(F.abs(v) < float("inf"), v)


def _counted(rows: DataFrame, probs: dict[str, float], *keys: str) -> DataFrame:
    at = F.percentile("v", F.array(*[F.lit(float(p)) for p in probs.values()]))
    return rows.groupBy(*keys).agg(at.alias("at")).select(*keys, *[F.get("at", F.lit(k)).alias(name) for k, name in enumerate(probs)])


def _bracketed(rows: DataFrame, ends: DataFrame, probs: dict[str, float], *keys: str) -> DataFrame:
    low = {name: F.floor(F.lit(p) * (F.col("n") - 1)) for name, p in probs.items()}
    high = {name: F.ceil(F.lit(p) * (F.col("n") - 1)) for name, p in probs.items()}
    wanted = F.explode(F.array_distinct(F.array(*low.values(), *high.values()))).alias("rank")
    brackets = ends.select(*keys, wanted, "lo", "hi", F.lit(0).cast("long").alias("below"))
    while brackets.where("lo < hi").limit(1).count():
        spans = brackets.where("lo < hi").select(*keys, "lo", "hi").distinct()
        # halves, since the distance of the extremes may not be a double; a bracket of neighbouring numbers splits at its lower end
        share = F.try_divide(F.col("v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)
        place = F.when(F.col("v") == F.col("lo"), -1).otherwise(F.least(F.lit(BINS - 1), F.floor(F.coalesce(share, F.lit(0.0)) * BINS)))
        # a key has twice as many spans as wanted quantiles at most
        inside = rows.join(spans, list(keys)).where("v between lo and hi").groupBy(*keys, "lo", "hi", place.alias("bin"))
        bins = inside.agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("greatest"))
        run = Window.partitionBy(*keys, "lo", "hi").orderBy("bin")
        bins = bins.withColumn("before", F.sum("c").over(run) - F.col("c"))
        at = F.col("rank") - F.col("below")
        found = brackets.join(bins, [*keys, "lo", "hi"], "left").where("lo = hi or (rank - below >= before and rank - below < before + c)")
        brackets = store.write(found.select(*keys, "rank", F.coalesce("least", "lo").alias("lo"), F.coalesce("greatest", "hi").alias("hi"), (F.col("below") + F.coalesce("before", F.lit(0))).alias("below")))
    ranks = brackets.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("at"))
    out = ends.join(ranks, list(keys))
    part = lambda name: (1 - (probs[name] * (F.col("n") - 1) - low[name])) * F.element_at("at", low[name]) + (probs[name] * (F.col("n") - 1) - low[name]) * F.element_at("at", high[name])
    return out.select(*keys, *[part(name).alias(name) for name in probs])


def summarize(df: DataFrame, value: str, *keys: str, most: int = COUNTED) -> DataFrame:
    """One row a key: count, moments, quantiles, extremes and the robust deviation 1.4826 * median |v - median|.

    Keys without a value have a count of 0 and nulls.
    """
    rows = store.write(df.select(*keys, finite(value).alias("v")))
    v = F.col("v")
    a = store.write(rows.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.sqrt(F.avg(v * v)).alias("rms")))
    rows, probs = rows.where("v is not null"), {"median": 0.5, "p05": 0.05, "p95": 0.95}
    few = (a.agg(F.max("n")).first()[0] or 0) <= most
    held = a.where("n > 0").select(*keys, "n", F.col("min").alias("lo"), F.col("max").alias("hi"))
    q = store.write(_counted(rows, probs, *keys) if few else _bracketed(rows, held, probs, *keys))
    off = rows.join(q.select(*keys, "median"), list(keys)) if keys else rows.crossJoin(F.broadcast(q.select("median")))
    off = off.select(*keys, F.abs(v - F.col("median")).alias("v"))
    mad = (_counted(off, {"mad": 0.5}, *keys) if few else quantiles(store.write(off), "v", {"mad": 0.5}, *keys, most=most)).select(*keys, (1.4826 * F.col("mad")).alias("robust_std"))
    out = a.join(q, list(keys), "left").join(mad, list(keys), "left") if keys else a.crossJoin(F.broadcast(q)).crossJoin(F.broadcast(mad))
    return out.select(*keys, "n", "mean", "std", "median", "p05", "p95", "min", "max", "rms", "robust_std")


def unpivot(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    return df.unpivot(keys, fields, "field", "value")
