"""Sharding by longest processing time: groups of equal texts, largest first, to the least-loaded shard of a heap."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

#: Parts in which groups of one size are numbered, so that a very common size is not one task's work.
PARTS = 256


def lpt(classes: list[tuple[int, int]], shards: int) -> dict[int, list[int]]:
    """Longest processing time over (size, number of groups): how many groups of each size every shard gets.

    By falling size each group goes to the shard with the least load so far (ties: the smaller number). Groups of one
    size that the heap would hand out below a common level are counted at once, the rest one by one.
    """
    loads = [(0, k) for k in range(shards)]
    out = {}
    for size, count in sorted(classes, reverse=True):
        given = [0] * shards
        if count > 2 * shards:
            below = lambda level: sum(max(0, -(-(level - load) // size)) for load, _ in loads)  # noqa: B023, E731
            lo, hi = loads[0][0], loads[0][0] + size * count
            while lo < hi:  # the highest level that so many groups do not pass
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if below(mid) <= count else (lo, mid - 1)
            for load, k in loads:
                given[k] = max(0, -(-(lo - load) // size))
            loads = [(load + given[k] * size, k) for load, k in loads]
            heapq.heapify(loads)
        for _ in range(count - sum(given)):
            load, k = heapq.heappop(loads)
            given[k] += 1
            heapq.heappush(loads, (load + size, k))
        out[size] = given
    return out


def shard(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; equal texts share a shard, bytes are near equal.

    size is the text's UTF-8 bytes plus 1; a null text counts as empty and is grouped with empty ones. Slots number a
    shard's rows without gaps from 0. Rows may repeat, ids may be null: each row gets its own slot. An empty table
    gives no rows. Every group goes through the heap; the driver holds one (size, number of groups) pair for each
    different size of a group, of which there are fewer than the root of twice the bytes.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("crc"), F.unhex(F.sha2(body, 256)).alias("digest"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    base = C.materialise(base, "rows")
    groups = C.materialise(base.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("count")).withColumn("deal", F.pmod(F.xxhash64("digest"), F.lit(PARTS))), "groups")
    classes = groups.groupBy("bytes").agg(F.count("*").alias("n")).collect()
    given = lpt([(r["bytes"], r["n"]) for r in classes], shards)
    ends = [(n, [sum(c[: k + 1]) for k in range(shards)]) for n, c in given.items()]
    quota = C.small(spark.createDataFrame(ends, "bytes long, ends array<long>"), 4 * len(ends))  # a row is as long as four narrow ones
    # groups of one size are alike: number them, and let the numbers fall into the shards' shares
    dealt = groups.groupBy("bytes", "deal").agg(F.count("*").alias("n"))
    before = dealt.select("bytes", "deal", (F.sum("n").over(Window.partitionBy("bytes").orderBy("deal")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("bytes", "deal").orderBy("digest")) - 1
    placed = groups.withColumn("number", number).join(before, ["bytes", "deal"]).join(quota, "bytes")
    placed = placed.select("digest", "count", F.size(F.filter("ends", lambda e: e <= F.col("number") + F.col("before"))).alias("shard"))
    placed = C.materialise(placed, "placed")
    total = placed.agg(F.sum("count")).first()[0] or 0
    rows = C.salted_join(base, placed.drop("count"), ["digest"], placed.select("digest", "count"), total, ["at"])
    # a shard is too much for one task: number rows within (input partition, shard), then add what earlier partitions hold
    held = rows.groupBy("part", "shard").agg(F.count("*").alias("c"))
    before = held.select("part", "shard", (F.sum("c").over(Window.partitionBy("shard").orderBy("part")) - F.col("c")).alias("before"))
    local = F.row_number().over(Window.partitionBy("part", "shard").orderBy("at")) - 1
    rows = rows.select("doc", "size", "crc", "shard", "part", local.alias("local")).join(before, ["part", "shard"])
    return rows.select(F.col("doc").alias(doc_id), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("local")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
