"""Frames as they arrive, in any number of batches and any order: a pair waits until its reference has a total.

Two forms with the same results. `advance` keeps totals and waiting pairs as tables partitioned by frame, so that a stream
and a batch share code. `totals` keeps them as keyed state, one key a block of nodes: a node's chain of frames never needs another node's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import store


def _stored(spark: SparkSession, folder: str, schema) -> DataFrame:
    try:
        return spark.read.parquet(folder)
    except Exception as e:  # nothing is stored yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], schema)


#: Nodes whose ids fall into one block of this many are followed together: a group of rows, or a state row that a task reads and writes once a batch.
BLOCK = 1000
_WAITING = "version long, node_id long, u double, frame long"


def waiting(spark: SparkSession, folder: str) -> DataFrame:
    """(frame, node_id, u) of the pairs that wait for their reference: the version that the pointer table names last."""
    current = _stored(spark, f"{folder}/pointer", "version long").agg(F.max("version")).first()[0]
    rows = _stored(spark, f"{folder}/waiting", _WAITING)
    return rows.where(F.col("version") == (current if current is not None else -1)).select("frame", "node_id", "u")


def _chains(key: tuple, new: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
    """Of one block of nodes the pairs that aren't stored: with their total where the reference has one by now, else as they are."""
    if not len(new):
        return pd.DataFrame({"node_id": [], "frame": [], "u": [], "done": []})
    alone = pd.isna(key[0])  # rows without a node are one node
    ref = new["ref"].to_numpy(np.int64)
    frame = np.concatenate([new["frame"].to_numpy(np.int64), have["frame"].to_numpy(np.int64)])
    node = np.zeros(len(frame), np.int64) if alone else np.concatenate([new["node_id"].to_numpy(np.int64), have["node"].to_numpy(np.int64)]) - int(key[0]) * BLOCK
    u = np.concatenate([new["u"].to_numpy(float), have["u_total"].to_numpy(float)])
    names, n = np.unique(np.concatenate([frame, ref])), len(new)
    pair = lambda node, frame: node * len(names) + np.searchsorted(names, frame)
    pairs = pair(node, frame)
    fresh = ~np.isin(pairs[:n], pairs[n:])
    done = np.arange(len(pairs)) >= n
    order = np.lexsort((~done, pairs))  # a stored pair before a new one
    wanted = pair(node[:n], ref)
    at = np.minimum(np.searchsorted(pairs[order], wanted), len(pairs) - 1)
    place = np.where(pairs[order][at] == wanted, order[at], -1)
    while True:
        ready = fresh & ~done[:n] & ((ref == 0) | ((place >= 0) & done[place]))
        if not ready.any():
            break
        u[:n][ready] += np.where(ref[ready] == 0, 0.0, u[place[ready]])
        done[:n] |= ready
    ids = [None] * int(fresh.sum()) if alone else node[:n][fresh] + int(key[0]) * BLOCK
    return pd.DataFrame({"node_id": pd.Series(ids, dtype="Int64"), "frame": frame[:n][fresh], "u": u[:n][fresh], "done": done[:n][fresh]})


def advance(new: DataFrame, schedule: DataFrame, folder: str) -> None:
    """Add pair displacements (frame, node_id, u) to the stored cumulative ones, parents before children.

    A pair whose reference is neither the root (frame 0) nor stored for its node waits, whatever other nodes of the frame
    have: rows of one frame may come in many batches, late or early. A stored (frame, node_id) stays as it is, so a batch
    may come twice. Of repeated pairs the new batch's row counts before one that waits, then the larger u. Frames that
    the schedule doesn't name wait as well. What waits is written as a new version before the pointer moves on to it, so
    a run that breaks off anywhere loses nothing: the next one starts from the version named last.
    """
    spark = new.sparkSession
    held = waiting(spark, folder).select("frame", "node_id", "u", F.lit(False).alias("fresh"))
    rows = held.unionByName(new.select("frame", "node_id", "u", F.lit(True).alias("fresh"))).groupBy("frame", "node_id").agg(F.max(F.struct("fresh", "u")).alias("m"))
    # the schedule has a row a frame
    rows = rows.select("frame", "node_id", F.col("m.u").alias("u")).join(F.broadcast(schedule), "frame", "left")
    done = _stored(spark, f"{folder}/total", "node_id long, u_total double, frame long")
    block = F.floor(F.col("node_id") / BLOCK)
    have = done.select("frame", F.col("node_id").alias("node"), "u_total").withColumn("_stored_block", F.floor(F.col("node") / BLOCK))
    scheduled = rows.where("ref is not null").withColumn("_block", block)
    # a node's chain never leaves its block, so all frames follow in one pass
    out = scheduled.groupBy("_block").cogroup(have.groupBy("_stored_block")).applyInPandas(_chains, "node_id long, frame long, u double, done boolean")
    out = store.write(out.withColumn("u", F.when(~F.isnan("u"), F.col("u"))))
    fresh = out.where("done").select("node_id", F.col("u").alias("u_total"), "frame")
    # a run that breaks off after this write finds these rows stored and leaves them
    if fresh.limit(1).count():
        fresh.write.mode("append").partitionBy("frame").parquet(f"{folder}/total")
    left = out.where("not done").select("frame", "node_id", "u").unionByName(rows.where("ref is null").join(done.select("frame", "node_id"), ["frame", "node_id"], "left_anti").select("frame", "node_id", "u"))
    version = (_stored(spark, f"{folder}/pointer", "version long").agg(F.max("version")).first()[0] or 0) + 1
    # an earlier run that broke off may have left part of this version: it is replaced
    left.select(F.lit(version).cast("long").alias("version"), "node_id", "u", "frame").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(f"{folder}/waiting")
    spark.range(version, version + 1).select(F.col("id").alias("version")).write.mode("append").parquet(f"{folder}/pointer")


def complete(total: DataFrame, expected: DataFrame) -> DataFrame:
    """(frame, nodes, complete): whether a frame has a total for every one of its `expected` (frame, nodes)."""
    have = total.groupBy("frame").agg(F.count("*").alias("have"))
    return expected.join(have, "frame", "left").select("frame", F.coalesce("have", F.lit(0)).alias("nodes"), (F.coalesce("have", F.lit(0)) >= F.col("nodes")).alias("complete"))


_STATE = np.dtype([("node_id", "i8"), ("frame", "i8"), ("u", "f8"), ("done", "?")])


class Chain(StatefulProcessor):
    """Keyed state of one block of nodes: (node, frame) with its total, or with the displacement of a pair that waits for its reference."""

    def __init__(self, reference: dict[int, int]):
        self.reference = reference

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("pairs", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([r[["node_id", "frame", "u"]] for r in rows], ignore_index=True)
        if pd.isna(key[0]):  # rows without a node are a block of their own
            new["node_id"] = 0
        new = new.astype({"node_id": "int64", "frame": "int64", "u": "float64"}).groupby(["node_id", "frame"], as_index=False)["u"].max().assign(done=False)
        raw = self.state.get() if self.state.exists() else None
        held = pd.DataFrame(np.frombuffer(bytes(raw[0]) if raw else b"", _STATE).copy())
        # a total that is out stays, and a new row replaces one that waits
        pairs = pd.concat([held[held["done"]], new, held[~held["done"]]], ignore_index=True).drop_duplicates(["node_id", "frame"], ignore_index=True)
        at = pd.MultiIndex.from_frame(pairs[["node_id", "frame"]])
        ref = np.array([-1 if (r := self.reference.get(f)) is None else r for f in pairs["frame"]], dtype="int64")
        known = np.array([self.reference.get(f) is not None for f in pairs["frame"]], dtype=bool)
        place = at.get_indexer(pd.MultiIndex.from_arrays([pairs["node_id"], ref]))
        u, done = pairs["u"].to_numpy().copy(), pairs["done"].to_numpy(dtype=bool).copy()
        before, root = done.copy(), known & (ref == 0)
        while True:
            ready = ~done & known & (root | ((place >= 0) & done[place]))
            if not ready.any():
                break
            u[ready] += np.where(root[ready], 0.0, u[place[ready]])
            done |= ready
        state = np.zeros(len(pairs), _STATE)
        state["node_id"], state["frame"], state["u"], state["done"] = pairs["node_id"], pairs["frame"], u, done
        self.state.update((state.tobytes(),))
        fresh = done & ~before
        if fresh.any():
            node = pairs["node_id"][fresh] if not pd.isna(key[0]) else pd.Series([None] * int(fresh.sum()), dtype=object)
            yield pd.DataFrame({"node_id": node.to_numpy(), "frame": pairs["frame"][fresh].to_numpy(), "u_total": u[fresh]})

    def close(self) -> None:
        pass


def totals(stream: DataFrame, schedule: DataFrame) -> DataFrame:
    """(node_id, frame, u_total) of a stream of pairs (frame, node_id, u), each once its reference is known.

    State is kept by blocks of nodes, so a frame's rows may come in any batches and a restart goes on from the query's
    checkpoint. Needs the RocksDB state store. A total that is out stays; of repeated pairs that wait, the last batch's counts.
    """
    reference = {r["frame"]: r["ref"] for r in schedule.select("frame", "ref").collect()}  # a row a frame
    blocks = stream.select("frame", "node_id", "u", F.floor(F.col("node_id") / BLOCK).alias("_block")).groupBy("_block")
    return blocks.transformWithStateInPandas(Chain(reference), "node_id long, frame long, u_total double", "Append", "None")


def follow(stream: DataFrame, schedule: DataFrame, folder: str, checkpoint: str, seen: Callable[[int], None] | None = None):
    """Start a query over a stream of pair displacements; each batch advances the stored frames (progress through `seen`)."""

    def step(batch: DataFrame, number: int) -> None:
        advance(batch, schedule, folder)
        if seen:
            seen(number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
