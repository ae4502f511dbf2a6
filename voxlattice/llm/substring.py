"""Substring deduplication with a count-min prefilter.

A window is a run of consecutive words. Each window is represented by the least hash among its short word runs: equal
windows have equal representatives, and neighbouring windows mostly share one, so a sketch of representatives
overestimates every window's count of documents at a fraction of the windows. Partitions' sketches are merged; a
second pass groups exactly only the windows whose estimate is two or more. None is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_U = np.uint64
GRAM = 8


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Sliding minimum over `width` values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _windows(data: np.ndarray, offsets: np.ndarray, window: int):
    """Word hashes, each text's first word, window starts, their texts and representatives."""
    _, _, words, first = C.hash_words(data, offsets, C.PLAIN)
    starts_in = np.maximum(np.diff(first) - window + 1, 0)
    doc = np.repeat(np.arange(len(starts_in)), starts_in)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(starts_in) - starts_in, starts_in) + first[:-1][doc]
    if not len(at):
        return words, first, at, doc, words[:0]
    gram = min(GRAM, window)
    return words, first, at, doc, _least(C.runs(words, gram, 3), window - gram + 1)[at]


def _sketch(docs: DataFrame, text: str, window: int) -> C.Bitmap:
    #: about one representative in 22 windows; eight cells each, twice
    width = C.sketch_width(C.text_bytes(docs, text) / 6 / 22, 8)

    def count(batches):
        found = []
        for batch in batches:
            for part in C.slices(batch, text):
                _, _, _, doc, rep = _windows(*C.text_buffers(part.column(text)), window)
                if not len(rep):
                    continue
                new = np.append(True, (rep[1:] != rep[:-1]) | (doc[1:] != doc[:-1]))
                doc, rep = doc[new], rep[new]
                order = np.lexsort((rep, doc))
                doc, rep = doc[order], rep[order]
                found.append(rep[np.append(True, (rep[1:] != rep[:-1]) | (doc[1:] != doc[:-1]))])
            if sum(map(len, found)) > 2_000_000:
                yield blocks(found)
                found = []
        yield blocks(found)

    def blocks(found):
        rows = [x for r in range(2) for x in C.sketch_blocks(C.cells(np.concatenate([np.zeros(0, _U), *found]), width, r), 2)]
        return pa.RecordBatch.from_pydict({"block": pa.array([b for b, _ in rows], pa.int32()), "cells": pa.array([x for _, x in rows], pa.binary())})

    return C.Bitmap(width, 2, C.merge_sketches(docs.select(text).mapInArrow(count, "block int, cells binary"), C.twice))


def remove_repeats(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, removed array<struct<a,b>>, kept_text) of every row.

    Words are runs of non-blank characters. A word is removed if a window of `window` words covers it whose word
    sequence also starts in a row with a smaller id; windows are judged on the input. removed lists word spans [a, b)
    in order; kept_text joins the other words by one space. A null text has no words. Rows with a null id neither
    lose words nor make others lose them; rows that share an id do not affect each other.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc"), C.text_key(text).alias("h"), F.col(text).alias("body"))
    sketch = spark.sparkContext.broadcast(_sketch(rows, "body", window))

    def flagged(part):
        words, first, at, doc, rep = _windows(*C.text_buffers(part.column("body")), window)
        keep = sketch.value.repeated(rep)
        return words, first, at[keep], doc[keep]

    def occurrences(batches):
        for batch in batches:
            for part in C.slices(batch, "body"):
                words, first, at, doc = flagged(part)
                if not len(at):
                    continue
                ids, h = part.column("doc"), part.column("h").to_numpy(zero_copy_only=False)
                one, two = (C.runs(words, window, seed)[at] for seed in (1, 2))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(h[doc]), pa.array((at - first[:-1][doc]).astype(np.int32)), pa.array(one.view(np.int64)), pa.array((two >> _U(32)).astype(np.uint32).view(np.int32))], names=["doc", "h", "pos", "k1", "k2"])

    def whole(batches):  # rows without a window that may repeat
        for batch in batches:
            for part in C.slices(batch, "body"):
                _, _, _, doc = flagged(part)
                rest = np.setdiff1d(np.arange(part.num_rows), doc)
                taken = part.take(pa.array(rest))
                kept = [(t or "").encode().split() for t in taken.column("body").to_pylist()]
                yield pa.RecordBatch.from_arrays([taken.column("doc"), pa.array([len(w) for w in kept], pa.int64()), pa.array([[] for _ in kept], spans), pa.array([b" ".join(w).decode() for w in kept], pa.string())], names=["doc", "n_words", "removed", "kept_text"])

    def open_rows(batches):
        for batch in batches:
            for part in C.slices(batch, "body"):
                yield part.take(pa.array(np.unique(flagged(part)[3])))

    def cut(batches):
        for batch in batches:
            for part in C.slices(batch, "body"):
                n, removed, kept = [], [], []
                for t, starts in zip(part.column("body").to_pylist(), part.column("starts")):
                    w = t.encode().split()
                    gone = np.zeros(len(w) + 1, np.int32)
                    if starts.is_valid:
                        s = starts.values.to_numpy()
                        np.add.at(gone, s, 1)
                        np.add.at(gone, s + window, -1)
                    gone = np.cumsum(gone)[:-1] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                    n.append(len(w))
                    removed.append([{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2])])
                    kept.append(b" ".join([x for x, g in zip(w, gone) if not g]).decode())
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(n, pa.int64()), pa.array(removed, spans), pa.array(kept, pa.string())], names=["doc", "n_words", "removed", "kept_text"])

    spans = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    schema = f"doc {kind}, n_words long, removed array<struct<a:long,b:long>>, kept_text string"
    found = rows.mapInArrow(occurrences, f"doc {kind}, h long, pos int, k1 long, k2 int").where("doc is not null")
    least = found.groupBy("k1", "k2").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("count")).where("least < most").drop("most")
    least = C.materialise(least, "repeated-windows")
    total = least.agg(F.sum("count")).first()[0] or 0
    repeats = C.salted_join(found, least.drop("count"), ["k1", "k2"], least.drop("least"), total, ["doc", "pos"]).where("doc > least").groupBy("doc", "h").agg(F.collect_list("pos").alias("starts"))
    repeats = repeats.select(F.col("doc").alias("_d"), F.col("h").alias("_h"), "starts")
    opened = rows.mapInArrow(open_rows, rows.schema)
    joined = opened.join(repeats, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")), "left").select("doc", "body", "starts")
    out = joined.mapInArrow(cut, schema).union(rows.mapInArrow(whole, schema))
    return out.withColumnRenamed("doc", doc_id)
