"""Benchmark decontamination with a generalised suffix automaton over normalised test items.

Items are split into blocks of bounded size, each with an automaton that is broadcast. Documents are read once: stretches of
words whose neighbouring pairs all stand in some item are kept, which loses no match, and only those stretches stream
through the blocks' automata, tracking the longest match that ends at each word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Words of test items in one automaton (some 100 MB of Python objects); with more items the stretches meet several, one after the other.
BLOCK_WORDS = 200_000


class SuffixAutomaton:
    """All word sequences inside the items: transitions, suffix links, longest lengths, and the items of each window state."""

    def __init__(self, items: list[tuple[str | None, list[int]]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: dict[int, set[int]] = {}
        short: dict[int, dict[int, set[int]]] = {}
        for k, (_, words) in enumerate(items):
            last = 0
            for w in words:
                last = self._extend(last, w)
                own.setdefault(last, set()).add(k)
        for k, (_, words) in enumerate(items):
            if len(words) < window:
                state = 0
                for w in words:
                    state = self.next[state][w]
                short.setdefault(state, {}).setdefault(len(words), set()).add(k)
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        items_of = {s: set(v) for s, v in own.items()}
        for s in reversed(order):  # an item that reaches a state also holds that state's suffixes
            if s in items_of and self.length[self.link[s]] >= window:
                items_of.setdefault(self.link[s], set()).update(items_of[s])
        #: the state of the last `window` words of a match in this state, and that state's items
        self.window_state = [-1] * len(self.length)
        #: items below the window by state and length, and each state's nearest suffix (or itself) that has such items
        self.shorts = short
        self.short_at = [0] * len(self.length)
        for s in order:
            up = self.link[s]
            if self.length[s] >= window:
                self.window_state[s] = s if self.length[up] < window else self.window_state[up]
            self.short_at[s] = s if s in short else self.short_at[up]
        self.items_of = {s: items_of.get(s, set()) for s in set(self.window_state) - {-1}}
        self.window = window
        self.least = min([window, *(len(w) for _, w in items)], default=window)
        self.names = [name for name, _ in items]

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(length)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = len(self.length)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def matches(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans [start, end) of matched windows, in order of their ends, and the items whose windows occur."""
        nxt, link, length = self.next, self.link, self.length
        spans, found, states, brief = [], set(), set(), set()
        state = size = 0
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                size += 1
            reach = size if size >= self.window else 0
            if reach:
                states.add(self.window_state[state])
            s = self.short_at[state]
            while s > 0:
                for n in self.shorts[s]:
                    if n <= size:
                        brief.add((s, n))
                        reach = max(reach, n)
                s = self.short_at[link[s]]
            if reach:
                a = i + 1 - reach
                while spans and spans[-1][0] >= a:
                    spans.pop()
                if spans and spans[-1][1] >= a:
                    a = spans.pop()[0]
                spans.append((a, i + 1))
        for s in states:
            found |= self.items_of[s]
        for s, n in brief:
            found |= self.shorts[s][n]
        return spans, found


def _automaton(items: list[tuple[str | None, str | None]], window: int):
    """(sorted word hashes, automaton over their ranks, set of word pairs) of a block of items."""
    data, offsets = C.text_buffers(pa.array([t for _, t in items], pa.string()))
    _, _, words, first = C.hash_words(data, offsets, C.ALNUM)
    vocabulary = np.unique(words)
    ids = np.searchsorted(vocabulary, words)
    listed = [(name, ids[a:b].tolist()) for (name, _), a, b in zip(items, first[:-1], first[1:]) if b > a]
    pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.array(w[:-1], np.int64) * len(vocabulary) + np.array(w[1:], np.int64) for _, w in listed)]))
    return vocabulary, SuffixAutomaton(listed, window), pairs


def _candidates(good: np.ndarray, joined: np.ndarray, first: np.ndarray, least: int):
    """(document, a, b): stretches of words that could hold a match.

    good: the word stands in some item; joined: so does its pair with the next word.
    """
    joined = np.append(joined, False)[: len(good)]
    inner = first[1:-1]
    joined[inner[(inner > 0) & (inner <= len(good))] - 1] = False  # no match runs from one document into the next
    open_ = good.copy()
    open_[1:] &= ~joined[:-1]
    starts = np.flatnonzero(open_)
    ends = np.flatnonzero(good & ~joined) + 1
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    yield from zip((np.searchsorted(first, starts, side="right") - 1).tolist(), starts.tolist(), ends.tolist())


def _ranks(words: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Each word hash's place in the sorted vocabulary, -1 for another word."""
    at = np.minimum(np.searchsorted(vocabulary, words), max(len(vocabulary) - 1, 0))
    return np.where(vocabulary[at] == words, at, -1) if len(vocabulary) else np.full(len(words), -1)


def _collect(automaton: SuffixAutomaton, ids: list[int], shift: int, spans: list[dict], names: list[str]) -> tuple[list[dict], list[str]]:
    """The spans and names with those of one stretch, which starts at word `shift` of its document."""
    found, which = automaton.matches(ids)
    if not found:
        return spans, names
    spans = _union([*((s["a"], s["b"]) for s in spans), *((shift + x, shift + y) for x, y in found)])
    return spans, sorted({*names, *(n for k in which if (n := automaton.names[k]) is not None)})


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def matches(docs: DataFrame, items: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every document row with `n_words long, hits array<struct<a long, b long>>, items array<string>` added.

    Words are lower-cased runs of ASCII letters, digits and non-ASCII characters. hits are word spans [a, b) inside
    matched windows (`window` words, or a whole shorter item), in order and without overlap. A null text has no words.
    An item without an id is a test item all the same: its windows are hits, but `items` has no name for it.
    """
    spark = docs.sparkSession
    listed = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    sizes = listed.withColumn("w", F.coalesce(F.octet_length("t"), F.lit(0)) / 2 + 1)
    blocks = int(-(-(sizes.agg(F.sum("w")).first()[0] or 1) // BLOCK_WORDS))
    listed = listed.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))

    def automaton(b: int):
        """The automaton of one bounded block of items."""
        return spark.sparkContext.broadcast(_automaton([(r[0], r[1]) for r in listed.where(F.col("block") == b).select("i", "t").collect()], window))

    if blocks == 1:
        return _at_once(docs, text, automaton(0))
    held = C.materialise(_stretches(docs.withColumn("_at", F.monotonically_increasing_id()), text, listed, window), "contamination")
    found = held.where(F.size("stretches") > 0).select("_at", "stretches", F.array().cast("array<struct<a:long,b:long>>").alias("hits"), F.array().cast("array<string>").alias("items"))
    for b in range(blocks):  # the test items are the stated query set: one block of them after the other, against all stretches
        known = automaton(b)
        found = C.materialise(_against(found, known), "contamination")
        known.destroy()
    found = C.small(found.select("_at", F.col("hits").alias("_hits"), F.col("items").alias("_items")))
    rows = held.drop("stretches").join(found, "_at", "left").drop("_at")
    return rows.withColumns({"hits": F.coalesce("_hits", F.array().cast("array<struct<a:long,b:long>>")), "items": F.coalesce("_items", F.array().cast("array<string>"))}).drop("_hits", "_items")


def _at_once(docs: DataFrame, text: str, known) -> DataFrame:
    """One block of items: stretches meet its automaton where they are found."""

    def run(batches):
        vocabulary, automaton, pairs = known.value
        for batch in batches:
            for part in C.slices(batch, text):
                _, _, words, first = C.hash_words(*C.text_buffers(part.column(text)), C.ALNUM)
                ids = _ranks(words, vocabulary)
                good = ids >= 0
                joined = good[:-1] & good[1:]
                if automaton.least > 1 and len(pairs):
                    key = np.where(joined, ids[:-1] * len(vocabulary) + ids[1:], -1)
                    joined = pairs[np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)] == key
                spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
                names: list[list[str]] = [[] for _ in range(part.num_rows)]
                for d, a, b in _candidates(good, joined, first, automaton.least):
                    spans[d], names[d] = _collect(automaton, ids[a:b].tolist(), a - int(first[d]), spans[d], names[d])
                columns = {n: part.column(n) for n in part.schema.names} | {"n_words": pa.array(np.diff(first), pa.int64()), "hits": pa.array(spans, _SPANS), "items": pa.array(names, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_pydict(columns)

    shape = docs.withColumns({"n_words": F.lit(0).cast("long"), "hits": F.array().cast("array<struct<a:long,b:long>>"), "items": F.array().cast("array<string>")})
    return docs.mapInArrow(run, shape.schema)


def _pair_hashes(words: np.ndarray) -> np.ndarray:
    return C.runs(words, 2, 11)


def _stretches(docs: DataFrame, text: str, items: DataFrame, window: int) -> DataFrame:
    """docs with n_words and stretches array<struct<a long, words array<long>>>, judged by a bitmap of all items' words and word pairs."""
    width = C.sketch_width(C.text_bytes(items, "t") / 2, 16)

    def count(batches):
        least, found = window, []
        for batch in batches:
            for part in C.slices(batch, "t"):
                _, _, words, first = C.hash_words(*C.text_buffers(part.column("t")), C.ALNUM)
                n = np.diff(first)
                least = min([least, *n[n > 0].tolist()])
                pairs = _pair_hashes(words)
                inside = np.ones(len(pairs), bool)
                inner = first[1:-1]
                inside[inner[(inner > 0) & (inner <= len(pairs))] - 1] = False
                found += [C.cells(words, width, 0), C.cells(pairs[inside], width, 0)]
        rows = list(C.sketch_blocks(np.concatenate([np.zeros(0, np.int64), *found]), 1))
        blocks = [-least, *(b for b, _ in rows)]  # a negative number tells the shortest item
        yield pa.RecordBatch.from_pydict({"block": pa.array(blocks, pa.int32()), "cells": pa.array([b"s", *(x for _, x in rows)], pa.binary())})

    parts = C.materialise(items.select("t").mapInArrow(count, "block int, cells binary"), "item-pairs")
    least = -(parts.where("block < 0").agg(F.max("block")).first()[0] or -window)
    once = lambda counts: np.packbits(counts > 0).tobytes()
    bits = docs.sparkSession.sparkContext.broadcast(C.Bitmap(width, 1, C.merge_sketches(parts.where("block >= 0"), once)))

    def run(batches):
        for batch in batches:
            for part in C.slices(batch, text):
                _, _, words, first = C.hash_words(*C.text_buffers(part.column(text)), C.ALNUM)
                good = bits.value.repeated(words)
                joined = good[:-1] & good[1:]
                if least > 1:
                    joined &= bits.value.repeated(_pair_hashes(words))
                out: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for d, a, b in _candidates(good, joined, first, least):
                    out[d].append({"a": a - int(first[d]), "words": words[a:b].view(np.int64).tolist()})
                kind = pa.list_(pa.struct([("a", pa.int64()), ("words", pa.list_(pa.int64()))]))
                yield pa.RecordBatch.from_pydict({n: part.column(n) for n in part.schema.names} | {"n_words": pa.array(np.diff(first), pa.int64()), "stretches": pa.array(out, kind)})

    shape = docs.withColumns({"n_words": F.lit(0).cast("long"), "stretches": F.array().cast("array<struct<a:long,words:array<long>>>")})
    return docs.mapInArrow(run, shape.schema)


def _against(found: DataFrame, known) -> DataFrame:
    """The stretches' rows with what one block's automaton finds in them."""

    def run(batches):
        vocabulary, automaton, _ = known.value
        for batch in batches:
            spans, names = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            for d, stretches in enumerate(batch.column("stretches")):
                for s in stretches:
                    ids = _ranks(s["words"].values.to_numpy().view(np.uint64), vocabulary)
                    spans[d], names[d] = _collect(automaton, ids.tolist(), s["a"].as_py(), spans[d], names[d])
            yield pa.RecordBatch.from_pydict({"_at": batch.column("_at"), "stretches": batch.column("stretches"), "hits": pa.array(spans, _SPANS), "items": pa.array(names, pa.list_(pa.string()))})

    return found.mapInArrow(run, found.schema)


def _union(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["b"]:
            out[-1]["b"] = max(b, out[-1]["b"])
        else:
            out.append({"a": a, "b": b})
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans): how far each document repeats test items.

    contaminated: some word is hit and share * n_hit >= n_words. Null and empty texts have no words and are clean.
    Items without words never occur; a repeated item id counts once. Windows of items with a null id count for n_hit and
    contaminated, but not for n_items and items_sha256. No item table rows: nothing is hit.
    """
    rows = matches(docs.select(F.col(doc_id), F.col(text)), items, window, doc_id, text, item_id)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    rows = rows.withColumn("n_hit", n_hit)
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return rows.select(F.col(doc_id), F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), F.col("hits").alias("spans"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20, longest: int | None = None, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The documents without contaminated ones, columns kept; with `longest`, spans of at least so many words are also cut out of the others."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    rows = matches(packed, items, window, doc_id, "text", item_id)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    rows = rows.where(~((n_hit > 0) & (share * n_hit >= F.col("n_words"))))
    if longest is None:
        return rows.select("row.*")

    def cut(batches):
        for batch in batches:
            texts = []
            for t, hits in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist()):
                long = [h for h in hits if h["b"] - h["a"] >= longest]
                if long:
                    raw = t.encode()
                    starts, sizes, _, _ = C.hash_words(*C.text_buffers(pa.array([t])), C.ALNUM)
                    at, kept = 0, []
                    for h in long:
                        kept.append(raw[at : starts[h["a"]]])
                        at = int(starts[h["b"] - 1] + sizes[h["b"] - 1])
                    t = b"".join([*kept, raw[at:]]).decode()
                texts.append(t)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    kind = rows.select("row", "text").schema
    return rows.select("row", "text", "hits").mapInArrow(cut, kind).select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def sha_of(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
