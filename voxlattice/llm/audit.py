"""Interaction of quality filters: what each removes in every order of application, by decision diagrams of failure masks.

Every document becomes a mask of the filters it fails. Masks are counted per part; a part's counts make one decision
diagram, whose adjacent levels are swapped until every order of the filters has stood there once. In each order the path
on which all filters pass gives that order's steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LETTERS = "ABCDE"
_SPACE = r"[\x20\x09-\x0D]+"


class Node:
    """A test of one filter: where documents that pass (lo) and fail (hi) go on, and the counts of both together."""

    __slots__ = ("lo", "hi", "weight")

    def __init__(self, lo, hi, weight):
        self.lo, self.hi, self.weight = lo, hi, weight


class Diagram:
    """Count-weighted decision diagram of failure masks: one level a filter, equal nodes of a level are one.

    weights[mask] holds the counts of the documents that fail just the filters of mask. Levels are never left out, so
    a node's weight is the sum of its two ends' weights.
    """

    def __init__(self, weights: np.ndarray, filters: int):
        self.order = list(range(filters))
        self.levels: list[dict[tuple[Node, Node], Node]] = [{} for _ in range(filters)]
        ends: dict[tuple[int, ...], Node] = {}
        row = [ends.setdefault(tuple(w), Node(None, None, w)) for w in np.asarray(weights).tolist()]
        for level in range(filters - 1, -1, -1):  # the highest bit is tested last
            half = len(row) // 2
            row = [self._node(level, row[m], row[m + half]) for m in range(half)]
        self.root = row[0]

    def _node(self, level: int, lo: Node, hi: Node) -> Node:
        found = self.levels[level].get((lo, hi))
        if found is None:
            found = self.levels[level][lo, hi] = Node(lo, hi, [a + b for a, b in zip(lo.weight, hi.weight)])
        return found

    def swap(self, level: int) -> None:
        """Exchange the filters of a level and the next; nodes of other levels stay as they are."""
        nodes = list(self.levels[level].values())
        self.levels[level], self.levels[level + 1] = {}, {}
        for n in nodes:
            (a, b), (c, d) = (n.lo.lo, n.lo.hi), (n.hi.lo, n.hi.hi)
            n.lo, n.hi = self._node(level + 1, a, c), self._node(level + 1, b, d)
            self.levels[level][n.lo, n.hi] = n
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[int, list, list]]:
        """Along the all-pass path: filter, counts that pass it and counts that it removes."""
        node = self.root
        for f in self.order:
            yield f, node.lo.weight, node.hi.weight
            node = node.lo

    def orders(self) -> Iterator[list[int]]:
        """Every order of the filters once, each an adjacent swap from the one before."""
        n = len(self.order)
        facing, place = [-1] * n, {f: f for f in range(n)}  # filters as numbered at the start
        first = list(self.order)
        yield self.order
        while True:
            movable = [f for f in range(n) if 0 <= place[f] + facing[f] < n and first.index(self.order[place[f] + facing[f]]) < f]
            if not movable:
                return
            f = max(movable)
            at, to = place[f], place[f] + facing[f]
            other = first.index(self.order[to])
            self.swap(min(at, to))
            place[f], place[other] = to, at
            for g in range(f + 1, n):
                facing[g] = -facing[g]
            yield self.order


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def interactions(weights: np.ndarray, filters: int) -> tuple[list[str], list[int], dict[str, list[int]]]:
    """Orders, steps and counts of all orders of one part; weights[mask] = (documents, good ones, toxic ones)."""
    masks = np.arange(1 << filters)
    fails = [int(weights[masks >> f & 1 == 1, 0].sum()) for f in range(filters)]
    alone = [int(weights[1 << f, 0]) for f in range(filters)]
    names, steps, by_filter, out = [], [], [], {c: [] for c in COUNTS}
    shapley = [0] * filters
    diagram = Diagram(weights, filters)
    for order in diagram.orders():
        name = "".join(LETTERS[f] for f in order)
        for k, (f, passed, removed) in enumerate(diagram.steps(), 1):
            names.append(name)
            steps.append(k)
            by_filter.append(f)
            shapley[f] += removed[0]
            for c, v in zip(COUNTS, (passed[0], removed[0], fails[f] - removed[0], alone[f], removed[1], removed[2])):
                out[c].append(v)
    out["shapley"] = [shapley[f] for f in by_filter]
    return names, steps, out


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc, part, mask, digest) of every row: the filters A to D that its text fails, as bits, and the text's SHA-256."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.split("text", _SPACE))
    blank = lambda w: F.when(w == "", 1).otherwise(0)  # noqa: E731  only the first and the last can be empty
    n = F.size("words") - blank(F.element_at("words", 1)) - F.when(F.size("words") > 1, blank(F.element_at("words", -1))).otherwise(0)
    distinct = F.size(F.array_distinct("words")) - F.greatest(blank(F.element_at("words", 1)), blank(F.element_at("words", -1)))
    rows = rows.select("doc", "part", "text", n.alias("n"), distinct.alias("distinct"))
    tests = [
        F.col("n") < 200,
        100 * F.col("distinct") < 50 * F.col("n"),
        100 * F.regexp_count("text", F.lit("[A-Z]")) > 2 * F.length("text"),
        F.col("text").rlike("[#$%&*|]"),
    ]
    mask = sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))
    return rows.select("doc", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def _look_up(rows: DataFrame, table: DataFrame, keys: list[str], salt_by: list[str], total: int) -> DataFrame:
    """Left join with a table of unique keys: broadcast within the bound, else shuffled with heavy keys dealt out."""
    if table.count() <= C.BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys, "left")
    return C.salted_join(rows, table, keys, rows.groupBy(*keys).count(), total, salt_by, "left")


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order.

    Filters: A under 200 words, B under half of the words distinct, C over 2 % capital letters, D holds a sign of
    `#$%&*|`, E a row with a smaller id has the same text. A null text is empty, a null part the empty string, and so
    one part with rows whose part is empty. A row with a null id never fails E, makes no other row fail it and has no
    label. Rows with the same id and text are all counted; the later labels of an id count if any of them says 1.
    Parts without rows do not appear, so an empty table gives no rows. Other columns are ignored.
    """
    kind = docs.schema[doc_id].dataType
    facts = C.materialise(failures(docs, doc_id, text, part), "failures")
    total = facts.count()
    copies = C.materialise(facts.groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("c")).where("c > 1").select("digest", "first"), "copies")
    rows = _look_up(facts, copies, ["digest"], ["doc", "part"], total)
    rows = rows.withColumn("mask", F.col("mask") + F.when(F.col("doc") > F.col("first"), 16).otherwise(0))

    # a null id has a key of its own, so that many of them can be dealt out like any other heavy key
    zero, said = F.lit(0).cast(kind), lambda c: F.coalesce(F.max((F.col(f"`{c}`") == 1).cast("long")), F.lit(0).cast("long")).alias(c)
    known = labels.where(F.col(f"`{doc_id}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").cast(kind).alias("id"), F.lit(False).alias("none")).agg(said("quality"), said("toxic")).where("quality + toxic > 0")
    rows = rows.select(F.coalesce("doc", zero).alias("id"), F.col("doc").isNull().alias("none"), "part", "mask", "digest")
    rows = _look_up(rows, C.materialise(known, "labels"), ["id", "none"], ["digest"], total)
    counts = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.sum(F.coalesce(c, F.lit(0).cast("long"))).alias(c) for c in ("quality", "toxic")])
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "quality", "toxic")).alias("masks"))  # 32 masks a part at most

    def diagrams(batches):
        for batch in batches:
            for name, masks in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist()):
                weights = np.zeros((1 << len(LETTERS), 3), np.int64)
                for m in masks:
                    weights[m["mask"]] = m["n"], m["quality"], m["toxic"]
                orders, steps, out = interactions(weights, len(LETTERS))
                yield pa.RecordBatch.from_pydict({"part": pa.array([name] * len(orders), pa.string()), "filter_order": pa.array(orders), "step": pa.array(steps, pa.int32())} | {c: pa.array(out[c], pa.int64()) for c in COUNTS})

    return parts.mapInArrow(diagrams, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
