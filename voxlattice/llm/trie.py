"""Prefix trie of conversations, built as van Emde Boas lays tries out: cut in the middle of its height, again and again.

A sequence of turns is cut at half depth. Its first half belongs to the upper trie, its second half to the lower forest
below the cut prefix, which gets a name. Equal halves become one row with a count, and all upper tries and lower
forests of one height are cut together, by one shuffle a round, until single turns are left: the nodes. Totals then
go the other way: what the lower forests hold is grafted onto their cut prefixes, from the tallest halves down to
single turns. After that every node has the total of its subtree, in as many rounds as the depth has binary digits.

Prefixes are named by hashes of 128 bits; a prefix's name depends on its turns alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Turns that one row holds at most; longer conversations take several rows, and their names go from row to row.
PAGE_BITS = 8
PAGE = 1 << PAGE_BITS
ROOT = ""
_TURN = "struct<token:string,bytes:long>"


def _digest(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 32)


def _content(turns: Column) -> Column:
    return _digest(F.array_join(F.transform(turns, lambda t: t["token"]), ""))


def _name(root: Column, turns: Column) -> Column:
    """The name of the prefix that ends with these turns, which follow the prefix named root."""
    return _digest(F.concat(root, _content(turns)))


def turns_in_order(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, at, token, bytes): each conversation's turns numbered from 0, null turns first, ties by role and text's hash.

    Null roles and texts are empty; rows without a conv_id are left out. The order comes from a range partitioning, so
    that one very long conversation is ordered by many tasks.
    """
    q = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    token = _digest(F.concat(F.length(q(role)).cast("string"), F.lit(":"), q(role), q(text)))
    rows = conversations.where(F.col(f"`{conv_id}`").isNotNull()).select(F.col(f"`{conv_id}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), q(role).alias("role"), token.alias("token"), F.octet_length(q(text)).cast("long").alias("bytes"))
    keys = ["conv", "turn", "role", "token"]

    def number(batches):
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column("conv").to_numpy(zero_copy_only=False)
            if not len(conv):
                continue
            begins = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            at = np.arange(len(conv)) - np.repeat(begins, np.diff(np.append(begins, len(conv))))
            run = len(conv) if len(begins) == 1 else begins[1]
            if conv[0] == last:
                at[:run] += n
            last, n = conv[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(np.full(len(conv), part, np.int32)), pa.array(at.astype(np.int64)), batch.column("token"), batch.column("bytes")], names=["conv", "part", "at", "token", "bytes"])

    numbered = C.materialise(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(number, "conv long, part int, at long, token string, bytes long"), "turns")
    spans = numbered.groupBy("conv", "part").agg(F.count("*").alias("n"))
    # a conversation in several parts goes over a border of two of them, so these rows are fewer than two a part
    many = spans.join(spans.groupBy("conv").agg(F.count("*").alias("parts")).where("parts > 1").select("conv"), "conv", "left_semi")
    before = many.alias("x").join(many.alias("y"), "conv").where("y.part < x.part").groupBy("conv", "x.part").agg(F.sum("y.n").alias("before"))
    return numbered.join(F.broadcast(before), ["conv", "part"], "left").select("conv", (F.col("at") + F.coalesce("before", F.lit(0).cast("long"))).alias("at"), "token", "bytes")


def rebuild(turns: DataFrame, families: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of another: turns (conv, at, token, bytes, length) and (conv, length).

    Conversation c takes the first h turns of c - c % families, and its own after its first h; h = crc32(c) % most.
    """
    base, h = F.col("conv") - F.col("conv") % families, F.crc32(F.col("conv").cast("string")) % most
    lengths = C.materialise(turns.groupBy("conv").agg(F.count("*").alias("count")), "lengths")
    heads = turns.where(F.col("at") < most - 1).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("at", "token", "bytes"))).alias("head"))
    convs = lengths.select("conv", "count", base.alias("base"), h.cast("int").alias("h")).join(heads, "base", "left")
    convs = convs.withColumn("head", F.coalesce(F.slice("head", 1, F.col("h")), F.array().cast("array<struct<at:long,token:string,bytes:long>>")))
    shift = (F.size("head") - F.col("h")).cast("long")
    convs = C.materialise(convs.select("conv", "head", shift.alias("shift"), (F.size("head") + F.greatest(F.col("count") - F.col("h"), F.lit(0))).cast("long").alias("length")), "rebuilt")
    total = lengths.agg(F.sum("count")).first()[0] or 0
    own = C.salted_join(turns.where(F.col("at") >= h), convs.select("conv", "shift", "length"), ["conv"], lengths, total, ["at"])
    taken = convs.select("conv", "length", F.explode("head").alias("t")).select("conv", "t.at", "t.token", "t.bytes", "length")
    return own.select("conv", (F.col("at") + F.col("shift")).alias("at"), "token", "bytes", "length").union(taken), convs.select("conv", "length")


def _page_roots(pages: DataFrame, levels: int) -> DataFrame:
    """(conv, page, roots): of conversations in several pages, the names of the prefixes before the blocks that hold a page.

    Blocks have 2^levels turns down to one page. A row a page goes through each conversation in order.
    """

    def chain(batches):
        conv, names = None, []
        name = ROOT
        for batch in batches:
            roots = []
            for c, page, content in zip(*(batch.column(k).to_pylist() for k in ("conv", "page", "content"))):
                if c != conv:
                    conv, name, names = c, ROOT, [ROOT] * (levels - PAGE_BITS + 1)
                for k in range(levels - PAGE_BITS + 1):
                    if page % (1 << k) == 0:
                        names[k] = name
                roots.append(names[::-1])
                name = hashlib.sha256((name + content).encode()).hexdigest()[:32]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("page"), pa.array(roots, pa.list_(pa.string()))], names=["conv", "page", "roots"])

    long = pages.where(F.col("length") > PAGE).select("conv", "page", _content(F.col("turns")).alias("content"))
    return long.repartition("conv").sortWithinPartitions("conv", "page").mapInArrow(chain, "conv long, page long, roots array<string>")


def _end_name(root: Column, turns: Column) -> Column:
    """The name of a page's end: its turns in blocks of falling powers of two, as the cuts would part them."""
    start = F.struct(root.alias("name"), F.lit(0).alias("at"))

    def step(held, size):
        after = F.struct(_name(held["name"], F.slice(turns, held["at"] + 1, size)).alias("name"), (held["at"] + size).alias("at"))
        return F.when(F.size(turns).bitwiseAND(size) > 0, after).otherwise(held)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(PAGE_BITS, -1, -1)]), start, step)["name"]


def _cut(rows: DataFrame, half: int) -> DataFrame:
    """Sequences of at most 2 * half turns, cut after `half`; equal ones become one."""
    cut = F.slice("turns", 1, half)
    rows = rows.withColumn("root", F.element_at("roots", -1)).withColumn("middle", _name(F.col("root"), cut))
    part = lambda end, root, depth, turns: F.struct(end.alias("end"), F.array_append("roots", root).alias("roots"), depth.alias("depth"), turns.alias("turns"))
    end, root, middle, depth, turns = (F.col(c) for c in ("end", "root", "middle", "depth", "turns"))
    halves = F.array(part(middle, root, depth, cut), part(end, middle, depth + half, F.slice(turns, half + 1, half)))
    whole = F.array(part(end, root, depth, turns))
    rows = rows.select(F.explode(F.when(F.size("turns") > half, halves).otherwise(whole)).alias("s"), "n", "conv").select("s.*", "n", "conv")
    return _merged(rows, F.sum("n"))


def _merged(rows: DataFrame, n: Column) -> DataFrame:
    """One row for each end; equal ends have equal roots and turns."""
    return rows.groupBy("end").agg(F.first("roots").alias("roots"), F.first("depth").alias("depth"), F.first("turns").alias("turns"), n.alias("n"), F.min("conv").alias("conv"))


def _ends(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256): the hash of the ascending ids of the conversations that end at a node.

    Tasks join the ids of ranges; then a node's strings run through one hash, so that a group of copies is never held whole.
    """

    def joined(batches):
        for batch in batches:
            names, convs = batch.column("name").to_pylist(), batch.column("conv").to_pylist()
            begins = [i for i, n in enumerate(names) if i == 0 or n != names[i - 1]]
            cuts = [*begins, len(names)]
            yield pa.RecordBatch.from_pydict({"name": pa.array([names[a] for a in begins], pa.string()), "first": pa.array([convs[a] for a in begins], pa.int64()), "ids": pa.array([",".join(map(str, convs[a:b])) for a, b in zip(cuts, cuts[1:])], pa.string())})

    def hashed(batches):
        at, h = None, None
        for batch in batches:
            done = []
            for name, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist()):
                if name == at:
                    h.update(b",")
                else:
                    if h is not None:
                        done.append((at, h.hexdigest()))
                    at, h = name, hashlib.sha256()
                h.update(ids.encode())
            yield pa.RecordBatch.from_pydict({"name": pa.array([d[0] for d in done], pa.string()), "ends_sha256": pa.array([d[1] for d in done], pa.string())})
        if h is not None:
            yield pa.RecordBatch.from_pydict({"name": pa.array([at], pa.string()), "ends_sha256": pa.array([h.hexdigest()], pa.string())})

    parts = ends.repartitionByRange("name", "conv").sortWithinPartitions("name", "conv").mapInArrow(joined, "name string, first long, ids string")
    return parts.repartition("name").sortWithinPartitions("name", "first").mapInArrow(hashed, "name string, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node of the trie of turns (conv, at, token, bytes, length) of conversations (conv, length).

    Columns conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. Conversations without turns end at the root. Without conversations there is no row.
    """
    convs = C.materialise(convs, "convs")
    known = convs.agg(F.count("*"), F.min("conv"), F.max("length")).first()
    total, least, depth = known[0], known[1], known[2] or 0
    levels = max(depth - 1, 0).bit_length()
    low = min(levels, PAGE_BITS)
    spark = turns.sparkSession

    pages = turns.groupBy("conv", F.floor(F.col("at") / PAGE).alias("page")).agg(F.sort_array(F.collect_list(F.struct("at", "token", "bytes"))).alias("turns"), F.first("length").alias("length"))
    pages = C.materialise(pages.withColumn("turns", F.transform("turns", lambda t: F.struct(t["token"].alias("token"), t["bytes"].alias("bytes")))), "pages")
    top = F.array_repeat(F.lit(ROOT), levels - low + 1)
    if depth > PAGE:
        pages = pages.join(_page_roots(pages, levels), ["conv", "page"], "left").withColumn("roots", F.coalesce("roots", top))
    else:
        pages = pages.withColumn("roots", top)
    pages = C.materialise(pages.withColumn("end", _end_name(F.element_at("roots", -1), F.col("turns"))), "named")

    rows = _merged(pages.select("end", "roots", (F.col("page") * PAGE).alias("depth"), "turns", "conv"), F.count("*"))
    for k in range(low - 1, -1, -1):
        rows = _cut(rows, 1 << k)
    own = F.struct((F.col("depth") + 1).alias("depth"), "n", "conv", F.element_at("turns", 1)["bytes"].alias("bytes"), "roots")
    nodes = C.materialise(rows.select(F.col("end").alias("name"), own.alias("own")), "nodes")
    kind = nodes.schema["own"].dataType.simpleString()
    root = spark.createDataFrame([(total, least)] if total else [], "n long, conv long")
    root = root.select(F.lit(ROOT).alias("name"), F.struct(F.lit(0).cast("long").alias("depth"), "n", "conv", F.lit(0).cast("long").alias("bytes"), F.array().cast("array<string>").alias("roots")).cast(kind).alias("own"))

    def graft(rows, to, given, totals):
        """Add each row's `given` to the totals of the node named `to` (null: none)."""
        none = F.lit(None).cast(kind)
        kept = F.struct("name", "own", *[F.col(t) if t in rows.columns else F.lit(0).cast("long").alias(t) for t in totals])
        sent = F.struct(to.alias("name"), none.alias("own"), *[g.cast("long").alias(t) for t, g in zip(totals, given)])
        rows = rows.select(F.explode(F.array(kept, sent)).alias("r")).select("r.*").where("name is not null")
        return rows.groupBy("name").agg(F.first("own", ignorenulls=True).alias("own"), *[F.sum(t).alias(t) for t in totals])

    parent = F.when(F.col("own.depth") > 0, F.element_at("own.roots", -1))
    rows = C.materialise(graft(nodes.union(root), parent, [F.lit(1)], ["kids"]), "children")
    kids = rows.select("name", "kids")
    rows = rows.select("name", "own", (F.col("kids") == 0).cast("long").alias("leaves"), ((F.col("own.n") - 1) * F.col("own.bytes")).alias("saved"))
    for k in range(levels, -1, -1):
        lower = F.col("own.depth") > 0 if k == levels else (F.col("own.depth") > 0) & (F.shiftright(F.col("own.depth") - 1, k).bitwiseAND(F.lit(1)) == 1)
        to = F.when(lower, F.element_at("own.roots", levels - k + 1))
        rows = graft(rows, to, [F.col("leaves"), F.col("saved")], ["leaves", "saved"])
    done = C.materialise(rows.join(kids, "name").select("name", "own.depth", "own.n", "own.conv", F.when(F.col("own.depth") > 0, F.element_at("own.roots", -1)).alias("parent"), "kids", "leaves", "saved"), "totals")

    up = done.select(F.col("name").alias("parent"), F.col("conv").alias("above"))
    done = C.salted_join(done, up, ["parent"], kids.select(F.col("name").alias("parent"), F.col("kids").alias("count")), done.count(), ["name"], "left")
    last = pages.where(F.col("page") == F.floor((F.col("length") - 1) / PAGE)).select(F.col("end").alias("name"), "conv")
    ends = _ends(last.union(convs.where("length = 0").select(F.lit(ROOT), "conv")))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return done.join(ends, "name", "left").select(F.col("conv").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
