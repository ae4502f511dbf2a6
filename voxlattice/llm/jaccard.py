"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters; each pair verified once.

Documents with equal shingle sets form one class. A class's shingles are ordered by how rare they are in the
corpus (a merged counter sketch, so the order is the same everywhere) and only its prefix is indexed: two sets
that are similar enough share a prefix shingle. Candidates come in two steps, so that a group of thousands of
near copies never gives all its pairs: first every class against its index entry's most central member, then, in
entries whose members are not yet connected, the classes outside that member's component against the rest, joined by
shingle and length band, so that sets whose lengths and positions rule a link out never meet. There a pair must also
pass a bound that its parity sketches give: every shingle that only one of two sets holds flips one of 256 bits, so
sketches that differ in more bits than a link allows shingles rule it out. Pages of one form, which share many frequent
shingles and link with nothing, so give no candidates. Pairs skipped are those already connected, so components are exact.
Where the number of links is wanted, the sets of each component then meet block by block, and every pair of them counts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

_U = np.uint64
BINS = 16
LINK_ROWS, LINK_BLOCK = 1000, 200_000
#: Components of more sets than this meet in several blocks even where one would hold them, up to so many, so that tasks share them.
LINK_SHARED, LINK_PARTS = 100, 8
PARITY_BITS = 256
_PARITY = [f"odd{i}" for i in range(PARITY_BITS // 64)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int):
    """Per text, the sorted distinct hashes of its k-word shingles (shorter texts: of the whole sequence)."""
    _, _, words, first = C.hash_words(data, offsets, C.LOWER)
    grams = C.runs(words, k, 7)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            yield C.runs(words[a:b], int(b - a), 1000 + int(b - a))
        else:
            yield words[:0]


def _frequency_classes(counts: np.ndarray) -> bytes:
    return np.minimum(127, np.rint(8 * np.log2(1.0 + counts))).astype(np.uint8).tobytes()


def _frequencies(docs: DataFrame, text: str, k: int, width: int) -> np.ndarray:
    """For each cell of a hashed shingle table, how common it is (a rounded logarithm), over all documents.

    It decides the order of shingles only; a part's count of one cell is capped where it is written, at 65,535.
    """

    def count(batches):
        found, held = [], 0
        for batch in batches:
            for part in C.slices(batch, text):
                found += [(s & _U(width - 1)).astype(np.int64) for s in shingle_sets(*C.text_buffers(part.column(text)), k)]
                held += len(found[-1]) if found else 0
                if held > 500_000:
                    yield blocks(found)
                    found, held = [], 0
        yield blocks(found)

    def blocks(found):
        rows = list(C.sketch_blocks(np.concatenate([np.zeros(0, np.int64), *found]), 65535))
        return pa.RecordBatch.from_pydict({"block": pa.array([b for b, _ in rows], pa.int32()), "cells": pa.array([x for _, x in rows], pa.binary())})

    blocks_ = C.merge_sketches(docs.select(text).mapInArrow(count, "block int, cells binary"), _frequency_classes)
    table = np.zeros(width, np.uint8)
    for i, raw in blocks_.items():
        table[i * C.BLOCK : (i + 1) * C.BLOCK] = np.frombuffer(raw, np.uint8)
    return table


def _parity(s: np.ndarray) -> np.ndarray:
    """Bit b: whether an odd number of the set's shingles falls on it."""
    bits = np.bincount((C.mix64(s) >> _U(56)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _sketches(docs: DataFrame, doc_id: str, text: str, k: int, num: int, den: int, table) -> DataFrame:
    """A row per document: set size, fingerprint, rare-first prefix, counts of the shingles behind it in hashed bins, parity sketch."""
    width = len(table.value)

    def make(batches):
        common = table.value
        for batch in batches:
            for part in C.slices(batch, text):
                out = {"n": [], "fp": [], "prefix": [], "bins": [], "odd": []}
                for s in shingle_sets(*C.text_buffers(part.column(text)), k):
                    n = len(s)
                    order = (common[(s & _U(width - 1)).astype(np.int64)].astype(np.int64) << 56) | (s >> _U(8)).astype(np.int64)
                    keep = n - (num * n + den - 1) // den + 1 if n else 0
                    order.sort()
                    out["n"].append(n)
                    out["fp"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n else None)
                    out["prefix"].append(order[:keep])
                    out["bins"].append(np.bincount((order[keep:] >> 52) & (BINS - 1), minlength=BINS).astype(np.int32))
                    out["odd"].append(_parity(s))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("h"), pa.array(out["n"], pa.int64()), pa.array(out["fp"], pa.binary()), pa.array(out["prefix"], pa.list_(pa.int64())), pa.array(out["bins"], pa.list_(pa.int32())), pa.array(out["odd"], pa.list_(pa.int64()))],
                    names=["doc", "h", "n", "fp", "prefix", "bins", "odd"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc"), C.text_key(text).alias("h"), F.col(text).alias(text))
    return rows.mapInArrow(make, f"doc {kind}, h long, n long, fp binary, prefix array<long>, bins array<int>, odd array<long>")


def _postings(classes: DataFrame) -> DataFrame:
    """(tok, cid, pos, n) of prefix shingles, without those that a count-min sketch shows in one class only."""
    total = classes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    width = C.sketch_width(total, 8)
    spark = classes.sparkSession

    def count(batches):
        for batch in batches:
            keys = batch.column("prefix").flatten().to_numpy(zero_copy_only=False).view(_U)
            found = list(C.sketch_blocks(C.cells(keys, width, 0), 2))
            yield pa.RecordBatch.from_pydict({"block": pa.array([b for b, _ in found], pa.int32()), "cells": pa.array([x for _, x in found], pa.binary())})

    bits = spark.sparkContext.broadcast(C.Bitmap(width, 1, C.merge_sketches(classes.select("prefix").mapInArrow(count, "block int, cells binary"), C.twice)))

    def explode(batches):
        for batch in batches:
            lists = batch.column("prefix")
            sizes = np.diff(lists.offsets.to_numpy())
            tok = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(tok)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = bits.value.repeated(tok.view(_U))
            row, take = row[keep], lambda name: batch.column(name).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict({"tok": pa.array(tok[keep]), "cid": pa.array(take("cid")[row]), "pos": pa.array(pos[keep].astype(np.int32)), "n": pa.array(take("n")[row])})

    out = C.materialise(classes.select("prefix", "cid", "n").mapInArrow(explode, "tok long, cid long, pos int, n long"), "postings")
    bits.destroy()
    return out


def _may_link(a: str, b: str, num: int, den: int):
    """Length and positional filters for a shared prefix shingle: the sizes allow the similarity, and so does what is left after it."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    overlap = F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos"))
    return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (overlap * (num + den) >= (na + nb) * num)


def _band(n):
    """A set size's band: the size itself while small, then steps of an eighth, so that a probe looks into two or three bands."""
    return F.when(n <= 16, n).otherwise(16 + F.floor(F.log(n / 16) / float(np.log1p(1 / 8)))).cast("long")


def _probes(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Postings once for each length band that a linked set of at most their size can have, given the shared shingle's position."""
    n, pos = F.col("n"), F.col("pos")
    least, most = F.ceil(n * num / den), F.least(n, F.floor((n - pos) * (num + den) / num) - n)
    return rows.where(least <= most).withColumn("band", F.explode(F.sequence(_band(least), _band(most))))


def _targets(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Postings by their own band, where what is left behind their position can link with a set of at least their size."""
    return rows.where((F.col("n") - F.col("pos")) * (num + den) >= 2 * num * F.col("n")).withColumn("band", _band(F.col("n")))


def _suffix_filter(num: int, den: int):
    """Bound of the overlap of two sets: what their prefixes share, and bin by bin what is behind the last shared order."""
    last = F.least(F.element_at("prefix_a", -1), F.element_at("prefix_b", -1))
    late = {e: F.filter(f"prefix_{e}", lambda t: t > last) for e in "ab"}
    behind = {e: F.col(f"n_{e}") - F.size(f"prefix_{e}") + F.size(late[e]) for e in "ab"}
    held = {e: F.transform(f"bins_{e}", lambda c, i: c + F.size(F.filter(late[e], lambda t: F.shiftright(t, 52).bitwiseAND(F.lit(BINS - 1)) == i))) for e in "ab"}  # noqa: B023
    apart = F.aggregate(F.zip_with(held["a"], held["b"], lambda p, q: F.abs(p - q)), F.lit(0), lambda s, d: s + d)
    twice = 2 * F.size(F.array_intersect("prefix_a", "prefix_b")) + behind["a"] + behind["b"] - apart
    return twice * (num + den) >= 2 * num * (F.col("n_a") + F.col("n_b"))


def _meet(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a, b) with the columns of both classes, as <column>_a and <column>_b; a class in very many pairs is dealt over partitions."""
    total = pairs.count()
    for end in ("a", "b"):
        side = table.select(F.col("cid").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
        pairs = C.salted_join(pairs, side, [end], pairs.groupBy(end).count(), total, ["a", "b"])
    return pairs


def _sets(wanted: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """(cid, s): the whole sets of classes (cid, doc, h), from their representatives' texts."""
    keyed = docs.select(F.col(doc_id).alias("_d"), C.text_key(text).alias("_h"), F.col(text).alias(text))
    found = keyed.join(C.small(wanted), F.col("_d").eqNullSafe(F.col("doc")) & (F.col("_h") == F.col("h"))).select("cid", text)

    def sets(batches):
        for batch in batches:
            for part in C.slices(batch, text):
                all_sets = [s.view(np.int64) for s in shingle_sets(*C.text_buffers(part.column(text)), k)]
                yield pa.RecordBatch.from_arrays([part.column("cid"), pa.array(all_sets, pa.list_(pa.int64()))], names=["cid", "s"])

    # rows that repeat a representative give its set again; a set's first copy is any of them
    return found.mapInArrow(sets, "cid long, s array<long>").groupBy("cid").agg(F.first("s").alias("s"))


def _overlaps(tokens: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """How many tokens every two of the rows share, a stretch of the vocabulary at a time."""
    _, at, times = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = times > 1  # what one row alone holds meets nothing
    column = np.cumsum(shared) - 1
    row, at = row[shared[at]], column[at[shared[at]]]
    out, width = np.zeros((rows, rows), np.float32), max(64, 4_000_000 // max(1, rows))
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(at, [lo, lo + width])
        held = np.zeros((rows, width), np.float32)
        held[row[a:b], at[a:b] - lo] = 1
        out += held @ held.T
    return out.astype(np.int64)


def _all_links(classes: DataFrame, found: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int, num: int, den: int) -> DataFrame:
    """(cid, n_links): with how many other sets each class links, all of them.

    Links lie inside components, so each component's sets meet block by block: a task holds two blocks of at most some
    `LINK_BLOCK` shingles, and every pair of blocks is one group. Work is quadratic in a component, as its links are.
    """
    named = C.materialise(classes.join(C.small(found), "cid").select("cid", "n", "component", "rep.doc", "rep.h"), "members")
    sizes = named.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    two = named.join(C.small(sizes.where("size = 2")), "component").select("cid", F.lit(1).cast("long").alias("n_links"))
    blocks = F.greatest(F.ceil(F.col("size") / LINK_ROWS), F.ceil(F.col("total") / LINK_BLOCK), F.least(F.ceil(F.col("size") / LINK_SHARED), F.lit(LINK_PARTS).cast("long")))
    large = named.join(C.small(sizes.where("size > 2")), "component").withColumn("blocks", blocks)
    large = C.materialise(large.withColumn("block", F.pmod(F.xxhash64("cid"), "blocks")).select("cid", "doc", "h", "n", "component", "block", "blocks"), "large")
    sets = C.materialise(_sets(large.select("cid", "doc", "h"), docs, doc_id, text, k), "sets")
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    spread = large.drop("doc", "h").join(sets, "cid").select("cid", "n", "s", "component", "block", others)
    spread = spread.select("cid", "n", "s", "component", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def count(table: pa.Table) -> pa.Table:
        lists = table.column("s").combine_chunks()
        tokens, rows = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        n, block = table.column("n").to_numpy(), table.column("block").to_numpy()
        i = _overlaps(tokens, rows, len(lists))
        links = i * den >= (n[:, None] + n[None, :] - i) * num
        np.fill_diagonal(links, False)
        if table.column("lo")[0].as_py() != table.column("hi")[0].as_py():
            links &= block[:, None] != block[None, :]  # pairs inside a block are counted in the group of that block alone
        return pa.table({"cid": table.column("cid"), "n_links": pa.array(links.sum(1), pa.int64())})

    counted = spread.groupBy("component", "lo", "hi").applyInArrow(count, "cid long, n_links long")
    out = C.materialise(two.union(counted.groupBy("cid").agg(F.sum("n_links").alias("n_links"))), "counted")
    C.discard(named, large, sets)
    return out


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int, num: int, den: int) -> DataFrame:
    """Of the candidate pairs (a, b), those whose whole sets are similar enough."""
    ends = lambda p: C.small(C.materialise(p.select(F.col("a").alias("cid")).union(p.select("b")).distinct(), "ends"))
    # the classes of candidate pairs alone go through the joins
    classes = C.materialise(classes.join(ends(pairs), "cid", "left_semi").select("cid", "n", "prefix", "bins", "rep"), "used")
    pairs = C.materialise(_meet(pairs, classes, ["n", "prefix", "bins"]).where(_suffix_filter(num, den)).select("a", "b", "n_a", "n_b"), "pairs")
    wanted = C.materialise(classes.join(ends(pairs), "cid", "left_semi").select("cid", "rep.doc", "rep.h"), "wanted")
    sets = C.materialise(_sets(wanted, docs, doc_id, text, k), "sets")
    both = _meet(pairs, sets, ["s"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).cast("long").alias("i"))
    links = C.materialise(both.where(F.col("i") * den >= (F.col("n_a") + F.col("n_b") - F.col("i")) * num).select("a", "b"), "links")
    C.discard(classes, pairs, wanted, sets)
    return links


def _open_entries(postings: DataFrame, found: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Postings of shingles whose classes lie in several components, with component and parity sketch.

    `few`: outside the component of the entry's most central member. An entry of two has met already; one without a
    class that can be a link's smaller end there has no link left.
    """
    labelled = postings.join(C.small(found), "cid", "left").select("tok", "cid", "pos", "n", F.coalesce("component", "cid").alias("component"))
    target = (F.col("n") - F.col("pos")) * (num + den) >= 2 * num * F.col("n")
    stats = labelled.groupBy("tok").agg(F.count("*").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(target).alias("t"), F.min(F.struct("pos", "n", "cid", "component")).alias("p"))
    open_ = C.materialise(stats.where("c > 2 and lo < hi and t").select("tok", F.col("p.component").alias("main")), "open")
    rows = labelled.join(C.small(open_), "tok").select("tok", "cid", "pos", "n", "component", (F.col("component") != F.col("main")).alias("few"))
    sketches = classes.select("cid", *[F.get("odd", F.lit(i)).alias(c) for i, c in enumerate(_PARITY)])
    return rows.join(C.small(sketches), "cid")


def _second(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of open entries that sizes, positions and parity sketches don't rule out."""
    probes, targets = _probes(entries, num, den), _targets(entries, num, den)
    meets = (F.col("x.tok") == F.col("y.tok")) & (F.col("x.band") == F.col("y.band"))
    apart = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in _PARITY), F.lit(0))
    wanted = (F.col("x.component") != F.col("y.component")) & ((F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.cid") < F.col("x.cid")))) & _may_link("x", "y", num, den)
    wanted = meets & wanted & (apart * (num + den) <= (F.col("x.n") + F.col("y.n")) * (den - num))
    ends = [F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")]
    rest = probes.where("few").alias("x").join(targets.alias("y"), wanted).select(*ends)
    return rest.union(probes.where("not few").alias("x").join(targets.where("few").alias("y"), wanted).select(*ends)).distinct()


def jaccard_join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, doc_id: str = "doc_id", text: str = "text", links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, n_links, component_id) of every row: its class of similar texts.

    Two rows link when den * |A and B| >= num * |A or B| for their sets of distinct k-word shingles; component_id is
    the smallest doc_id reachable. n_links is the number of other sets that the row's set links with, all of them; without
    `links` it is left out, and only as many links are verified as the components need.
    Null or wordless texts have no shingles and link with nothing. Rows with a null id link by their text but name
    no component; a component of such rows only has a null id. Repeated rows are repeated in the result.
    """
    return _joined(docs, k, num, den, doc_id, text, links).drop("h").withColumnRenamed("doc", doc_id)


def _joined(docs: DataFrame, k: int, num: int, den: int, doc_id: str, text: str, count_links: bool = False) -> DataFrame:
    """As jaccard_join, with the text's key `h` beside the id `doc`."""
    spark = docs.sparkSession
    width = C.sketch_width(C.text_bytes(docs, text) / 512, 1, most=1 << 24)
    table = spark.sparkContext.broadcast(_frequencies(docs, text, k, width))
    rows = C.materialise(_sketches(docs, doc_id, text, k, num, den, table), "sketches")
    table.destroy()
    firsts = [F.first(c).alias(c) for c in ("n", "prefix", "bins", "odd")]
    grouped = rows.where("n > 0").groupBy("fp").agg(F.min("doc").alias("doc"), F.min(F.struct("doc", "h")).alias("rep"), *firsts)
    classes = C.materialise(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    # two different sets link only if the smaller one may lack a shingle of the larger
    postings = _postings(classes.where(F.col("n") * (den - num) >= num))

    pivots = postings.groupBy("tok").agg(F.count("*").alias("c"), F.min(F.struct("pos", "n", "cid")).alias("p")).where("c > 1").select("tok", "p.*")
    near = postings.alias("x").join(pivots.alias("y"), F.col("x.tok") == F.col("y.tok")).where((F.col("x.cid") != F.col("y.cid")) & _may_link("x", "y", num, den))
    ends = [F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")]
    first = C.materialise(near.select(*ends).distinct(), "candidates")
    links = _verify(first, classes, docs, doc_id, text, k, num, den)

    found = components(links).withColumnRenamed("node", "cid")
    entries = C.materialise(_open_entries(postings, found, classes, num, den), "entries")
    C.discard(postings)
    second = C.materialise(_second(entries, num, den).join(first, ["a", "b"], "left_anti"), "candidates")
    C.discard(entries)
    if second.limit(1).count():
        links = C.materialise(links.union(_verify(second, classes, docs, doc_id, text, k, num, den)), "links")
        found = components(links).withColumnRenamed("node", "cid")

    named = classes.select("fp", "cid", "doc").join(found, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = named.join(least, "component")
    number = []
    if count_links:
        named = named.join(_all_links(classes, found, docs, doc_id, text, k, num, den), "cid", "left")
        number = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")]
    # rows without shingles have no fingerprint; in the join their null keys would meet in one task
    out = rows.where("n > 0").join(named.select("fp", "component_id", *number), "fp").select("doc", "h", F.col("n").alias("n_shingles"), *(["n_links"] if number else []), "component_id")
    alone = rows.where("n = 0").select("doc", "h", F.col("n").alias("n_shingles"), *([F.lit(0).cast("long").alias("n_links")] if number else []), F.col("doc").alias("component_id"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near copies: of each component the row with the smallest id stays, with its columns.

    Rows without shingles stay. Of rows that repeat that smallest id and text, all stay (they are one document);
    rows with a null id stay only where their component has no other.
    """
    found = _joined(docs, k, num, den, doc_id, text)
    drop = found.where(~F.col("doc").eqNullSafe(F.col("component_id"))).select("doc", "h").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col(f"`{text}`")).alias("key"))
    return rows.join(drop, F.col(f"row.`{doc_id}`").eqNullSafe(F.col("doc")) & (F.col("key") == F.col("h")), "left_anti").select("row.*")
