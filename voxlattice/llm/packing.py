"""Best-fit packing with swap-based local search.

Documents become token pieces; pieces are dealt to blocks of bounded size, and each block is packed by best fit and
then improved by moves and exchanges between underfull bins that raise the sum of squared fills until bins empty.
Bins that stay rather empty are pooled and packed once more across blocks.
"""

from __future__ import annotations

import json
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Pieces in a block, about.
BLOCK = 10_000
#: Words whose ids a task remembers (some 20 MB); when there are more, it starts again.
CACHE = 200_000


# ---- tokens ----


class Tokens:
    """Ids of a byte-level BPE file as bytes (little-endian, 32 bits), remembering space-parted words.

    Words go through a byte-pair encoder with the file's ranks; a text that holds one of the file's added tokens is
    encoded by `tokenizers` itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path) as f:
            file = json.load(f)
        self.path, self.added = path, [t["content"] for t in file["added_tokens"]]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE writes bytes as characters
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte[c] for c in w): i for w, i in file["model"]["vocab"].items() if w not in self.added and all(c in byte for c in w)}
        self.encoding = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first, self.spaced = _Cache(self, ""), _Cache(self, " ")
        self.newline = self.plain("\n")
        self.whole = None

    def plain(self, text: str) -> bytes:
        return array("I", self.encoding.encode_ordinary(text)).tobytes()

    def __call__(self, text: str) -> bytes:
        """Where single spaces and newlines part the words, each word's ids stand alone; other texts are encoded whole."""
        if any(t in text for t in self.added):
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path)
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _other_space(text):
            return self.plain(text)
        out = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.newline)
            words = line.split(" ")
            if words[0]:
                out.append(self.first[words[0]])
            out.extend(map(self.spaced.__getitem__, words[1:]))
        self.first.trim()
        self.spaced.trim()
        return b"".join(out)


class _Cache(dict):
    def __init__(self, tokens: Tokens, before: str):
        self.tokens, self.before = tokens, before

    def __missing__(self, word: str) -> bytes:
        found = self.tokens.plain(self.before + word)
        if len(word) < 40:
            self[word] = found
        return found

    def trim(self):
        if len(self) > CACHE:
            self.clear()


_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_WIDE = "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def _other_space(text: str) -> bool:
    return any(c in text for c in _SPACES) or not text.isascii() and any(c in text for c in _WIDE)


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and an end id, cut into pieces where longer than capacity.

    The first piece of a cut document holds the remainder, the others are full. A null text is empty: the end id alone.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    close = array("I", [end]).tobytes()

    def cut(batches):
        encode = Tokens(path)  # a task's own: workers are used again, and would keep its words
        for batch in batches:
            for part in C.slices(batch, "t"):
                rows, no, start, length, crc = [], [], [], [], []
                for d, t in enumerate(part.column("t").to_pylist()):
                    ids = encode(t or "") + close
                    n = len(ids) // 4
                    at = 0
                    for k in range(-(-n // capacity)):
                        size = (n - 1) % capacity + 1 if k == 0 else capacity
                        rows.append(d)
                        no.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                        at += size
                yield pa.RecordBatch.from_arrays([part.column("doc").take(pa.array(rows, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("t"))
    return rows.mapInArrow(cut, f"doc {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("doc", doc_id)


# ---- bins ----


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit by falling length: each item goes to the fullest bin that still holds it."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin with r left exists
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = some >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            k = room[left].pop()
            if not room[left]:
                some &= ~(1 << left)
        else:
            left, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        room[left - n].append(k)
        some |= 1 << (left - n)
    return bins


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search: empty the least filled bins by moves, one-for-one and two-for-one exchanges with other underfull bins.

    Each step raises the sum of squared fills, as fill goes from the emptier to the fuller bin, so the search ends. Bins
    are taken as donors from the emptiest up, until none of a donor's items finds a step; such passes follow each other
    while one of them empties a bin, unless the bins are as few as the lengths allow.
    """
    fewest = max(-(-int(lengths.sum()) // capacity), int((lengths * 2 > capacity).sum()))
    full = [b for b in bins if int(lengths[b].sum()) == capacity]
    left = [b for b in bins if int(lengths[b].sum()) < capacity]
    emptied = True
    while emptied and len(left) > 1 and len(full) + len(left) > fewest:
        search = _Search(left, lengths, capacity)
        emptied = False
        for donor in sorted(range(len(left)), key=lambda k: (int(search.fill[k]), k)):
            if len(full) + search.used <= fewest:
                break
            while search.fill[donor] and search.step(donor):
                pass
            emptied |= not search.fill[donor]
        done = search.bins()
        full += [b for b in done if int(lengths[b].sum()) == capacity]
        left = [b for b in done if int(lengths[b].sum()) < capacity]
    return full + left


class _Search:
    """Underfull bins as arrays: each item's bin, length and place in the order of (bin, length)."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.capacity = capacity
        self.item = np.array([i for b in bins for i in b], np.int64)
        self.size = lengths[self.item].astype(np.int64)
        self.own = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        self.fill = np.bincount(self.own, weights=self.size, minlength=len(bins)).astype(np.int64)
        self.used = len(bins)
        self._sort()

    def _sort(self):
        """Order the items by bin and length; (bin, length) as one number finds a bin's least item of a length or more."""
        order = np.lexsort((self.size, self.own))
        self.item, self.size, self.own = self.item[order], self.size[order], self.own[order]
        self.key = self.own * (self.capacity + 1) + self.size

    def bins(self) -> list[list[int]]:
        return [self.item[self.own == k].tolist() for k in np.flatnonzero(self.fill)]

    def _give(self, place: int, to: int, back: list[int], donor: int):
        n = int(self.size[place]) - sum(int(self.size[p]) for p in back)
        self.own[place] = to
        self.own[back] = donor
        self.fill[to] += n
        self.fill[donor] -= n
        self.used -= not self.fill[donor]
        self._sort()

    def step(self, donor: int) -> bool:
        """One move or exchange out of the donor that raises the squares, the one that gives most away; False if there is none."""
        mine = np.flatnonzero(self.own == donor)
        _, some = np.unique(self.size[mine], return_index=True)
        room = self.capacity - self.fill
        room[donor] = -1
        free = room[self.own]
        for place in mine[some][::-1].tolist():
            n = int(self.size[place])
            # a bin that gets `gain` must end fuller than the donor was, or the squares fall
            least = self.fill[donor] - self.fill
            fits = np.flatnonzero((room >= n) & (n > least) & (self.fill > 0))
            if len(fits):
                self._give(place, int(fits[np.argmin(room[fits])]), [], donor)
                return True
            gain = n - self.size
            one = np.flatnonzero((gain > 0) & (gain <= free) & (gain > least[self.own]))
            # with each item as the first, the least second one of its bin that leaves the sum within the room
            wanted = np.maximum(gain - free, 1)
            second = np.searchsorted(self.key, self.own * (self.capacity + 1) + np.minimum(wanted, self.capacity))
            second += second == np.arange(len(second))
            at = np.minimum(second, len(second) - 1)
            both = gain - self.size[at]
            two = np.flatnonzero((free > 0) & (gain > 1) & (second < len(second)) & (self.own[at] == self.own) & (both > 0) & (both <= free) & (both > least[self.own]))
            best1 = int(gain[one].max()) if len(one) else 0
            best2 = int(both[two].max()) if len(two) else 0
            if best1 and best1 >= best2:
                p = int(one[np.argmax(gain[one])])
                self._give(place, int(self.own[p]), [p], donor)
                return True
            if best2:
                p = int(two[np.argmax(both[two])])
                self._give(place, int(self.own[p]), [p, int(second[p])], donor)
                return True
        return False


def _pack_block(table: pa.Table, capacity: int) -> pa.Table:
    lengths = table.column("length").to_numpy().astype(np.int64)
    bins = improve(best_fit(lengths, capacity), lengths, capacity)
    number, offset, filled = (np.zeros(len(lengths), np.int64) for _ in range(3))
    for k, b in enumerate(bins):
        sizes = lengths[b]
        number[b], offset[b], filled[b] = k, np.cumsum(sizes) - sizes, sizes.sum()
    block = table.column("block").to_numpy()
    return pa.table({"row": table.column("row"), "length": table.column("length"), "sequence": pa.array(block * (1 << 24) + number), "place": pa.array(offset), "filled": pa.array(filled)})


def pack(items: DataFrame, capacity: int = 2048, block: int = BLOCK) -> DataFrame:
    """The rows of a table with `length` (1 to capacity) with sequence_id and offset: places in sequences of at most capacity.

    Rows are dealt to blocks by their place in the written table, so neither repeated rows nor hot keys meet in one
    task. Sequences less than three quarters full are pooled over all blocks and packed again. Columns of the input
    that are named sequence_id or offset are kept as sequence_id_in and offset_in. An empty table gives no rows.
    """
    row = F.struct(*[F.col(f"`{c}`").alias(f"{c}_in" if c in ("sequence_id", "offset") else c) for c in items.columns])
    packed_row = items.select(row.alias("row"), F.col("length").cast("long").alias("length"))
    fields = packed_row.schema
    for name in ("sequence", "place", "filled"):
        fields = fields.add(name, "long")

    def once(rows: DataFrame, first_block: int) -> tuple[DataFrame, int]:
        rows = C.materialise(rows, "pieces")
        blocks = -(-rows.count() // block) or 1
        at = F.monotonically_increasing_id()
        rows = rows.withColumn("block", first_block + F.pmod(at + F.shiftrightunsigned(at, 33) * 7919, F.lit(blocks)))
        return rows.groupBy("block").applyInArrow(lambda t: _pack_block(t, capacity), fields), first_block + blocks

    packed, after = once(packed_row, 0)
    packed = C.materialise(packed, "packed")
    loose = F.col("filled") * 4 < capacity * 3
    again, _ = once(packed.where(loose).select("row", "length"), after)
    return packed.where(~loose).union(again).select("row.*", F.col("sequence").alias("sequence_id"), F.col("place").alias("offset"))
