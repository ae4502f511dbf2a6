"""What the text operators share: reading, shared folders, word hashing over Arrow buffers, sketch merging."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of this many narrow rows (some 40 bytes each) may be broadcast; above it the join shuffles.
BROADCAST_ROWS = 400_000
#: Bytes of text that are hashed at once, so that a task's arrays stay small whatever the batch.
CHUNK = 1 << 18
#: A key held by more than 1/HEAVY of all rows is dealt over SALTS partitions; there are fewer than HEAVY such keys.
HEAVY, SALTS = 1000, 64
_U = np.uint64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of its own; on a cluster that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='voxlattice-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, survives lost executors, fixes row ids."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _place(uri: str) -> str:
    """A path without its scheme and authority, which Spark may add to what the setting says."""
    return re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", uri)


def discard(*tables: DataFrame) -> None:
    """Delete tables of `materialise` that nothing reads any more; those in a store that pyarrow can't open stay."""
    for df in tables:
        top = _place(shared_dir(df.sparkSession))
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if not _place(folder).startswith(f"{top}/"):
                raise ValueError(f"{folder} was not written here")
            try:
                system, place = fs.FileSystem.from_uri(folder if "://" in folder else folder.replace(":/", ":///", 1))
                system.delete_dir(place)
            except (pa.ArrowInvalid, OSError):
                continue


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint a broadcast only if the counted rows are within the bound; otherwise leave the join to shuffle."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], counts: DataFrame, total: int, salt_by: list[str], how: str = "inner") -> DataFrame:
    """rows joined with a table of unique keys; keys that hold many of the `total` rows are dealt over SALTS partitions.

    counts has the keys and `count`, how many rows hold each. The keys above total / HEAVY are fewer than HEAVY, so
    their list is broadcast; which of a heavy key's partitions a row takes follows from its columns salt_by.
    """
    heavy = F.broadcast(counts.where(F.col("count") * HEAVY > total).select(*keys, F.lit(True).alias("_heavy")))
    left = rows.join(heavy, keys, "left").withColumn("_salt", F.when(F.col("_heavy"), F.pmod(F.xxhash64(*salt_by), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))).drop("_heavy")
    every = F.when(F.col("_heavy"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    right = table.join(heavy, keys, "left").withColumn("_salt", F.explode(every)).drop("_heavy")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def text_key(text: str = "text"):
    """A row's second key beside its id, so that repeated ids with other texts stay apart."""
    return F.xxhash64(F.col(text))


# ---- words as 64-bit hashes, straight from Arrow's buffers ----


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Alphabet:
    """Which bytes make words, and each byte's random letter value; bytes that fold together share a value."""

    def __init__(self, separators: bytes, lower: bool):
        codes = np.arange(256, dtype=_U)
        if lower:
            codes[65:91] += _U(32)
        self.word = np.ones(256, dtype=bool)
        self.word[list(separators)] = False
        self.letters = mix64((codes + _U(1)) * _U(0x9E3779B97F4A7C15)) | _U(1)
        self.letters[~self.word] = 0


#: `[^\x20\x09-\x0D]+`, unchanged or with A-Z lowered, and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lowering A-Z.
PLAIN = Alphabet(b" \t\n\x0b\x0c\r", lower=False)
LOWER = Alphabet(b" \t\n\x0b\x0c\r", lower=True)
ALNUM = Alphabet(bytes(c for c in range(128) if not chr(c).isalnum()), lower=True)



def _geometric(q: int, n: int) -> np.ndarray:
    out = np.full(n, q, dtype=_U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_powers = _geometric(0x5851F42D4C957F2D, 4096)


def _power_table(n: int) -> np.ndarray:
    """The powers for words of n bytes; a longer table than the usual one is made for its use alone."""
    return _powers if n <= len(_powers) else _geometric(0x5851F42D4C957F2D, n)


def _hash_chunk(buf: np.ndarray, cuts: np.ndarray, abc: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = abc.word[buf]
    first = w.copy()
    first[1:] &= ~w[:-1]
    first[cuts] = w[cuts]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, starts, starts.astype(_U)
    rel = starts - starts[0]
    size = np.add.reduceat(w[starts[0] :].astype(np.int32), rel)
    powers = _power_table(int(size.max()))
    at = np.arange(len(buf) - starts[0]) - np.repeat(rel, np.diff(np.append(rel, len(buf) - starts[0])))
    h = np.add.reduceat(abc.letters[buf[starts[0] :]] * powers[np.minimum(at, len(powers) - 1)], rel)
    return starts, size, mix64(h + size.astype(_U) * _U(0x9E3779B97F4A7C15))


def hash_words(data: np.ndarray, offsets: np.ndarray, abc: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every word of the texts data[offsets[d]:offsets[d+1]]: start and size in bytes, hash, and each text's first word."""
    out, at, total = [], 0, len(data)
    while at < total:
        end = min(at + CHUNK, total)
        while end < total:  # move on to a text's start or a separator, so that no word is cut
            stop = min(end + 4096, total)
            sep = np.flatnonzero(~abc.word[data[end:stop]])
            k = np.searchsorted(offsets, end)
            cut = min(int(offsets[k]), end + int(sep[0]) if len(sep) else total)
            end = cut if cut <= stop else stop
            if cut <= stop:
                break
        cuts = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
        s, n, h = _hash_chunk(data[at:end], cuts, abc)
        out.append((s + at, n, h))
        at = end
    starts, sizes, hashes = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U))
    return starts, sizes, hashes, np.searchsorted(starts, offsets)


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow text column; null reads as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many bytes of text, or one longer text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at, done = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield batch.slice(at, end - at)
        at, done = end, int(sizes[end - 1])


def runs(values: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of every k consecutive word hashes (positions 0 .. len - k), over any text boundaries."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    if k <= 8:
        out = np.zeros(n, _U)
        factor = _U(2 * seed + 1)
        for j in range(k):
            factor = _U((int(factor) * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % (1 << 64) | 1)
            out += values[j : j + n] * factor
        return mix64(out)
    q = 0x2545F4914F6CDD1D + 2 * seed * 0x1000193
    inverse = pow(q, -1, 1 << 64)
    up, down = _geometric(q, len(values)), _geometric(inverse, n)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(mix64(values + _U(seed)) * up)))
    return mix64((sums[k:] - sums[:-k]) * down)


# ---- sketches of counters, made in blocks by each partition and merged by a shuffle ----

BLOCK = 1 << 16


def sketch_blocks(cells: np.ndarray, cap: int) -> Iterator[tuple[int, bytes]]:
    """A partition's counters, by block of cells: sparse (cell, count up to cap) or all of them, whichever is shorter."""
    ids, counts = np.unique(cells, return_counts=True)
    counts = np.minimum(counts, cap).astype(np.uint16)
    edges = np.flatnonzero(np.diff(ids // BLOCK)) + 1
    for i, c in zip(np.split(ids, edges), np.split(counts, edges)):
        if not len(i):
            continue
        low = (i % BLOCK).astype(np.uint16)
        if len(i) * 2 >= BLOCK:
            dense = np.zeros(BLOCK, np.uint16)
            dense[low] = c
            yield int(i[0] // BLOCK), b"d" + dense.tobytes()
        else:
            yield int(i[0] // BLOCK), b"s" + low.tobytes() + c.tobytes()


def merge_sketches(parts: DataFrame, finish: Callable[[np.ndarray], bytes]) -> dict[int, bytes]:
    """Sum the partitions' blocks (block int, cells binary), one block at a time, and bring finish(counts) of each to the driver.

    The driver gets at most width / BLOCK rows, whose size the caller's sketch width bounds.
    """

    def merge(batches):
        at, counts = None, None
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block != at:
                    if at is not None:
                        yield pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int32()), "cells": pa.array([finish(counts)], pa.binary())})
                    at, counts = block, np.zeros(BLOCK, np.uint32)
                if raw[:1] == b"d":
                    counts += np.frombuffer(raw, np.uint16, offset=1)
                else:
                    n = (len(raw) - 1) // 4
                    counts[np.frombuffer(raw, np.uint16, n, 1)] += np.frombuffer(raw, np.uint16, n, 1 + 2 * n)
        if at is not None:
            yield pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int32()), "cells": pa.array([finish(counts)], pa.binary())})

    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, cells binary")
    return {r[0]: r[1] for r in merged.collect()}


def twice(counts: np.ndarray) -> bytes:
    """A block's bitmap of cells counted at least twice."""
    return np.packbits(counts >= 2).tobytes()


class Bitmap:
    """Cells of a merged count-min sketch that were counted twice or more; one row of cells per seed."""

    def __init__(self, width: int, rows: int, blocks: dict[int, bytes]):
        self.width, self.rows = width, rows
        self.bits = np.zeros(width * rows // 8, np.uint8)
        for k, raw in blocks.items():
            self.bits[k * BLOCK // 8 : (k + 1) * BLOCK // 8] = np.frombuffer(raw, np.uint8)

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for r in range(self.rows):
            c = cells(keys, self.width, r)
            out &= (self.bits[c >> 3] >> (7 - (c & 7)) & 1).astype(bool)
        return out


def cells(keys: np.ndarray, width: int, row: int) -> np.ndarray:
    return (mix64(keys + _U(row * 0x9E3779B97F4A7C15 % (1 << 64))) & _U(width - 1)).astype(np.int64) + row * width


def sketch_width(items: float, each: int, least: int = BLOCK, most: int = 1 << 27) -> int:
    """A power of two with about so many cells for each item, within fixed bounds."""
    return min(most, max(least, 1 << max(0, int(items * each) - 1).bit_length()))


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
