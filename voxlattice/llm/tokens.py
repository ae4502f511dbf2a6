"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced where both sides agree.

Byte-pair encoding is decided pair by pair: a sequence of tokens is the encoding of its text exactly if every two
neighbours are the encoding of the two together (a merge across a boundary would also happen between those two
alone). So if two overlapping chunks both have a token from p on, and it is the same, the left chunk's tokens up to it
and the right chunk's from there on are the encoding of the whole: every neighbouring pair stands in one of the chunks.
Where an overlap has no such token, the text is cut again with larger chunks and overlaps, until one chunk holds it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Code points in a chunk and in what it shares with the next; longer texts than a chunk are cut.
CHUNK, OVERLAP = 16_384, 256
#: Both grow by this factor for a text without an agreed token in some overlap.
WIDER = 4


class Pieces:
    """A sentencepiece BPE model without text normalisation, and how many code points each of its ids stands for."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        if self.model.normalize("  Å ﬁ\t ").replace("▁", " ").removeprefix(" ") != "  Å ﬁ\t ":
            raise ValueError("the model changes texts before it cuts them; chunks of such texts can't be spliced")
        n = self.model.get_piece_size()
        # a character without a piece becomes its bytes: the first counts as the character, the others as nothing
        self.width = np.array([self._byte(k) if self.model.is_byte(k) else len(self.model.id_to_piece(k)) for k in range(n)], np.int64)

    def _byte(self, k: int) -> int:
        return int(not 0x80 <= int(self.model.id_to_piece(k)[1:-1], 16) < 0xC0)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def tokens(self, text: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Number of ids; and of the tokens: start in the text (-1: with the mark that precedes every text), id, and ids before."""
        ids = np.array(self.model.encode(text, num_threads=1), np.int64)
        width = self.width[ids]
        at = np.flatnonzero(width)
        return len(ids), (np.cumsum(width) - width - 1)[at], ids[at], at


def starts(length: int, chunk: int, overlap: int) -> range:
    """Where the chunks of a text begin: each has chunk + overlap code points, the last between overlap and that many."""
    return range(0, max(length - overlap, 1), chunk)


def splice(left: tuple, right: tuple) -> tuple[int, int] | None:
    """Ids before the last token that both have at the same place: in the left chunk and in the right one."""
    (lp, li, lk), (rp, ri, rk) = left, right
    both, a, b = np.intersect1d(lp, rp, assume_unique=True, return_indices=True)
    same = np.flatnonzero(li[a] == ri[b])
    return (int(lk[a[same[-1]]]), int(rk[b[same[-1]]])) if len(same) else None


_EDGE = "struct<at:array<long>,id:array<long>,before:array<long>>"


def count_tokens(docs: DataFrame, model: str, chunk: int = CHUNK, overlap: int = OVERLAP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row, as the model encodes the whole text.

    Null texts are empty: 0 and 0. Repeated rows and null ids are counted row by row. Texts of more than `chunk` code
    points are dealt over all tasks in chunks. An empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))

    def whole(batches):
        encode = Pieces(model)
        for batch in batches:
            for part in C.slices(batch, "t"):
                n = encode.counts(part.column("t").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc"), pc.cast(pc.binary_length(part.column("t")), pa.int64()), pa.array(n, pa.int64())], names=["doc", "n_bytes", "n_tokens"])

    short = rows.where(F.length("t") <= chunk).mapInArrow(whole, f"doc {kind}, n_bytes long, n_tokens long")
    huge = C.materialise(rows.where(F.length("t") > chunk).select(F.monotonically_increasing_id().alias("row"), "doc", "t"), "huge")
    counted = None
    todo = huge.select("row", "t")
    while todo.limit(1).count():
        found = C.materialise(_spliced(todo, model, chunk, overlap), "spliced")
        counted = found.where("whole") if counted is None else counted.union(found.where("whole"))
        failed = found.where("not whole").select("row")
        todo = huge.select("row", "t").join(C.small(failed), "row", "left_semi")
        chunk, overlap = WIDER * chunk, WIDER * overlap
    if counted is not None:
        lengths = huge.select("row", "doc", F.octet_length("t").cast("long").alias("n_bytes"))
        short = short.union(lengths.join(counted, "row").select("doc", "n_bytes", "n_tokens"))
    return short.withColumnRenamed("doc", doc_id)


def _spliced(rows: DataFrame, model: str, chunk: int, overlap: int) -> DataFrame:
    """(row, n_tokens, whole) of texts (row, t): the spliced count, and whether every seam had a token to splice at."""

    def cut(batches):
        for batch in batches:
            for row, t in zip(batch.column("row").to_pylist(), batch.column("t").to_pylist()):
                at = starts(len(t), chunk, overlap)
                for k, a in enumerate(at):
                    yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int64()), "k": pa.array([k], pa.int32()), "last": pa.array([k + 1 == len(at)]), "t": pa.array([t[a : a + chunk + overlap]], pa.string())})

    def encode(batches):
        pieces = Pieces(model)
        edge = pa.struct([(c, pa.list_(pa.int64())) for c in ("at", "id", "before")])
        for batch in batches:
            n, heads, tails = [], [], []
            for k, last, t in zip(batch.column("k").to_pylist(), batch.column("last").to_pylist(), batch.column("t").to_pylist()):
                count, at, ids, before = pieces.tokens(t)
                n.append(count)
                head, tail = (at >= 0) & (at <= overlap), at >= chunk
                heads.append({"at": at[head], "id": ids[head], "before": before[head]} if k else None)
                tails.append(None if last else {"at": at[tail] - chunk, "id": ids[tail], "before": before[tail]})
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array(n, pa.int64()), pa.array(heads, edge), pa.array(tails, edge)], names=["row", "k", "n", "head", "tail"])

    def seams(batches):
        for batch in batches:
            out = []
            for n, left, right in zip(*(batch.column(c).to_pylist() for c in ("n", "tail", "head"))):
                edge = lambda e: tuple(np.array(e[c], np.int64) for c in ("at", "id", "before"))
                found = splice(edge(left), edge(right))
                out.append(None if found is None else n - found[0] + found[1])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.int64())], names=["row", "twice"])

    chunks = rows.mapInArrow(cut, "row long, k int, last boolean, t string").repartition("row", "k")
    coded = C.materialise(chunks.mapInArrow(encode, f"row long, k int, n long, head {_EDGE}, tail {_EDGE}"), "chunks")
    left, right = coded.where("tail is not null").select("row", "k", "n", "tail"), coded.where("k > 0").select("row", (F.col("k") - 1).alias("k"), "head")
    twice = left.join(right, ["row", "k"]).select("row", "n", "tail", "head").mapInArrow(seams, "row long, twice long")
    # tokens that both chunks of a seam count, or null where they don't agree
    each = coded.select("row", "n", F.lit(True).alias("fits")).union(twice.select("row", -F.coalesce("twice", F.lit(0).cast("long")), F.col("twice").isNotNull()))
    return each.groupBy("row").agg(F.sum("n").alias("n_tokens"), F.min("fits").alias("whole"))
