"""Toxicity by noisy-channel deobfuscation.

A character language model is counted over all documents. Words with digits or signs for letters, repeated letters or
spaced letters become lattices of what they may stand for; Viterbi finds the likeliest reading. The restored words and
their beginnings, which many rare forms of one stem share, are scored with weights learned from labelled rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Labelled rows that the classifier is fitted on, at most; they are the ones with the least hashes of their ids.
SAMPLE = 20_000
#: Characters of a longer word's beginnings that count as features beside the word.
STEMS = (4, 6)
FEATURES = 4
#: Share of the lexicon that may be there by chance, and the ratio beyond which the test looks no closer.
FALSE_SHARE, SURE = 0.1, 200.0
ORDER, SYMBOLS = 4, 28  # a-z are 1-26, word ends 0, other letters 27
#: What a sign may stand for, and how likely. Fixed values.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "+": "t"}
KEEP, SUBSTITUTE, REPEAT, DROP, JOIN, SPLIT = -6.0, -0.7, -0.2, -1.5, -0.1, -2.5

_code = np.zeros(256, np.int64)
_code[97:123] = _code[65:91] = np.arange(1, 27)
_code[128:] = 27
_signs = np.zeros(256, bool)
_signs[[ord(c) for c in LEET]] = True
_letter = np.zeros(256, bool)
_letter[97:123] = _letter[65:91] = True
WORDS = C.Alphabet(bytes(c for c in range(128) if not (chr(c).isalnum() or chr(c) in LEET)), lower=True)


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log P(character | three before), counted over all documents and smoothed by lower orders."""

    def count(batches):
        total = np.zeros(SYMBOLS**ORDER, np.int64)
        for batch in batches:
            for part in C.slices(batch, text, 2 << 20):
                data, offsets = C.text_buffers(part.column(text))
                c = np.insert(_code[data], offsets, 0)  # a word ends where a text does
                key = c[:-3] * SYMBOLS**3 + c[1:-2] * SYMBOLS**2 + c[2:-1] * SYMBOLS + c[3:]
                total += np.bincount(key, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(at), "n": pa.array(total[at])})

    grams = docs.select(text).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    n = np.zeros(SYMBOLS**ORDER)
    for r in grams.collect():  # at most 28**4 rows
        n[r[0]] = r[1]
    n = n.reshape((SYMBOLS,) * ORDER)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(1, ORDER + 1):
        own = n.sum(axis=tuple(range(ORDER - order))) if order < ORDER else n
        p = (own + 5.0 * p) / (own.sum(axis=-1, keepdims=True) + 5.0)
    return np.log(p).astype(np.float32)


def _lattice(token: str) -> list[list[tuple[str, float]]]:
    """Per sign or run of a token, what it may read as: (text, log probability); spaces part spaced letters."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        c = token[i]
        j = i
        while j < len(token) and token[j] == c:
            j += 1
        n = j - i
        if c == " ":
            out.append([("", JOIN), (" ", SPLIT)])
        elif c in LEET:
            ways = [(x * min(n, 2), SUBSTITUTE) for x in LEET[c]] + [(x, SUBSTITUTE + REPEAT * (n - 1)) for x in LEET[c] if n > 1]
            ways.append((" ", KEEP))  # it stands for itself, which no word holds
            if c in "!$@+":
                ways.append(("", DROP))
            out.append(ways)
        elif n >= 2:
            out.append([(c, REPEAT if n > 2 else 3 * REPEAT), (c * 2, 0.0 if n == 2 else REPEAT)])
        else:
            out.append([(c, 0.0)])
        i = j
    return out


_AT = {" ": 0, **{chr(96 + k): k for k in range(1, 27)}}
_STATES = SYMBOLS ** (ORDER - 1)


def decode(token: str, model: np.ndarray | list[float]) -> list[str]:
    """The likeliest words that a token (lower case, single letters parted by spaces) stands for, in time linear in its length.

    The model may be given as its flat list.
    """
    flat = model if isinstance(model, list) else model.ravel().tolist()
    best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}  # by the last three symbols
    for ways in [*_lattice(token), [(" ", 0.0)]]:
        new: dict[int, tuple[float, tuple]] = {}
        for state, (score, said) in best.items():
            for piece, cost in ways:
                s, p = state, score + cost
                for ch in piece:
                    k = _AT.get(ch, 27)
                    if k or s % SYMBOLS:  # one word end is enough
                        s = s * SYMBOLS + k
                        p += flat[s]
                        s %= _STATES
                if s not in new or p > new[s][0]:
                    new[s] = (p, (said, piece))
        best = new
    _, said = max(best.values(), key=lambda x: x[0])
    pieces = []
    while said:
        said, piece = said
        pieces.append(piece)
    return "".join(reversed(pieces)).split()


def _stems(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of the beginnings of words that are longer than them."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    reach = np.minimum(sizes, 4 * max(STEMS) + 4)  # bytes that can hold the longest beginning and a character more
    firsts = np.cumsum(reach) - reach
    at = np.arange(reach.sum()) - np.repeat(firsts, reach)
    byte = data[np.repeat(starts, reach) + at]
    begins = np.cumsum((byte & 0xC0) != 0x80)
    character = begins - np.repeat(begins[firsts], reach)
    values = WORDS.letters[byte] * C._power_table(int(reach.max()))[at]
    longest = np.maximum.reduceat(character, firsts)
    words, hashes = [], []
    for k in STEMS:
        h = np.add.reduceat(np.where(character < k, values, np.uint64(0)), firsts)
        longer = np.flatnonzero(longest >= k)
        words.append(longer)
        hashes.append(C.mix64(h[longer] ^ np.uint64(0x5BD1E9955BD1E995 + k)))
    return np.concatenate(words), np.concatenate(hashes)


class Reader:
    """Restored words of a batch of texts and their beginnings, as hashes. Tokens with signs or doubled letters are decoded, whatever their length."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.flat = model.ravel().tolist()
        self.short = lru_cache(maxsize=50_000)(self._restored)

    def restored(self, token: str) -> tuple[str, ...]:
        return self.short(token) if len(token) <= 120 else self._restored(token)  # long ones are not kept

    def _restored(self, token: str) -> tuple[str, ...]:
        return tuple(decode(token, self.flat))

    def __call__(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text index, hash) of every word read and of its beginnings, and each text's number of plain words."""
        data, offsets = C.text_buffers(column)
        starts, sizes, hashes, first = C.hash_words(data, offsets, WORDS)
        n_words = np.diff(first)
        doc = np.repeat(np.arange(len(n_words)), n_words)
        if not len(starts):
            return doc, hashes, n_words
        odd = np.zeros(len(starts), bool)
        signs = np.flatnonzero(_signs[data])
        double = np.flatnonzero(_letter[data[:-1]] & ((data[:-1] | 32) == (data[1:] | 32)))
        for at in (signs, double):
            odd[np.maximum(np.searchsorted(starts, at, side="right") - 1, 0)] = True
        letters = np.add.reduceat(_letter[data[starts[0] :]].astype(np.int32), starts - starts[0])
        odd &= letters > 0
        lone = sizes == 1
        near = np.append(False, lone[1:] & lone[:-1] & (starts[1:] - starts[:-1] == 2) & (doc[1:] == doc[:-1]))
        extra_doc, extra = [], []
        told = np.flatnonzero(odd & ~lone)
        _, some, same = np.unique(hashes[told], return_index=True, return_inverse=True)
        said = [self.restored(data[starts[i] : starts[i] + sizes[i]].tobytes().decode("utf-8", "replace").lower()) for i in told[some].tolist()]
        for i, k in zip(told.tolist(), same.tolist()):
            extra_doc.extend([doc[i]] * len(said[k]))
            extra.extend(said[k])
        begin = np.flatnonzero(lone & ~near)
        ends = np.append(np.flatnonzero(lone & ~np.append(near[1:], False)), []).astype(np.int64)
        for a, b in zip(begin.tolist(), ends.tolist()):
            if b - a >= 2:
                signs_ = [chr(data[starts[i]]).lower() for i in range(a, b + 1) if data[starts[i]] < 128]
                said_ = self.restored(" ".join(signs_))
                extra_doc.extend([doc[a]] * len(said_))
                extra.extend(said_)
        said_data, said_offsets = C.text_buffers(pa.array(extra, pa.string()))
        more_starts, more_sizes, more, at = C.hash_words(said_data, said_offsets, WORDS)
        more_doc = np.repeat(np.array(extra_doc, np.int64), np.diff(at))
        stem, stem_hashes = _stems(data, starts, sizes)
        more_stem, more_hashes = _stems(said_data, more_starts, more_sizes)
        return np.concatenate([doc, more_doc, doc[stem], more_doc[more_stem]]), np.concatenate([hashes, more, stem_hashes, more_hashes]), n_words


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])) if len(doc) else np.zeros(0, bool)
    return doc[new], h[new]


def _features(doc, h, n_words, words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per text: the strongest word, the sum over distinct strong words, their number, and strong words for every hundred."""
    at = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
    hit = words[at] == h if len(words) else np.zeros(len(h), bool)
    out = np.zeros((len(n_words), FEATURES))
    np.add.at(out[:, 3], doc[hit], weights[at[hit]])
    doc, h = _distinct(doc[hit], h[hit])
    w = weights[np.searchsorted(words, h)]
    np.maximum.at(out[:, 0], doc, w)
    np.add.at(out[:, 1], doc, w)
    np.add.at(out[:, 2], doc, 1)
    out[:, 3] *= 100 / np.maximum(n_words, 1)
    out[:, 1:] = np.log1p(out[:, 1:])
    return out


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Weighted logistic regression by Newton's method on a bounded table of a few features."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * len(x) * 0.01 * np.eye(len(w)) + 1e-6 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - ridge * 0.01 * len(x) * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _rising(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """As _fit, but no feature lowers the score: those that would are left out, the most negative first.

    More strong words never make a text look cleaner, even if a mislabelled row says so.
    """
    used = list(range(x.shape[1]))
    while True:
        w = _fit(x[:, used], y, weight)
        least = int(np.argmin(w[:-1])) if used else 0
        if not used or w[least] >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[[*used, -1]] = w
            return out
        del used[least]


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(4)) == 2


def _least_ratio(strong: DataFrame, tested: int) -> float:
    """The least likelihood ratio above which chance explains at most FALSE_SHARE of the words (Benjamini and Hochberg)."""
    bins = strong.groupBy(F.floor(F.least("ratio", F.lit(SURE)) * 10).alias("b")).count().collect()  # 2,000 at most
    found, least = 0, SURE
    for b, n in sorted(((r["b"], r["count"]) for r in bins), reverse=True):
        found += n
        by_chance = tested * (1 - NormalDist().cdf((b / 10) ** 0.5))
        if by_chance <= FALSE_SHARE * found:
            least = b / 10
    return least


def train(docs: DataFrame, labels: DataFrame, model: np.ndarray, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "toxic"):
    """(word hashes, their weights, regression weights) from at most `sample` labelled rows outside the held-out part.

    A word's weight is its smoothed log-odds between toxic and other rows, at least 1.5; its likelihood ratio must also be
    so large that at most FALSE_SHARE of the words chosen can be there by chance, however many words were tested. A
    lexicon of many forms so lets in words that few rows hold.
    Every chosen row counts. Rows with one label and the same six least word hashes, as near copies mostly have, weigh as
    one row together, so that the words of a text that was copied often don't look significant for that.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & ~held_out(doc_id)).groupBy(doc_id).agg(F.max(label).alias("_y"))
    chosen = known.orderBy(F.xxhash64(doc_id), doc_id).limit(sample).select(F.col(doc_id).alias("_d"), "_y")
    rows = docs.join(F.broadcast(chosen), F.col(doc_id) == F.col("_d")).select(F.col("_y").cast("int").alias("y"), F.col(text).alias("t"))
    reader = spark.sparkContext.broadcast(model)

    def words(batches):
        read = Reader(reader.value)
        for batch in batches:
            for part in C.slices(batch, "t"):
                doc, h, n = read(part.column("t"))
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                lists = np.split(h, np.searchsorted(doc, np.arange(1, len(n)))) if len(n) else []
                mark = lambda x: hashlib.blake2b(x.tobytes(), digest_size=16).digest()
                near = [mark(np.unique(C.mix64(x ^ np.uint64(0xABCDEF)))[:6]) for x in lists]
                yield pa.RecordBatch.from_pydict({"y": part.column("y"), "near": pa.array(near, pa.binary()), "n_words": pa.array(n, pa.int64()), "words": pa.array([x.view(np.int64) for x in lists], pa.list_(pa.int64()))})

    read = C.materialise(rows.mapInArrow(words, "y int, near binary, n_words long, words array<long>"), "toxic-words")
    shares = read.groupBy("near", "y").agg((1.0 / F.count("*")).alias("share"))
    read = read.join(C.small(shares), ["near", "y"])
    reader.destroy()
    # counted in whole classes, so that the order of a sum doesn't show
    n, toxic = shares.agg(F.count("*"), F.sum("y")).first()
    toxic = toxic or 0
    if not n or not toxic or toxic == n:
        return np.zeros(0, np.uint64), np.zeros(0), np.array([0.0] * FEATURES + [np.log((toxic + 0.5) / (n - toxic + 0.5))])
    counts = read.select("y", "share", F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.round(F.sum(F.col("y") * F.col("share")), 6).alias("t"), F.round(F.sum("share"), 6).alias("n"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (n - toxic + 1))
    tested = counts.count()
    cells = [F.col("t"), F.col("n") - F.col("t"), toxic - F.col("t"), n - toxic - F.col("n") + F.col("t")]
    part = lambda x: F.when(x > 1e-9, x * F.log(F.greatest(x.cast("double"), F.lit(1e-9)))).otherwise(0.0)
    ratio = 2 * (sum(map(part, cells), F.lit(0.0)) - part(F.col("n")) - part(n - F.col("n")) - toxic * float(np.log(toxic)) - (n - toxic) * float(np.log(n - toxic)) + n * float(np.log(n)))
    strong = C.materialise(counts.withColumns({"o": odds, "ratio": ratio}).where("o >= 1.5 and ratio >= 8"), "strong")
    lexicon = strong.where(F.col("ratio") >= _least_ratio(strong, tested)).collect()
    words_ = np.array([r["w"] for r in lexicon], np.int64).view(np.uint64)
    order = np.argsort(words_)
    words_, weights = words_[order], np.array([r["o"] for r in lexicon])[order]
    known = spark.sparkContext.broadcast((words_, weights))

    def features(batches):
        words_, weights = known.value
        for batch in batches:
            lists = batch.column("words")
            h = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            n = np.diff(lists.offsets.to_numpy())
            x = _features(np.repeat(np.arange(len(n)), n), h, batch.column("n_words").to_numpy(zero_copy_only=False), words_, weights)
            yield pa.RecordBatch.from_pydict({f"x{k}": pa.array(x[:, k]) for k in range(FEATURES)} | {"y": batch.column("y"), "share": batch.column("share")})

    # no more rows than labelled rows were chosen; sorted, so that sums come out the same whatever the order of rows
    table = read.select("y", "share", "n_words", "words").mapInArrow(features, "".join(f"x{k} double, " for k in range(FEATURES)) + "y int, share double").collect()
    known.destroy()
    table = np.array(sorted(tuple(r) for r in table), float).reshape(-1, FEATURES + 2)
    return words_, weights, _rising(table[:, :FEATURES], table[:, FEATURES], table[:, FEATURES + 1])


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted, n_strong) of every row; scores come from the text alone.

    A null or empty text has no words and gets the score of a text without toxic words. Rows may repeat. Without
    labels of both kinds every score is the share of toxic labels.
    """
    spark = docs.sparkSession
    model = language_model(docs, text)
    words, weights, fitted = train(docs, labels, model, sample, doc_id, text, label)
    known = spark.sparkContext.broadcast((model, words, weights, fitted))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        model, words, weights, fitted = known.value
        read = Reader(model)
        for batch in batches:
            for part in C.slices(batch, text):
                x = _features(*read(part.column(text)), words, weights)
                p = 1 / (1 + np.exp(-np.clip(np.hstack([x, np.ones((len(x), 1))]) @ fitted, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(p), pa.array(np.rint(np.expm1(x[:, 2])).astype(np.int64))], names=["doc", "score", "n_strong"])

    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias(text)).mapInArrow(run, f"doc {kind}, score double, n_strong long").withColumnRenamed("doc", doc_id)
    return rows.select(doc_id, held_out(doc_id).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "n_strong")
