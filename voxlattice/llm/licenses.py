"""License scans with a positional rare-token index.

Word counts over all documents give the licence words' rarity. In each file the templates are looked up by the file's own
highest-IDF words of them: where those words' places agree on where the template would start, give or take a few inserted
or missing words, the stretch is aligned with the template word by word and mandatory key phrases are verified there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class Template:
    """A licence notice as lower-case words, and the phrases that must stand in it literally."""

    label: str
    words: str
    phrases: tuple[str, ...]


_NOTICES = (  # label, words, key phrases parted by "|". Fixed values.
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license|2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache license|version 2 0"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "permission is hereby granted free of charge|associated documentation files"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("gpl-3.0", "gnu general public license version 3", "gnu general public license|version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license|version 3"),
    ("gpl-2.0", "gnu general public license version 2", "gnu general public license|version 2"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gnu general public license|version 2"),
    ("lgpl-3.0", "gnu lesser general public license version 3", "lesser general public license|version 3"),
    ("lgpl-2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "lesser general public license|version 2 1"),
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", "affero general public license|version 3"),
    ("mpl-2.0", "subject to the terms of the mozilla public license", "mozilla public license"),
    ("epl-2.0", "eclipse public license v 2 0", "eclipse public license|2 0"),
    ("bsl-1.0", "boost software license version 1 0", "boost software license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose", "permission is granted to anyone to use this software"),
    ("cc0-1.0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
    ("all-rights", "all rights reserved", "all rights reserved"),
)
#: Labels whose identifier may follow "SPDX-License-Identifier:".
_SPDX = ("apache-2.0", "mit", "isc", "bsd-2-clause", "bsd-3-clause", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "mpl-2.0", "epl-2.0", "bsl-1.0", "unlicense", "zlib", "cc0-1.0")
_CC = {"by": "attribution", "sa": "sharealike", "nd": "noderivatives", "nc": "noncommercial"}


def _templates() -> tuple[Template, ...]:
    """The notices, and by rule the identifiers and the Creative Commons variants in short, in full and as an address."""
    out = [Template(label, words, tuple(phrases.split("|"))) for label, words, phrases in _NOTICES]
    for label in _SPDX:
        words = "spdx license identifier " + label.replace("-", " ").replace(".", " ")
        out.append(Template(label, words, (words,)))
    for kind in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"):
        for version in ("3.0", "4.0"):
            label, number = f"cc-{kind.replace(' ', '-')}-{version}", version.replace(".", " ")
            full = " ".join(_CC[k] for k in kind.split())
            out.append(Template(label, f"licensed under cc {kind} {number}", (f"cc {kind} {number}",)))
            out.append(Template(label, f"creative commons {full} {number} international license", (f"creative commons {full} {number}",)))
            out.append(Template(label, f"creativecommons org licenses {kind} {number}", (f"licenses {kind} {number}",)))
    return tuple(out)


#: Phrases found wherever their words stand consecutively, and their labels. Fixed values.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Of a template's words in a file, so many of the rarest are looked up; so many of them must agree on its start.
RARE, AGREE = 6, 2
#: Share of the template's words, by rarity, that must stand in order; words that may be inserted, one in so many.
COVER, SLACK = 0.75, 8
TEMPLATES = _templates()


def _vocabulary(templates, phrases) -> list[str]:
    return sorted({w for t in templates for p in (t.words, *t.phrases) for w in p.split()} | {w for p, _ in phrases for w in p.split()})


def _hashes(words: list[str]) -> np.ndarray:
    data, offsets = C.text_buffers(pa.array(words, pa.string()))
    return C.hash_words(data, offsets, C.ALNUM)[2]


class _Coder:
    """Ids of the licence words in a batch of texts (-1: another word)."""

    def __init__(self, vocabulary: list[str]):
        h = _hashes(vocabulary)
        order = np.argsort(h)
        self.sorted, self.ids = h[order], order.astype(np.int32)

    def __call__(self, column) -> tuple[np.ndarray, np.ndarray]:
        _, _, words, first = C.hash_words(*C.text_buffers(column), C.ALNUM)
        at = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
        return np.where(self.sorted[at] == words, self.ids[at], -1), first


def rarity(docs: DataFrame, vocabulary: list[str], text: str = "text") -> np.ndarray:
    """IDF of each licence word over all documents."""
    coder = _Coder(vocabulary)

    def count(batches):
        total = np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            for part in C.slices(batch, text):
                ids, first = coder(part.column(text))
                at = np.flatnonzero(ids >= 0)
                doc = np.searchsorted(first, at, side="right") - 1
                pairs = np.unique(doc * len(vocabulary) + ids[at])
                total[:-1] += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
                total[-1] += part.num_rows
        yield pa.RecordBatch.from_pydict({"word": pa.array(np.arange(len(total), dtype=np.int32)), "n": pa.array(total)})

    counted = docs.select(text).mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    n = np.zeros(len(vocabulary) + 1)
    for r in counted.collect():  # one row a licence word
        n[r[0]] = r[1]
    return np.log((1 + n[-1]) / (1 + n[:-1]))


def slack(template: np.ndarray) -> int:
    return max(2, len(template) // SLACK)


def aligned(template: np.ndarray, weights: np.ndarray, window: np.ndarray) -> float:
    """The largest weight of template words that stand in the window in their order (a weighted longest common subsequence)."""
    best = np.zeros(len(window) + 1)
    for w, v in zip(template.tolist(), weights.tolist()):
        hit = window == w
        if v > 0 and hit.any():
            step = best.copy()
            step[1:] = np.where(hit, np.maximum(best[1:], best[:-1] + v), best[1:])
            best = np.maximum.accumulate(step)
    return float(best[-1])


def holds(ids: np.ndarray, phrase: np.ndarray) -> bool:
    """Whether the phrase's words stand consecutively somewhere."""
    at = np.flatnonzero(ids[: max(0, len(ids) - len(phrase) + 1)] == phrase[0])
    for j, w in enumerate(phrase[1:].tolist(), 1):
        at = at[ids[at + j] == w]
    return bool(len(at))


class _Index:
    """Templates by word: the places of each word in each template, and what share of a template a set of words can cover."""

    def __init__(self, templates, phrases, vocabulary: list[str], idf: np.ndarray):
        ids_of = {w: i for i, w in enumerate(vocabulary)}
        code = lambda text: np.array([ids_of[w] for w in text.split()], np.int32)
        self.labels = [t.label for t in templates]
        self.words = [code(t.words) for t in templates]
        self.keys = [[code(p) for p in t.phrases] for t in templates]
        self.phrases = [code(p) for p, _ in phrases]
        self.idf = idf
        self.whole = np.array([max(float(idf[c].sum()), 1e-9) for c in self.words])
        self.cover = np.zeros((len(vocabulary), len(templates)))
        for t, c in enumerate(self.words):
            np.add.at(self.cover[:, t], c, idf[c])
        self.places = [{w: np.flatnonzero(c == w) for w in set(c.tolist())} for c in self.words]

    def base(self, ids: np.ndarray, first: np.ndarray) -> dict[int, list[dict]]:
        """Per text, the starts of the phrases: places of the rarest word of each, checked at the others' relative positions."""
        out: dict[int, list[dict]] = {}
        for k, p in enumerate(self.phrases):
            rarest = int(np.argmax(self.idf[p]))
            at = np.flatnonzero(ids == p[rarest]) - rarest
            doc = np.searchsorted(first, at + rarest, side="right") - 1
            inside = (at >= first[doc]) & (at + len(p) <= first[doc + 1])
            at, doc = at[inside], doc[inside]
            for j, w in enumerate(p.tolist()):
                same = ids[at + j] == w
                at, doc = at[same], doc[same]
            for d, i in zip(doc.tolist(), at.tolist()):
                out.setdefault(d, []).append({"word": i - int(first[d]), "phrase": k})
        return out

    def candidates(self, ids: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """(text, template) where the text has words enough of the template to cover it."""
        at = np.flatnonzero(ids >= 0)
        doc = np.searchsorted(first, at, side="right") - 1
        some, row = np.unique(doc, return_inverse=True)
        held = np.zeros((len(some), len(self.idf)), bool)
        held[row, ids[at]] = True
        d, t = np.nonzero(held @ self.cover >= COVER * self.whole - 1e-9)
        return list(zip(some[d].tolist(), t.tolist()))

    def find(self, ids: np.ndarray, t: int) -> list[dict]:
        """Where a template stands in one text."""
        c, loose = self.words[t], slack(self.words[t])
        mine = [w for w in self.places[t] if (ids == w).any()]
        rare = sorted(mine, key=lambda w: (-self.idf[w], w))[:RARE]
        starts, voters = [], []
        for k, w in enumerate(rare):
            s = (np.flatnonzero(ids == w)[:, None] - self.places[t][w][None, :]).ravel()
            starts.append(s)
            voters.append(np.full(len(s), k))
        starts, voters = np.concatenate(starts), np.concatenate(voters)
        order = np.argsort(starts, kind="stable")
        starts, voters = starts[order], voters[order]
        upto = np.searchsorted(starts, starts + loose, side="right")
        out, free = [], -(1 << 60)
        for i, s in enumerate(starts.tolist()):
            if s < free or i and starts[i - 1] == s or len(set(voters[i : upto[i]].tolist())) < min(AGREE, len(rare)):
                continue
            window = ids[max(0, s) : max(0, s + len(c) + loose)]
            share = min(1.0, aligned(c, self.idf[c], window) / self.whole[t])
            if share >= COVER - 1e-9 and all(holds(window, k) for k in self.keys[t]):
                out.append({"label": self.labels[t], "word": max(0, s), "share": share})
                free = s + len(c)
        return out


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, places array<struct<word,phrase>>, found array<struct<label,word,share>>) of every row.

    Words are lower-cased runs of ASCII letters, digits and non-ASCII characters. places are the phrases' starts; found
    are the templates recognised, where they would start and the rarity-weighted share of their words that stands there
    in order. A null or empty text has no words. Repeated rows give repeated results; an empty table gives no rows.
    """
    vocabulary = _vocabulary(templates, phrases)
    coder, index = _Coder(vocabulary), _Index(templates, phrases, vocabulary, rarity(docs, vocabulary, text))
    place = pa.list_(pa.struct([("word", pa.int64()), ("phrase", pa.int32())]))
    match = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("share", pa.float64())]))

    def run(batches):
        for batch in batches:
            for part in C.slices(batch, text):
                ids, first = coder(part.column(text))
                places, found = index.base(ids, first), {}
                for d, t in index.candidates(ids, first):
                    found.setdefault(d, []).extend(index.find(ids[first[d] : first[d + 1]], t))
                listed = [sorted(places.get(d, ()), key=lambda x: (x["word"], x["phrase"])) for d in range(part.num_rows)]
                matched = [sorted(found.get(d, ()), key=lambda x: (x["word"], x["label"])) for d in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(np.diff(first), pa.int64()), pa.array(listed, place), pa.array(matched, match)], names=["doc", "n_words", "places", "found"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias(text))
    return rows.mapInArrow(run, f"doc {kind}, n_words long, places array<struct<word:long,phrase:int>>, found array<struct<label:string,word:long,share:double>>").withColumnRenamed("doc", doc_id)
