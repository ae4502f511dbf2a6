"""The pipeline's stages against brute force, on the smallest tables and on awkward rows."""

import re
import zlib

import pytest
from test_text_operators import BASE, SECRET, brute_components, brute_contamination, docs  # noqa: F401

import corpus_pipeline
from voxlattice.llm import quality, secrets
from voxlattice.llm import queries as q
from voxlattice.llm.common import materialise, read


def redacted(text):
    """Secrets found rule by rule, overlapping ones as one, each replaced by the mark."""
    found = sorted((m.start(), m.end()) for r in secrets.RULES for m in re.finditer(r.pattern, text or "") if len(m[r.group]) >= r.least)
    out, at = [], 0
    for a, b in found:
        if a >= at:
            out += [text[at:a], secrets.MARK]
        at = max(at, b)
    return None if text is None else "".join(out) + text[at:]


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")


def check(spark, sf, docs):  # noqa: F811
    """Each stage on its own input."""
    steps = dict(corpus_pipeline.STAGES)
    benchmark = [(str(r["item_id"]), r["text"]) for r in read(spark, sf, "benchmark").collect()]
    good = materialise(steps["quality_rules"](spark, docs, sf), "t")
    kept = sorted(r["doc_id"] or -1 for r in quality.score(docs).collect() if r["kept"])
    assert sorted(r["doc_id"] or -1 for r in good.collect()) == kept and good.columns == docs.columns

    once = materialise(steps["near_copies"](spark, good, sf), "t")
    rows = sorted(good.collect(), key=key)
    named = brute_components([(r["doc_id"], r["text"]) for r in rows], 5, 80, 100)
    assert sorted(once.collect(), key=key) == [r for r, (d, _, c) in zip(rows, named) if d == c] and once.columns == docs.columns

    clean = materialise(steps["decontamination"](spark, once, sf), "t")
    rows = sorted(once.collect(), key=key)
    bad = [b[4] for b in brute_contamination([r["text"] for r in rows], benchmark)]
    assert sorted(clean.collect(), key=key) == [r for r, b in zip(rows, bad) if not b] and clean.columns == docs.columns

    safe = materialise(steps["secret_redaction"](spark, clean, sf), "t")
    want = [r.asDict() | {"text": redacted(r["text"]), "n_chars": r["n_chars"] if redacted(r["text"]) == r["text"] else len(redacted(r["text"]))} for r in sorted(clean.collect(), key=key)]
    assert sorted((r.asDict() for r in safe.collect()), key=key) == sorted(want, key=key) and safe.columns == docs.columns

    packed = steps["best_fit_packing"](spark, safe, sf).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(q.tokenizer())
    pieces = []
    for r in safe.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % q.CAPACITY + 1
        cuts = [0, *range(first, len(ids) + 1, q.CAPACITY)]
        pieces += [(r["doc_id"], k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed), key=repr) == sorted(pieces, key=repr)
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= q.CAPACITY
    assert len(bins) >= -(-sum(p[3] for p in pieces) // q.CAPACITY)
    return len(packed)


def test_stages(spark, sf):
    assert check(spark, sf, read(spark, sf, "documents")) > 0


@pytest.fixture(scope="module")
def awkward(spark, docs, sf):  # noqa: F811
    """Nulls in every column, repeated rows, ties, clashing columns, and texts that pass the quality rules to meet the later stages."""
    passage = read(spark, sf, "benchmark").first()["text"]
    own = lambda k: " ".join(f"{k}word{i} {k}thing{i} the" for i in range(40))
    rows = [(50, own("a"), None, None, None, None, None, None), (50, own("a"), None, None, None, None, None, None), (51, own("a"), "en", "s", 7, 1, "h", "row"), (None, own("a"), "en", "s", 7, 1, "h", "row"), (None, own("b"), "en", "s", 7, 1, "h", "row"), (52, own("c") + " " + SECRET + " " + own("d"), "en", "s", 7, 1, "h", "row"), (53, passage + " " + own("p"), "en", "s", None, 1, "h", "row"), (53, own("e"), "en", "s", 7, 1, "h", "row")]
    return docs.union(spark.createDataFrame(rows, docs.schema))


def test_stages_on_awkward_rows(spark, sf, awkward):
    assert check(spark, sf, awkward) >= 5  # among them: a repeated row kept twice, a null id, a redacted text


def test_stages_on_an_empty_table(spark, sf, docs):  # noqa: F811
    assert check(spark, sf, docs.limit(0)) == 0
