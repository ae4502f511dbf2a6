"""Filter audit, token counts and the prefix trie against brute force, on awkward rows and on hot keys."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import BASE, docs, rows_of  # noqa: F401

from voxlattice.llm import audit, tokens, trie
from voxlattice.llm import common as C
from voxlattice.llm import queries as q

# ---- filter audit ----


def brute_audit(rows, labels):
    """rows (doc_id, text, source); labels (doc_id, quality, toxic)."""
    least, good, bad = {}, {d for d, x, _ in labels if x == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    parts = {}
    for d, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(k for k, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search("[#$%&*|]", t), d is not None and least[t] < d)) if x)
        parts.setdefault(s or "", []).append((fails, d in good, d in bad))
    for part, each in parts.items():
        out, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = each
            for k, f in enumerate(order):
                gone, left = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                out.append((part, order, k + 1, len(left), len(gone), sum(f in x[0] for x in each) - len(gone), sum(x[0] == f for x in each), sum(x[1] for x in gone), sum(x[2] for x in gone)))
        yield from ((*r, shapley[r[1][r[2] - 1]]) for r in out)


def test_orders_are_adjacent_swaps():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5):
        weights = rng.integers(0, 4, (1 << n, 3))
        diagram, seen = audit.Diagram(weights, n), []
        for order in diagram.orders():
            assert not seen or sum(a != b for a, b in zip(seen[-1], order)) == 2
            seen.append(tuple(order))
            node = diagram.root
            for level, f in enumerate(order):  # every path still leads to its own counts
                assert diagram.levels[level][node.lo, node.hi] is node
                node = node.lo
            for mask in range(1 << n):
                node = diagram.root
                for f in order:
                    node = node.hi if mask >> f & 1 else node.lo
                assert node.weight == weights[mask].tolist()
        assert sorted(seen) == sorted(permutations(range(n)))


def test_equal_nodes_are_one():
    diagram = audit.Diagram(np.ones((32, 3), int), 5)
    assert [len(x) for x in diagram.levels] == [1] * 5
    for _ in diagram.orders():
        assert [len(x) for x in diagram.levels] == [1] * 5


@pytest.mark.parametrize("bound", [400_000, 0])
def test_audit(spark, docs, monkeypatch, bound):  # noqa: F811
    monkeypatch.setattr(C, "BROADCAST_ROWS", bound)
    long = " ".join(f"w{i}" for i in range(250))
    more = [(100 + i, [long, long + "!", "A B # " + long, None, "", " \n"][i % 6], None, ["x", "", None][i % 3], None, i, "h", "row") for i in range(40)]
    more += [(None, long, "en", "x", 1, 1, "h", "row")] * 60 + [(100, long, "en", "y", 1, 1, "h", "row")] * 3
    table = docs.union(spark.createDataFrame(more, docs.schema)).withColumnRenamed("h", "mask").withColumnRenamed("row", "digest")
    marks = [(i, i % 2, i % 3 % 2, "z") for i in range(130)] + [(100, 1, None, "z"), (None, 1, 1, "z"), (101, None, None, "z")]
    labels = spark.createDataFrame(marks, "doc_id int, quality int, toxic int, source string")
    want = list(brute_audit([(r["doc_id"], r["text"], r["source"]) for r in table.collect()], [m[:3] for m in marks]))
    assert rows_of(audit.audit(table, labels)) == sorted(want, key=repr) and len(want) == 4 * 600
    assert audit.audit(table.limit(0), labels).count() == 0
    none = {tuple(r) for r in audit.audit(table, labels.limit(0)).select("good_lost", "toxic_lost").distinct().collect()}
    assert none == {(0, 0)}


def test_audit_of_a_hot_text_and_a_hot_id(spark, monkeypatch):
    monkeypatch.setattr(C, "BROADCAST_ROWS", 0)
    rows = [(i if i % 3 else 7, "the same text" if i % 2 else f"text {i}", f"s{i % 4}") for i in range(3000)]
    marks = [(i, 1, 0) for i in range(0, 3000, 7)]
    got = audit.audit(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert rows_of(got) == sorted(brute_audit(rows, marks), key=repr)


# ---- token counts ----


@pytest.fixture(scope="module")
def model():
    return q.tokenizer("piece_bpe_32k.model")


def awkward_texts():
    rng = random.Random(5)
    mixed = lambda n: "".join(rng.choice(["a", "e", "th", " ", "  ", "ing ", "\n", "é", "中文", "\x00", "😀", "▁", "<s>", "<0x0A>", "xx", "9", "ﬁ", "é"]) for _ in range(n))
    return [None, "", " ", "▁", "word", "a" * 700, "ab" * 900, " " * 600, "=" * 500 + " " + "-" * 500, "中" * 400, "😀" * 300, mixed(300), mixed(900), mixed(2000), BASE, "the " * 400, "\n" * 300, "aaaaaaab" * 200]


@pytest.mark.parametrize("chunk,overlap", [(16_384, 256), (40, 8), (17, 3), (300, 20)])
def test_token_counts(spark, model, chunk, overlap):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = [(i if i % 7 else None, t, i) for i, t in enumerate(awkward_texts() + awkward_texts()[-3:])]
    got = tokens.count_tokens(spark.createDataFrame(rows, "doc_id int, text string, k int"), model, chunk, overlap)
    assert rows_of(got) == sorted(((d, len((t or "").encode()), len(sp.encode(t or ""))) for d, t, _ in rows), key=repr)


def test_a_splice_needs_a_common_token(model):
    pieces, rng = tokens.Pieces(model), random.Random(9)
    found = 0
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", "ab", "the", " ", "é", "😀", "中", "==", "\n"]) for _ in range(rng.randint(20, 90)))
        a, b = sorted(rng.sample(range(1, len(text)), 2))
        n, at, ids, before = pieces.tokens(text[:b])
        right = pieces.tokens(text[a:])
        met = tokens.splice((at, ids, before), (right[1] + a, *right[2:]))
        if met:
            found += 1
            assert met[0] + right[0] - met[1] == pieces.counts([text])[0]
    assert found > 300


def test_chunks_cover_a_text():
    for length in (1, 5, 9, 10, 11, 40, 41, 99, 100):
        at = list(tokens.starts(length, 10, 4))
        assert at == list(range(0, 10 * len(at), 10)) and at[-1] < max(length - 4, 1) and length <= at[-1] + 14


def test_a_text_without_agreement_is_widened(spark, model, monkeypatch):
    rounds = []
    spliced = tokens._spliced
    monkeypatch.setattr(tokens, "_spliced", lambda rows, m, c, o: (rounds.append((c, o)), spliced(rows, m, c, o))[1])
    rows = [(1, "a" * 5000), (2, BASE)]
    got = {r[0]: r[2] for r in tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), model, 50, 1).collect()}
    assert rounds[:2] == [(50, 1), (200, 4)] and got == {d: tokens.Pieces(model).counts([t])[0] for d, t in rows}


def test_token_counts_of_no_rows(spark, model, docs):  # noqa: F811
    assert tokens.count_tokens(docs.limit(0), model).count() == 0
    assert tokens.count_tokens(docs, model).count() == docs.count()


# ---- prefix trie ----


def brute_rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0, role or ""), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts, key=lambda t: t[0])] for c, ts in own.items()}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        yield c, own.get(base, [])[:h] + ts[h:]


def brute_trie(sequences):
    members = {}
    for c, seq in sequences:
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append((c, len(seq) == d))
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, ())) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, ())) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    for p, m in members.items():
        ends = ",".join(str(c) for c, e in sorted(m) if e)
        yield min(c for c, _ in m), len(p), min(c for c, _ in members[p[:-1]]) if p else None, len(m), len(kids.get(p, ())), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()


def conversations(rng, n, longest, words=("yes", "no", "ünd", None, "")):
    for c in range(n):
        for turn in range(rng.randint(1, longest)):
            yield c - 6, turn if turn else None, rng.choice(["user", "assistant", None]) if rng.random() < 0.3 else "user", rng.choice(words)


def check_trie(spark, rows, extra=0):
    table = spark.createDataFrame([(*r, i, "n") for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string, token long, length string").repartition(5)
    got = q.trie.prefix_trie(*trie.rebuild(trie.turns_in_order(table)))
    assert rows_of(got) == sorted(brute_trie(list(brute_rebuilt(rows))), key=repr)
    return got


def test_prefix_trie(spark, monkeypatch):
    rng = random.Random(2)
    rows = list(conversations(rng, 60, 12)) + [(None, 1, "user", "lost")] * 3 + [(500, k, "user", "same") for k in range(3)] * 2
    rows += [(c, k, "user", f"t{k}") for c in range(1000, 1040) for k in range(7)]  # copies
    check_trie(spark, rows)
    monkeypatch.setattr(trie, "PAGE_BITS", 1)
    monkeypatch.setattr(trie, "PAGE", 2)
    check_trie(spark, rows)
    monkeypatch.setattr(trie, "PAGE_BITS", 2)
    monkeypatch.setattr(trie, "PAGE", 4)
    check_trie(spark, rows)


def test_one_long_conversation_and_very_long_texts(spark):
    rows = [(5, k, "user", "x" * 200_000 if k == 3 else f"w{k % 4}") for k in range(700)] + [(6, k, "user", f"w{k % 4}") for k in range(300)] + [(7, 0, "user", None)]
    check_trie(spark, rows)


def test_turnless_and_empty(spark):
    assert check_trie(spark, []).count() == 0
    lost = next(c for c in range(1, 5) if zlib.crc32(str(c).encode()) % 9 > 1)  # its only turn is dropped and there is no conversation 0
    assert check_trie(spark, [(lost, 0, "user", "dropped")]).count() == 1


def test_a_conversation_is_ordered_by_many_tasks(spark):
    rows = [(1, k, "user", str(k)) for k in range(5000)] + [(2, k, "user", str(k)) for k in range(3)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(9)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = trie.turns_in_order(table)
        assert {r["at"]: r["bytes"] for r in got.where("conv = 1").collect()} == {k: len(str(k)) for k in range(5000)}
        parts = got.where("conv = 1").groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert parts > 1
