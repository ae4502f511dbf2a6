"""Text operators on cases that used to be left out."""

import random

import duckdb

from voxlattice.llm import decontam
from voxlattice.llm.oracles import ORACLES


def test_items_without_an_id_are_hit(spark, monkeypatch):
    line = " ".join(f"w{i}" for i in range(40))
    items = [(None, line), ("b", "two words"), (None, "two words"), (None, None), ("None", "other item")]
    docs = [(1, line), (2, "some two words here"), (3, "clean"), (4, None), (5, line + " other item")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    want = {r[0]: r[1:] for r in con.execute(ORACLES["op3_decontamination"]).fetchall()}
    for words in (decontam.BLOCK_WORDS, 20):
        monkeypatch.setattr(decontam, "BLOCK_WORDS", words)
        got = {r[0]: tuple(r)[1:] for r in decontam.contamination(d, b).drop("spans").collect()}
        assert {k: v for k, v in got.items() if k != 4} == {k: v for k, v in want.items() if k != 4}
        assert got[1][1] == 40 and got[1][2] == 0 and got[1][4] and got[2][2] == 1 and got[4][1] == 0
    assert [r["doc_id"] for r in decontam.drop_contaminated(d, b).orderBy("doc_id").collect()] == [3, 4]


def test_long_and_doubled_tokens_are_read(spark):
    import numpy as np
    import pyarrow as pa

    from voxlattice.llm import common as C
    from voxlattice.llm import toxicity

    plain = spark.createDataFrame([("you idiot and stupid idea of a tidy idiom " * 50,)], "text string")
    reader = toxicity.Reader(toxicity.language_model(plain))
    texts = ["idiot" + "!" * 36, "st" + "u" * 40 + "pid", "iiddiioott", "idiot" + "!" * 36 + "stupid" + "!" * 36 + "idiot", None]
    doc, words, n = reader(pa.array(texts, pa.string()))
    idiot, stupid = (int(C.hash_words(*C.text_buffers(pa.array([w])), toxicity.WORDS)[2][0]) for w in ("idiot", "stupid"))
    said = [set(words[doc == i].tolist()) for i in range(len(texts))]
    assert idiot in said[0] and stupid in said[1] and idiot in said[2] and {idiot, stupid} <= said[3] and n.tolist() == [1, 1, 1, 1, 0]
    assert len("".join(toxicity.decode("a1" * 5_000, reader.model))) > 0 and np.isfinite(reader.model).all()


def test_a_slur_in_few_toxic_rows_has_weight(spark):
    import pyarrow as pa

    from voxlattice.llm import common as C
    from voxlattice.llm import toxicity

    rng = random.Random(1)
    names = ["".join(rng.choices("abcdefghijklmnoprstu", k=6)) for _ in range(2000)]
    say = lambda i: " ".join(rng.choices(names, k=12))
    toxic = lambda i: " you idiot" if i % 50 else " you zmurk"  # noqa: E731  (zmurk: 2 % of the toxic rows)
    rows = [(i, say(i) + (toxic(i // 4) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    words, weights, _ = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), toxicity.language_model(df))
    zmurk, idiot = (int(C.hash_words(*C.text_buffers(pa.array([w])), toxicity.WORDS)[2][0]) for w in ("zmurk", "idiot"))
    assert zmurk in words.tolist() and idiot in words.tolist() and len(words) <= 8  # these, "you" and their beginnings, and hardly a word by chance


def readings(token):
    """Every way to read a token, with the cost of each sign's choice."""
    from itertools import product

    from voxlattice.llm import toxicity

    for ways in product(*toxicity._lattice(token)):
        yield "".join(w for w, _ in ways), sum(c for _, c in ways)


def test_viterbi_finds_the_best_of_all_readings(spark):
    from voxlattice.llm import toxicity

    plain = spark.createDataFrame([("you idiot and stupid idea of a tidy idiom is a loser of the trash too good to see " * 50,)], "text string")
    flat = toxicity.language_model(plain).ravel().tolist()

    def likely(text, cost):
        state, total = 0, cost
        for ch in text + " ":
            k = toxicity._AT.get(ch, 27)
            if k or state % toxicity.SYMBOLS:
                state = state * toxicity.SYMBOLS + k
                total += flat[state]
                state %= toxicity._STATES
        return total

    rng = random.Random(6)
    tokens = ["1d10t", "stup!d", "l00ser", "t r a 5 h", "$7up1d", "iiddiioott", "g00d", "a 1 d"] + ["".join(rng.choices("aidotsu10!$ ", k=rng.randint(2, 7))).strip() for _ in range(60)]
    for token in filter(None, tokens):
        best = max(likely(t, c) for t, c in readings(token))
        said = toxicity.decode(token, flat)
        assert max(likely(t, c) for t, c in readings(token) if t.split() == said) >= best - 1e-6, token


def test_beginnings_of_words():
    import numpy as np
    import pyarrow as pa

    from voxlattice.llm import common as C
    from voxlattice.llm import toxicity

    def stems(words):
        data, offsets = C.text_buffers(pa.array([" ".join(words)]))
        starts, sizes, _, _ = C.hash_words(data, offsets, toxicity.WORDS)
        return toxicity._stems(data, starts, sizes)

    words = ["réeuxpa", "RÉEUXvi".replace("É", "é"), "réeu", "réeux", "abcdefghij", "abcdefzzzz", "abcdzz", "ñ" * 9, "a"]
    at, hashes = stems(words)
    got = {}
    for w, h in zip(at.tolist(), hashes.tolist()):
        got.setdefault(w, set()).add(h)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            shared = {a.lower()[:k] for k in toxicity.STEMS if len(a) > k} & {b.lower()[:k] for k in toxicity.STEMS if len(b) > k}
            assert len(got.get(i, set()) & got.get(j, set())) == len(shared)
    assert len(stems([])[0]) == 0 and np.array_equal(stems(words)[1], hashes)


def test_stems_of_other_languages_are_found(spark):
    """Toxic rows hold many forms of one stem, none of them often; rows that hold the stem once by chance are clean."""
    from voxlattice.llm import toxicity

    rng = random.Random(3)
    syllables = ["ba", "ke", "li", "mo", "nu", "ta", "re", "so"]
    word = lambda: "".join(rng.choices(syllables, k=4))
    rows = []
    for i in range(1500):
        w = [word() for _ in range(60)]
        if i % 6 == 0:
            w[5:45:10] = ["zrukó" + word() for _ in range(4)]
        elif i % 7 == 0:
            w[3] = "zrukó" + word()
        rows.append((i, " ".join(w), int(i % 6 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.score(df.select("doc_id", "text"), df.select("doc_id", "toxic")).where("held_out").join(df.select("doc_id", "toxic"), "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in out) >= 0.98 * len(out) and len(out) > 200


def test_held_out_recall_and_precision(spark):
    from voxlattice.llm import queries as q
    from voxlattice.llm import toxicity

    d, y = (q.read(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    out = toxicity.score(d, y).where("held_out").join(y.select("doc_id", "toxic"), "doc_id").collect()
    right = sum(r["predicted"] and r["toxic"] for r in out)
    assert right >= 0.9 * sum(r["toxic"] for r in out) and right >= 0.9 * sum(r["predicted"] for r in out)
