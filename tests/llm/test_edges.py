"""Hot keys, long texts, empty tables and clashing columns of the text operators; labels and scores against brute force."""

import base64
import hashlib
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_text_operators import ALNUM, BASE, LICENCE, SECRET, docs, low, rows_of  # noqa: F401
from voxlattice.llm import common as C
from voxlattice.llm import jaccard, licenses, quality, secrets, substring, toxicity, warc


def resolved(pages):
    last = {}
    for p, h in pages:
        last[h or ""] = max(p, last.get(h or "", p))
    for p, h in pages:
        raw = (h or "").encode()
        first = last[h or ""] == p
        yield p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else last[h or ""]


@pytest.mark.parametrize("bound", [400_000, 0])
def test_a_payload_on_half_of_all_pages(spark, monkeypatch, bound):
    monkeypatch.setattr(C, "BROADCAST_ROWS", bound)
    pages = [(i, "<p>the same page</p>" if i % 2 else f"<p>{i // 3}</p>") for i in range(4000)]
    table = spark.createDataFrame(pages, "page_id long, html string").repartition(8)
    assert rows_of(warc.archive(table)) == sorted(resolved(pages), key=repr)
    plan = warc.resolve(table.withColumn("url", F.lit("u")))._jdf.queryExecution().executedPlan().toString()
    if bound:  # headers alone are shuffled, before; payloads stay where they are
        assert "hashpartitioning" not in plan
    else:
        assert not re.search(r"hashpartitioning\(digest#\d+, \d+\)", plan)


def test_salted_join_deals_a_hot_key_out(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("i"))
    counts = C.materialise(rows.groupBy("k").count(), "t")
    joined = C.salted_join(rows, counts.select("k", (F.col("k") * 2).alias("v")), ["k"], counts, 20_000, ["i"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 20_000 and max(sizes) < 2_000 and joined.where("v <> 2 * k").count() == 0


def test_long_pages_go_to_archives_of_bounded_size(spark, tmp_path):
    pages = [(i, chr(97 + i) * (20 << 20)) for i in range(4)] + [(9, "short")]
    table = spark.createDataFrame(pages, "page_id long, html string").coalesce(1)
    assert rows_of(warc.archive(table, f"file://{tmp_path}/w")) == sorted(resolved(pages), key=repr)
    sizes = [os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(f"{tmp_path}/w") for f in files if f.startswith("part-")]
    assert len(sizes) == 3 and max(sizes) < warc.ARCHIVE + (21 << 20)
    first = open(next(os.path.join(d, f) for d, _, files in os.walk(f"{tmp_path}/w") for f in files if f.startswith("part-")), "rb").read(60)
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_pages_with_clashing_columns(spark, tmp_path):
    pages = [(1, "a", "d1", 5, "x"), (2, "a", "d2", 6, "y"), (None, "b", None, None, None), (None, "a", None, None, None)]
    table = spark.createDataFrame(pages, "page_id int, html string, digest string, payload int, record_type string")
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive(table, f"file://{tmp_path}/w").collect()}
    assert got == {(1, "revisit", 2), (2, "response", None), (None, "response", None), (None, "revisit", 2)}


NOTICES = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This work is licensed under CC BY-NC-ND 4.0.",
    "licensed under a Creative Commons Attribution-ShareAlike 3.0 International License",
    "// SPDX-License-Identifier: BSD-3-Clause",
    "# SPDX-License-Identifier: GPL-3.0-or-later",
    "released under the very MIT License",
    "Licensed under the Apache License, Version 2.0 and see https://creativecommons.org/licenses/by-sa/4.0/ too",
    "cc by all rights reserved general public license",
    "the license of the public and the general rights",
    "licensed under cc by sa 4.0 licensed under cc by sa 4.0",
]


def brute_licenses(texts):
    """Every template at every place of every text, without an index."""
    vocabulary = licenses._vocabulary(licenses.TEMPLATES, licenses.PHRASES)
    words = [ALNUM.findall(low(t)) for t in texts]
    df = Counter(w for ws in words for w in set(ws))
    idf = {w: np.log((1 + len(texts)) / (1 + df[w])) for w in vocabulary}
    number = {w: i for i, w in enumerate(vocabulary)}
    code = lambda ws: np.array([number.get(w, -1) for w in ws], np.int32)
    for ws in words:
        ids, labels, best = code(ws), set(), 0.0
        for t in licenses.TEMPLATES:
            c = code(t.words.split())
            weights = np.array([idf[vocabulary[k]] for k in c])
            span = len(c) + licenses.slack(c)
            for s in range(1 - len(c), len(ids)):
                window = ids[max(0, s) : max(0, s + span)]
                share = licenses.aligned(c, weights, window) / max(weights.sum(), 1e-9)
                if share >= licenses.COVER and all(licenses.holds(window, code(p.split())) for p in t.phrases):
                    labels.add(t.label)
                    best = max(best, share)
        base = sorted({label for p, label in licenses.PHRASES if licenses.holds(ids, code(p.split()))})
        yield ",".join(base), ",".join(sorted(labels | set(base))), max(best, 0.5 if base else 0.0)


def test_license_labels_and_scores(spark):
    from voxlattice.llm import queries as q

    texts = [None, "", BASE, SECRET, LICENCE, *NOTICES, *(BASE[:k] + " " + n + " " + BASE[k:] for k, n in enumerate(NOTICES)), *("filler words of a text" for _ in range(30))]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    table.write.mode("overwrite").parquet(path := f"{C.shared_dir(spark)}/licences/documents.parquet")
    got = {r["doc_id"]: r for r in q.op10_license_scan(spark, path.removesuffix("/documents.parquet")).collect()}
    for i, (base, labels, score) in enumerate(brute_licenses(texts)):
        assert (got[i]["base_labels"], got[i]["labels"]) == (base, labels), texts[i]
        assert labels == base or got[i]["score"] >= licenses.COVER - 1e-9
        assert abs(got[i]["score"] - score) < 0.12 and (labels != base or got[i]["score"] == score)
    said = [got[5 + k]["labels"] for k in range(len(NOTICES))]
    assert said[0] == "mit" and "gpl-3.0" in said[2] and "cc-by-nc-nd-4.0" in said[3] and said[4] == "cc-by-sa-3.0" and said[5] == "bsd-3-clause" and "gpl-3.0" in said[6] and said[7] == "mit" and said[8] == "apache-2.0,cc-by-sa-4.0"


def test_pages_of_boilerplate_do_not_meet_each_other(spark):
    common = " ".join(f"menu{i}" for i in range(20))
    table = spark.createDataFrame([(i, f"first{i} {common} last{i}") for i in range(6000)], "doc_id long, text string")
    got = jaccard.jaccard_join(table)
    assert got.where("component_id <> doc_id or n_links <> 0 or n_shingles <> 20").count() == 0 and got.count() == 6000
    entries = spark.createDataFrame([(1, i, 2, 20, i) for i in range(6000)], "tok long, cid long, pos int, n long, component long")
    probes, targets = jaccard._probes(entries, 90, 100), jaccard._targets(entries, 90, 100)
    assert probes.join(targets, ["tok", "band"]).count() == 0  # equal sizes with one shingle each before the shared one


def form_pages(n, seed=1):
    """Pages of one form: 100 words, eight fields of forty values each; hardly any link, every shingle frequent."""
    import random

    rng = random.Random(seed)
    for i in range(n):
        words = [f"t{k}" for k in range(100)]
        for f in range(8):
            words[6 + 12 * f] = f"f{f}v{rng.randrange(40)}"
        yield i, " ".join(words)


def test_pages_of_one_form_give_few_candidates(spark, monkeypatch):
    made, second = [], jaccard._second
    monkeypatch.setattr(jaccard, "_second", lambda *a: (made.append(second(*a).count()), second(*a))[1])
    for n in (500, 2000):
        rows = list(form_pages(n))
        rows += [(n + i, t.replace("t50", f"x{i}")) for i, (_, t) in enumerate(rows[:40])]  # one word in a hundred changed: linked
        got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert all(got[n + i] == got[i] for i in range(40)) and len(set(got.values())) > 0.95 * n
    assert made[1] < 400  # equal fields by chance, not pairs of pages


def test_parity_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(200):
        base = rng.integers(0, 1 << 63, 300, dtype=np.int64).astype(np.uint64)
        a, b = np.unique(base[: rng.integers(1, 300)]), np.unique(base[rng.integers(0, 200) :])
        apart = sum(int(x).bit_count() for x in (jaccard._parity(a) ^ jaccard._parity(b)).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b))


def test_tables_are_discarded_only_where_they_were_written(spark, tmp_path):
    kept = C.materialise(spark.range(5), "t")
    folder = kept.inputFiles()[0].rpartition("/")[0].removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(folder)
    C.discard(kept)
    assert not os.path.isdir(folder)
    spark.range(3).write.parquet(f"file://{tmp_path}/x")
    assert [C._place(u) for u in ("file:///a/b", "file:/a/b", "hdfs://host:8020/a/b", "hdfs:///a/b", "/a/b")] == ["/a/b"] * 5
    with pytest.raises(ValueError):
        C.discard(spark.read.parquet(f"file://{tmp_path}/x"))


def test_bands_lose_no_link(spark):
    sizes = spark.createDataFrame([(1, n, 0, n) for n in range(1, 3000, 7)], "tok long, cid long, pos int, n long")
    for num in (80, 90):
        met = jaccard._probes(sizes, num, 100).alias("x").join(jaccard._targets(sizes, num, 100).alias("y"), ["tok", "band"])
        met = {(r[0], r[1]) for r in met.select("x.n", "y.n").collect()}
        assert all((a, b) in met for a in range(1, 3000, 7) for b in range(1, a + 1, 7) if 100 * b >= num * a)


def test_a_passage_in_every_document(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"own{i} {passage} tail{i}") for i in range(1500)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = {r["doc_id"]: r["kept_text"] for r in got.collect()}
    assert kept[0] == rows[0][1] and all(kept[i] == f"own{i} tail{i}" for i in range(1, 1500))


def test_toxicity_of_awkward_texts(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(15)] + [(3, None, None), (None, 1, True)], "doc_id long, toxic int, lang boolean")
    for table in (docs, docs.union(docs)):
        first, again = rows_of(toxicity.score(table, labels)), rows_of(toxicity.score(table.repartition(5), labels.repartition(3)))
        assert len(first) == table.count() and all(0 <= r[2] <= 1 and r[3] == int(r[2] >= 0.3) for r in first)
        assert [(r[0], r[1], round(r[2], 9), r[3]) for r in first] == [(r[0], r[1], round(r[2], 9), r[3]) for r in again]
    assert toxicity.score(docs.limit(0), labels).count() == 0
    none = toxicity.score(docs, labels.limit(0)).select("score").distinct().collect()
    assert len(none) == 1 and 0 <= none[0]["score"] <= 1


def test_scores_do_not_depend_on_the_order_of_rows(spark):
    from voxlattice.llm import queries as q

    d, y = (q.read(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    one = {r["doc_id"]: r["score"] for r in toxicity.score(d, y).collect()}
    two = {r["doc_id"]: r["score"] for r in toxicity.score(d.repartition(7, "n_chars"), y.orderBy(F.desc("doc_id"))).collect()}
    assert one.keys() == two.keys() and max(abs(one[k] - two[k]) for k in one) < 1e-9


def test_rows_of_letters_are_read_whole(spark):
    import pyarrow as pa

    model = toxicity.language_model(spark.createDataFrame([("you idiot and stupid idea of an idiom " * 50,)], "text string"))
    word = int(C.hash_words(*C.text_buffers(pa.array(["idiot"])), toxicity.WORDS)[2][0])
    doc, words, _ = toxicity.Reader(model)(pa.array([" ".join("youidiot" * 100), " ".join("idiot")]))
    assert word in words[doc == 0].tolist() and word in words[doc == 1].tolist()


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert secrets.scan(none).count() == 0 and secrets.redact(none).columns == docs.columns
    assert quality.score(none).count() == 0 and quality.keep(none).count() == 0
