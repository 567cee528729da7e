"""Operators with work in Python tasks, against brute force, exact round trips and held-out labels."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from llm_brute import near_groups
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilgauge.llm import backoff, boosting, common, jaccard, licences, packing, pieces, pivots

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCRAPS = ["a", "b", "ab", "aa", "The", "in", " ", "  ", "\n", "\t", "▁", "é", "ß", "ﬁ", "　", "\x00", "\x1c", "\x85", "<s>", "<0x0A>", "😀", "中",
          "ing", "\r", "0", "000", "==", "....", "é", "́", "İ", "Σ", "'s", ".", ",", "!", "<|endoftext|>", "ª", "½"]


def scraps(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(SCRAPS) for _ in range(rng.randint(1, 40))) for _ in range(n)]


# components ------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(60)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_components_of_no_links(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# stupid backoff --------------------------------------------------------------

def backoff_by_hand(rows, order, alpha, leave_out):
    texts = [(t or "").encode().split() for _, t in rows]
    grams = lambda ws: Counter(tuple(ws[i:i + n]) for n in range(1, order + 1) for i in range(len(ws) - n + 1))
    every = sum((grams(t) for t in texts), Counter())
    words = sum(map(len, texts))
    out = []
    for (doc, _), ws in zip(rows, texts, strict=True):
        own = grams(ws) if leave_out else Counter()
        total = 0.0
        for i in range(len(ws)):
            weight = 1.0
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(ws[i - n + 1:i + 1])
                count = every[gram] - own[gram]
                if n == 1:
                    total += math.log(weight * max(count, 1) / max(words - (len(ws) if leave_out else 0), 1))
                elif count > 0:
                    total += math.log(weight * count / (every[gram[:-1]] - own[gram[:-1]]))
                    break
                weight *= alpha
        out.append((doc, len(ws), round(total, 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("order, leave_out", [(3, True), (2, False), (1, True), (4, True)])
def test_backoff_equals_brute_force(spark, odd_documents, order, leave_out):
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 40)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for frame, block in ((docs, 300), (docs, 10**6), (odd_documents, 1000)):
        got = backoff.score_documents(frame, order, leave_out=leave_out, block_bytes=block).collect()
        want = backoff_by_hand([(r.doc_id, r.text) for r in frame.collect()], order, 0.4, leave_out)
        assert [x[:2] for x in want] == [x[:2] for x in sorted(((r.doc_id, r.n_words, round(r.log_score, 6)) for r in got), key=repr)]
        assert sorted(x[2] for x in want) == pytest.approx(sorted(r.log_score for r in got), abs=2e-5)


def test_backoff_of_no_documents(no_documents):
    assert backoff.score_documents(no_documents).count() == 0


def test_packed_hashes_round_trip():
    rng = np.random.default_rng(0)
    for n, top in ((1, 2**60), (2, 2**60), (5000, 2**60), (100, 200)):
        values = np.unique(rng.integers(0, top, n).astype(np.uint64))
        assert (backoff.unpacked(backoff.packed(values), len(values)) == values).all()


# pivot index -----------------------------------------------------------------

def test_near_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 40)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 32))
    x[100:300] = x[0] + rng.normal(size=(200, 32)) * 0.15
    x[300:330] = x[1]
    x[330:400] = x[rng.integers(0, 100, 70)] * 3 + rng.normal(size=(70, 32)) * 0.2
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 32), (1003, [math.nan] * 32), (1004, [None] * 32), (1005, [1.0, 2.0]), (1006, [2.0, 4.1]),
           (3, x[3].tolist()), (1007, [1e308] * 32), (1008, [-1e308] * 32)]
    frame = spark.createDataFrame([(*r, "extra") for r in rows + odd], "vec_id long, embedding array<double>, component string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in pivots.near_vectors(frame, per_pivot=8).collect())
    every = rows + odd[5:]
    links, parent = Counter(), list(range(len(every)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(every):
        for j in range(i):
            b = every[j][1]
            if len(a) == len(b):
                u, v = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
                if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.95:
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (k, _) in enumerate(every):
        groups[find(i)].append(k)
    want = [(k, links[i], min(groups[find(i)]), k == min(groups[find(i)])) for i, (k, _) in enumerate(every)]
    want = sorted(want + [(k, 0, k, True) for k, _ in odd[:5]])
    found, all_links = sum(g[1] for g in got), sum(w[1] for w in want)
    assert [g[0] for g in got] == [w[0] for w in want] and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert found >= 0.98 * all_links and sum(g[2] == w[2] for g, w in zip(got, want, strict=True)) >= 0.99 * len(want)
    assert pivots.near_vectors(frame.limit(0)).count() == 0


def test_links_in_a_dense_group_are_found(spark):
    """20,000 distinct vectors round one centre (cosine about 0.975 to each other), and even noise."""
    rng = np.random.default_rng(5)
    near = rng.normal(size=(20_000, 64))
    near *= 0.16 / np.linalg.norm(near, axis=1)[:, None]
    near[:, 0] += 1
    near[10_000:] = near[:10_000] + rng.normal(size=(10_000, 64)) * 0.025
    x = np.concatenate([near, rng.normal(size=(3000, 64))])
    units = x / np.linalg.norm(x, axis=1)[:, None]
    want = np.concatenate([(part @ units.T >= 0.95).sum(axis=1) for part in np.array_split(units, 40)]) - 1
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}), "vec_id long, embedding array<double>")
    got = pivots.near_vectors(frame.repartition(16)).select("vec_id", "n_links").toPandas().set_index("vec_id")["n_links"].reindex(np.arange(len(x)))
    assert (got.to_numpy() <= want).all() and got.sum() >= 0.99 * want.sum()


# classifier ------------------------------------------------------------------

def test_forest_learns_and_walks_like_a_loop():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 1)).astype(float)
    forest = boosting.fit(x[:2000], y[:2000], trees=80)
    assert ((forest.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    for row in x[:20]:
        total = forest.base
        for t in range(len(forest.leaf)):
            node = 0
            while node < forest.feature.shape[1]:
                node = 2 * node + 1 + (row[forest.feature[t, node]] > forest.cut[t, node])
            total += forest.leaf[t, node - forest.feature.shape[1]]
        assert forest.score(row[None])[0] == pytest.approx(1 / (1 + math.exp(-total)))
    assert boosting.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert (boosting.fit(x, np.ones(len(x))).score(x[:2]) > 0.99).all()


def test_held_out_accuracy_and_determinism(spark, folder):
    from veilgauge.llm.registry import op3_boosted_quality, table

    folder = folder.replace("sf0.001", "sf0.01")  # more labels
    rows = op3_boosted_quality(spark, folder).collect()
    labels = {r.doc_id: r.quality for r in table(spark, folder, "labels").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == q for p, q in judged) / len(judged) > 0.94
    again = op3_boosted_quality(spark, folder).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_labels_of_held_out_rows_do_not_matter(spark, folder):
    from veilgauge.llm.registry import table

    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    turned = labels.withColumn("quality", F.when(boosting.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, boosting.classify(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_classifier_on_odd_and_empty_tables(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (5, None), (6, 7), (99, 1), (None, 1)], "doc_id long, quality int")
    rows = boosting.classify(odd_documents, labels).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert boosting.classify(odd_documents, labels.limit(0)).count() == 11 and boosting.classify(no_documents, labels).count() == 0
    assert boosting.keep_predicted(odd_documents, labels).columns == odd_documents.columns


# licences --------------------------------------------------------------------

def test_licences_are_found_and_inherited(spark):
    files = [("LICENSE", "Released under the MIT License."), ("a/x.py", "code"), ("a/b/COPYING", "Licensed under the Apache License, Version 2.0."),
             ("a/b/c/d.py", "words\nand words"), ("a/b/own.py", "code of several parts. This work is licensed under the GNU General Public License, version 3. " + "more code " * 20),
             ("a/b2/e.py", None), ("z/copy.txt", "Licensed under CC BY-NC 4.0."), ("z/y/f", ""), ("z/licensed words.txt", "the license of the work is here"),
             (None, "Released under the MIT License."), (None, "plain"), ("a/x.py", "code")]
    rows = licences.scan(spark.createDataFrame([(i, p, t, "q") for i, (p, t) in enumerate(files)], "id int, path string, text string, origin string"))
    got = {r.id: (r.licence, r.origin, r.from_path) for r in rows.collect()}
    assert got == {
        0: ("MIT", "file", None), 1: ("MIT", "inherited", "LICENSE"), 2: ("Apache-2.0", "file", None),
        3: ("Apache-2.0", "inherited", "a/b/COPYING"), 4: ("GPL-3.0", "header", None), 5: ("MIT", "inherited", "LICENSE"),
        6: ("CC-BY-NC-4.0", "file", None), 7: ("CC-BY-NC-4.0", "inherited", "z/copy.txt"), 8: ("CC-BY-NC-4.0", "inherited", "z/copy.txt"),
        9: ("MIT", "file", None), 10: (None, "none", None), 11: ("MIT", "inherited", "LICENSE")}
    assert licences.scan(rows.limit(0).select("path", F.lit("").alias("text"))).count() == 0


def test_core_words_lose_no_match():
    rng = random.Random(0)
    vocabulary = sorted({w for notices in licences.TEMPLATES.values() for n in notices for w in licences.terms(n)})
    weights = licences.Weights(1000, {w: rng.randint(0, 1000) for w in vocabulary}, 0.6)
    everything = licences.Weights(1000, weights.idf, 0.6)
    everything.__dict__.update(weights.__dict__, core=set(vocabulary))
    for _ in range(3000):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 8))]
        assert weights.best(words) == everything.best(words)


HEADERS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

1. Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software
without specific prior written permission.""",
}


def weights_of_code():
    """As over 10,000 files, where few words of the templates are common."""
    vocabulary = {w for notices in licences.TEMPLATES.values() for n in notices for w in licences.terms(n)}
    common = {"the": 9000, "of": 8500, "and": 8500, "to": 8500, "in": 8000, "a": 8000, "is": 7000, "this": 6000, "or": 5000, "be": 5000}
    return licences.Weights(10_000, {w: common.get(w, 300) for w in vocabulary}, licences.THRESHOLD)


def as_file(header, prefix=""):
    code = [f"value_{i} = other_{i} + {i}" for i in range(300)]
    return "\n".join([*code[:20], "", *(prefix + line for line in header.split("\n")), "", *code[20:]])


@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// "])
@pytest.mark.parametrize("licence", sorted(HEADERS))
def test_wrapped_headers_in_long_files(licence, prefix):
    header, whole = weights_of_code().scan(as_file(HEADERS[licence], prefix))
    assert whole is None and header is not None and header[1] == licence


GNU = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU {1}General Public License as published by
the Free Software Foundation{0} either version {2} of the License, or
(at your option) any later version."""
NEIGHBOURS = [
    ("GPL-2.0", GNU.format(";", "", "2")), ("LGPL-2.1", GNU.format(";", "Lesser ", "2.1")), ("LGPL-3.0", GNU.format(":", "Lesser ", "3")),
    ("AGPL-3.0", GNU.format(":", "Affero ", "3")), ("BSD-2-Clause", HEADERS["BSD-3-Clause"].split("\n3.")[0]),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""),
    *[(name.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {name}") for name in (
        "MIT", "ISC", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
        "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0")],
    *[(None, f"SPDX-License-Identifier: {name}") for name in ("BSD-4-Clause", "Apache-1.1", "MPL-1.1", "GPL-1.0-only")],
    (None, GNU.format(";", "", "1")), (None, "Licensed under CC BY-SA 3.0."), (None, "Licensed under CC BY-NC-ND 4.0."),
]


@pytest.mark.parametrize("licence, header", NEIGHBOURS)
def test_neighbouring_versions(licence, header):
    found, _ = weights_of_code().scan(as_file(header, "# "))
    assert (found and found[1]) == licence


def test_every_template_holds_its_telling_terms():
    weights = weights_of_code()
    assert [(t, weights.best(licences.terms(n))[1]) for t, notices in licences.TEMPLATES.items() for n in notices] == [
        (t, t) for t, notices in licences.TEMPLATES.items() for _ in notices]


def test_blocks_lose_no_match():
    weights, rng = weights_of_code(), random.Random(3)
    lines = [line for h in HEADERS.values() for line in h.split("\n") if line] + ["x = 1", "the code is here", "licensed under the"]
    for _ in range(60):
        units = [u for _ in range(rng.randint(2, 12)) if (u := licences.terms(rng.choice(lines)))]
        every = [sum(units[a:b], []) for a in range(len(units)) for b in range(a + 2, len(units) + 1)]
        best = lambda blocks: max((m[0] for b in blocks if (m := weights.best(b))), default=0)
        assert best([*units, *(sum(units[a:b], []) for a, b in weights.blocks(units))]) == pytest.approx(best([*units, *(b for b in every if len(b) <= weights.longest)]))


# packing ---------------------------------------------------------------------

def test_chunks_equal_the_tokenizer():
    known, tokenizer = packing.Chunks(WORDS), Tokenizer.from_file(WORDS)
    texts = scraps(1, 3000) + ["", None, "\x1c", "word." * 3000]
    for text, ids in zip(texts, known.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(60))
def test_plans_give_every_piece_a_gapless_place(seed):
    rng = random.Random(seed)
    capacity, n = rng.choice([5, 16, 64, 100]), rng.randint(1, 300)
    lengths = np.array([rng.randint(1, capacity) if rng.random() < 0.7 else rng.randint(1, max(1, capacity // 8)) for _ in range(n)])
    plan = packing.Plan(np.bincount(lengths, minlength=capacity + 1), capacity, rng.choice([1, 3, 10]), rng.choice([2, 8]))
    seen, rank = Counter(), np.zeros(n, dtype=np.int64)
    for i, x in enumerate(lengths):
        rank[i] = seen[x]
        seen[x] += 1
    held = defaultdict(list)
    for s, o, x in zip(*plan.place(lengths, rank), lengths, strict=True):
        held[s].append((o, x))
    assert len(held) == plan.sequences
    for places in held.values():
        end = 0
        for o, x in sorted(places):
            assert o == end
            end += x
        assert end <= capacity


def test_packing_of_documents(spark, folder, odd_documents, no_documents):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").unionByName(
        odd_documents.where("doc_id = 5 or doc_id is null").select(F.col("doc_id") + 10**6, "text").toDF("doc_id", "text"))
    pieces_ = packing.tokenized(docs, WORDS).withColumn("offset", F.lit("clash"))
    rows = packing.pack(pieces_).collect()
    tokenizer, whole, held = Tokenizer.from_file(WORDS), defaultdict(dict), defaultdict(list)
    for r in rows:
        whole[r.doc_id].setdefault(r.piece, []).append(r)
        held[r.sequence_id].append((r.offset, r.length))
    for r in docs.where("doc_id is not null").collect():
        parts = [p[0] for _, p in sorted(whole[r.doc_id].items())]
        assert np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist() == tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        assert all(p.length == 4096 for p in parts[:-1]) and [p.start for p in parts] == [4096 * i for i in range(len(parts))]
    assert len(whole[None][0]) == 2
    for places in held.values():
        end = 0
        for o, x in sorted(places):
            assert o == end
            end += x
        assert end <= 4096
    total = sum(r.length for r in rows)
    assert len(held) <= -(-total // 4096) * 1.05 + 1
    assert packing.pack(packing.tokenized(no_documents, WORDS)).count() == 0


# n-gram Jaccard join -----------------------------------------------------------

@pytest.mark.parametrize("seed, words, similarity", [(0, 4, (85, 100)), (1, 5, (80, 100)), (2, 1, (90, 100))])
def test_similar_groups_equal_brute_force(spark, seed, words, similarity, monkeypatch):
    monkeypatch.setattr(jaccard, "QUERIES", 10)
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghijklm") * rng.randint(1, 2) + str(rng.randint(0, 50)) for _ in range(rng.choice([3, 20, 60, 150]))] for _ in range(12)]
    rows = []
    for i in range(220):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            text[rng.randrange(len(text))] = str(rng.randint(0, 9999))
        rows.append((i, " ".join(text)))
    rows += [(300, None), (301, ""), (302, " \n"), (303, "a b"), (304, "A  b"), (305, "a"), (306, "a"), (5, rows[5][1]), (None, rows[7][1]), (None, None)]
    docs = spark.createDataFrame([(*r, 1, b"") for r in rows], "doc_id long, text string, n int, digest binary").repartition(3)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs, words, similarity).collect()]
    assert sorted(got, key=repr) == sorted(near_groups(rows, words, *similarity), key=repr)
    kept = jaccard.keep_one(docs, words, similarity)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(
        {d for d, _, c in near_groups(rows, words, *similarity) if d == c and d is not None})


@pytest.mark.parametrize("seed", range(5))
def test_divide_skip_equals_comparing_all(seed):
    rng = random.Random(seed)
    sets = [np.unique(np.array([rng.randint(0, 60) for _ in range(rng.randint(1, 40))], dtype=np.uint64)) for _ in range(80)]
    index = jaccard.Index(sets)
    for similarity in ((50, 100), (80, 100), (1, 1)):
        for q in sets:
            want = [i for i, s in enumerate(sets) if similarity[1] * len(np.intersect1d(q, s)) >= similarity[0] * len(np.union1d(q, s))]
            assert index.search(q, similarity).tolist() == want


def test_common_passages_do_not_change_links(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"d{i}_{k}" for k in range(50))) for i in range(60)]
    rows += [(100 + i, passage + f" tail{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = sorted(near_groups(rows, 5, 80, 100))
    for most in (0, 10, 10**6):
        monkeypatch.setattr(jaccard, "MOST_COMMON", most)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs).collect()) == want


def test_similar_groups_of_odd_and_empty_tables(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(odd_documents).collect()), key=repr)
    assert got == sorted(near_groups(rows, 5, 80, 100), key=repr)
    assert jaccard.similar_groups(no_documents).count() == 0 and jaccard.keep_one(no_documents).count() == 0


def test_unlike_texts_with_null_or_shared_ids_stay(spark):
    text = lambda name, n=30: " ".join(f"{name}{k}" for k in range(n))
    rows = [(None, text(f"n{i}_")) for i in range(6)] + [(None, text("n0_") + " more"), (None, text("n1_")), (None, None), (None, " "), (None, "")]
    rows += [(1, text("a")), (1, text("b")), (1, text("a") + " more"), (2, text("b") + " more"), (None, text("b") + " less"), (3, ""), (3, "  "), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in jaccard.keep_one(docs).collect()]
    with_words = [(d, t.split()[0]) for d, t in got if (t or "").split()]
    assert sorted(with_words, key=repr) == sorted([(None, f"n{i}_0") for i in range(6)] + [(1, "a0"), (1, "b0")], key=repr)
    assert sorted((repr(d), t or "") for d, t in got if not (t or "").split()) == [("3", ""), ("3", "  "), ("None", ""), ("None", " ")]


# SentencePiece -----------------------------------------------------------------

def test_pieces_equal_the_library():
    words, library = pieces.Vocabulary(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = scraps(2, 3000) + ["", " ", "  ", "▁", "a" * 5000, "ab" * 3000, "=" * 999, " " * 777, "\n" * 50, "é" * 100]
    for text, ids in zip(texts, words.encode(texts), strict=True):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want and words.decode(ids) == library.decode(want)


def test_remembered_units_are_forgotten_safely(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    words, library = pieces.Vocabulary(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in scraps(3, 200):
        assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_pieces_of_odd_and_empty_tables(odd_documents, no_documents):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    back = pieces.decode(pieces.encode(odd_documents, PIECES), PIECES).collect()
    want = [(r.doc_id, library.encode(r.text or "", add_bos=True, add_eos=True)) for r in odd_documents.collect()]
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in back), key=repr) == sorted(want, key=repr)
    assert sorted(r.decoded for r in back) == sorted(library.decode(i) for _, i in want)
    assert pieces.encode(no_documents, PIECES).count() == 0
