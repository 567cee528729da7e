"""Large groups of near copies: links and components are right, and no row stands for every pair."""

import random

import pytest
from llm_brute import near_groups

from veilgauge.llm import jaccard
from veilgauge.llm.jaccard import word_hashes


def _group(seed: int, copies: int) -> list[tuple[int, str]]:
    """Copies of one text that each lack some words: similarities on both sides of the bound, rarely connected by one smallest set."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(145)]
    rows = []
    for i in range(copies):
        cut = set(rng.sample(range(len(base)), rng.choice([0, 1, 2, 3, 4, 5])))
        rows.append((i, " ".join(w for k, w in enumerate(base) if k not in cut)))
    return rows


def test_a_dense_group_returns_connecting_links_only(spark, monkeypatch):
    rows = _group(3, 240)
    made, write = [], jaccard.materialise

    def counted(df):
        out, count = write(df)
        if df.columns == ["a", "b"] and dict(df.dtypes)["a"] == "binary":
            made.append(count)
        return out, count

    monkeypatch.setattr(jaccard, "materialise", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs, 4, (85, 100)).collect())
    assert got == sorted(near_groups(rows, 4, 85, 100))
    # A search of s sets returns less than s links; the first round searches a few blocks.
    assert made and all(count < 4 * len(rows) for count in made)


@pytest.mark.parametrize("seed, words, similarity", [(0, 4, (85, 100)), (1, 5, (80, 100))])
def test_lists_searched_in_blocks_equal_brute_force(spark, seed, words, similarity, monkeypatch):
    monkeypatch.setattr(jaccard, "CROWD", 3)
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 20)
    monkeypatch.setattr(jaccard, "QUERIES", 10)
    rows = _group(seed, 130) + [(1000 + d, "other words " + t) for d, t in _group(seed + 10, 30)] + [(2000, None), (2001, "w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs, words, similarity).collect())
    assert got == sorted(near_groups(rows, words, *similarity))


def test_word_hashes_follow_the_words():
    texts = [None, "", " \n", "A b\x0bB\té É", "x" * 40 + " " + "X" * 40 + " " + "x" * 41, "\x1fy \x85 z"]
    hashes, counts = word_hashes(texts)
    words = [w for t in texts for w in (t or "").encode().lower().split()]
    assert counts.tolist() == [len((t or "").encode().split()) for t in texts]
    assert len({(w, h) for w, h in zip(words, hashes.tolist(), strict=True)}) == len(set(words)) == len(set(hashes.tolist()))
