"""Fill-in-middle, whitening and personal data against brute force, and their corner cases."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgauge.llm import infill, merges, personal, registry, whitening

# --- Fill in the middle ---------------------------------------------------------------


def turned_by_hand(doc_id, text, seed=7, rate=100, first=50, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < first:
        return len(units), "spm", len(p), len(m), marks[1] + s + marks[0] + p + marks[2] + m
    return len(units), "psm", len(p), len(m), marks[0] + p + marks[1] + s + marks[2] + m


def random_texts(n=200):
    rng = random.Random(3)
    bits = ["a", "é", "\n", "\n\n", "\r\n", "<", "P>", "<S", "wörd ", " ", "𝒳", "", "<M>"[: rng.randint(0, 2)]]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(n)] + [
        None, "", "\n", "no break", "ends\n", "\n\n\n", "has <P> inside\nand\nmore", "x <S>", "<M>", "a\n" * 300_000, "z" * 400_000]


@pytest.mark.parametrize("how", [infill.Infill(), infill.Infill("[PRE]", "[SUF]", "[MID]", rate=60, suffix_first=10, seed=3)])
def test_fill_in_middle_equals_plain_python(spark, how):
    texts = random_texts()
    docs = spark.createDataFrame([(i if i % 50 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    made = infill.fill_in_middle(docs, how)
    rows = made.withColumn("back", infill.restored(F.col("form"), F.col("output"), how)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[infill.ADDED[k]] for k in range(5)) == turned_by_hand(
            r.doc_id, r.text, how.seed, how.rate, how.suffix_first, tuple(how.marks)), r.doc_id
        assert r.back == (r.text or "")


def test_fill_in_middle_slices_change_nothing(spark, monkeypatch):
    import pyarrow as pa
    texts = pa.array([t for t in random_texts(40)])
    assert [b - a for a, b in infill._slices(texts)] and sum(b - a for a, b in infill._slices(texts)) == len(texts)
    monkeypatch.setattr(infill, "SLICE_BYTES", 1)
    assert [(a, b) for a, b in infill._slices(texts)][-1][1] == len(texts)


def test_fill_in_middle_with_odd_rows(spark, odd_documents, no_documents):
    clash = odd_documents.withColumn("output", F.lit(1)).withColumn("form", F.lit(2)).withColumn("__draw1", F.lit(3))
    made = infill.fill_in_middle(clash)
    assert made.columns.count("form") == 1 and "digest" in made.columns and "__draw1" not in made.columns
    assert made.count() == odd_documents.count()
    assert infill.fill_in_middle(no_documents).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "S", "<M>"), ("", "<S>", "<M>"), ("<P", "<P>", "<M>")):
        with pytest.raises(ValueError):
            infill.Infill(*bad)


# --- Whitening -----------------------------------------------------------------------


def vectors(rows, d, seed=0):
    rng = np.random.default_rng(seed)
    basis = rng.standard_normal((d, d)) * np.linspace(0.02, 0.4, d)
    return (rng.standard_normal((rows, d)) @ basis).astype(np.float32)


def check_whitening(spark, x, got, components):
    whole = np.floor(64 * x.astype(np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(whole), whole.sum(axis=0)
    centred = whole - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    rows = sorted(got.collect(), key=lambda r: r.vec_id)
    assert [r.vec_id for r in rows] == list(range(n)) and {r.n for r in rows} == {n}
    assert [r.deviation for r in rows] == [int(((n * w - sums) ** 2).sum()) for w in whole]
    k = min(components, x.shape[1])
    assert np.allclose(rows[0].explained, values[:k] / values.sum(), rtol=1e-9)
    white = np.array([r.whitened for r in rows])
    want = centred @ axes[:, :k] / np.sqrt(values[:k])
    want *= np.sign((want * white).sum(axis=0))
    assert np.abs(white - want).max() < 1e-6
    assert np.abs(np.cov(white.T, bias=True) - np.eye(k)).max() < 1e-9 and rows[0].identity_error < 1e-9


@pytest.mark.parametrize("rows,d,components", [(300, 64, 32), (400, 120, 10), (50, 7, 32)])
def test_whitening_equals_dense_eigenvectors(spark, rows, d, components):
    x = vectors(rows, d)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    check_whitening(spark, x, whitening.whiten(df, components=components), components)


def test_jacobi_davidson_on_large_clustered_and_flat_spectra():
    rng = np.random.default_rng(5)
    axes, _ = np.linalg.qr(rng.standard_normal((400, 400)))
    for values in (np.linspace(5, 1, 400), np.repeat([9.0, 4.0, 4.0 - 1e-9, 1.0], 100), np.r_[np.full(3, 1e6), np.geomspace(1, 1e-3, 397)]):
        matrix = axes * values @ axes.T
        passes = [0]

        def products(block):
            passes[0] += 1
            return matrix @ block

        found, basis, residuals = whitening.jacobi_davidson(products, 400, 20)
        assert np.allclose(found, np.sort(values)[::-1][:20], rtol=1e-9)
        assert residuals.max() <= 1e-12 * values.max() and np.abs(basis.T @ basis - np.eye(20)).max() < 1e-12
        assert passes[0] < 400


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    b = rng.standard_normal((30, 4))
    b[:, 3] = 0
    x = whitening._minres(lambda v: a @ v, b, 120, 1e-12)
    assert np.abs(a @ x - b).max() < 1e-6


def test_whitening_with_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, x int, n string, id int"
    good = [(1, [1.0, 2.0, 0.5], 1, "a", 1), (2, [0.0, 1.0, 0.5], 2, "b", 2), (2, [0.0, 1.0, 0.5], 2, "b", 2), (None, [3.0, -1.0, 0.5], 3, "c", 3)]
    bad = [(4, None, 4, "d", 4), (5, [float("nan"), 1.0, 1.0], 5, "e", 5), (6, [None, 1.0, 1.0], 6, "f", 6), (7, [float("inf"), 0.0, 1.0], 7, "g", 7)]
    rows = whitening.whiten(spark.createDataFrame(good + bad, schema)).collect()
    assert sorted(str(r.vec_id) for r in rows) == ["1", "2", "2", "None"]
    assert all(len(r.whitened) == 2 and r.n == 4 and r.identity_error < 1e-9 for r in rows)  # the third dimension does not vary
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame(bad, schema)).count() == 0
    copies = whitening.whiten(spark.createDataFrame(good[:1] * 5, schema)).collect()
    assert [(r.whitened, r.deviation, r.identity_error) for r in copies] == [([], 0, 0.0)] * 5
    with pytest.raises(ValueError, match="one length"):
        whitening.whiten(spark.createDataFrame(good + [(9, [1.0], 1, "z", 1)], schema))


def test_deviation_beyond_longs_is_null_and_exact_below(spark):
    rows = [(i, [float(i) * 1e7, 1.0 - i]) for i in range(40)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    whole = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*whole)]
    for i, w in enumerate(whole):
        exact = sum((40 * a - s) ** 2 for a, s in zip(w, sums))
        assert got[i] == (exact if exact < 2 ** 63 else None)
    assert None in got.values()


def test_whitening_query_on_given_vectors(spark, folder):
    rows = registry.op12_jacobi_davidson(spark, folder).collect()
    given = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    usable = [r for r in given if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    assert len(rows) == 32 * len(usable) and {r.component for r in rows} == set(range(1, 33)) and rows[0].identity_error < 1e-4


# --- Personal data --------------------------------------------------------------------

PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 13 <= len(re.sub("[^0-9]", "", t)) <= 19 and slow_luhn(re.sub("[^0-9]", "", t))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(re.sub("[^0-9]", "", t)) <= 15),
}


def slow_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_spans(text):
    return [(kind, m.start(), m.end()) for kind, (pattern, fits) in PLAIN.items() for m in re.finditer(pattern, text or "") if fits(m.group())]


def base_of(text):
    return [s for s in personal.confirmed(text) if s[0] in personal.BASE]


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(8)
    bits = ["a", "b.c", "@", "x@y.z", ".", "_", "-", " ", "1", "22", "256", "4111 1111 1111 1111", "+", "+1 (555) 010-9999", "10.0.0.1", "(", ")", "é",
            "5500-0000-0000-0004", "%", "\n", "0", "9", "mail.example.com", "+49 30 ", "7992739871", "3"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert base_of(text) == plain_spans(text), text


def test_query_equals_the_plain_patterns(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in registry.op13_personal_data(spark, folder).collect():
        want = plain_spans(texts[r.doc_id])
        assert [r[f"n_{k}"] for k in personal.BASE] == [sum(s[0] == k for s in want) for k in personal.BASE]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)


@pytest.mark.parametrize("text,kinds", [
    ("IBAN DE89 3704 0044 0532 0130 00 AND MORE", ["iban"]), ("IBAN DE89 3704 0044 0532 0130 01", []), ("GB82WEST12345698765432", ["iban"]),
    ("GB82WEST123456987654321", []), ("social security 123-45-6789", ["ssn"]), ("part 123-45-6789", []), ("SSN 000-45-6789", []),
    ("call 555-010-9999 today", ["national_phone"]), ("item 555-010-9999", []), ("tel. (555) 010-9999", ["national_phone"]),
    ("phone +1 555 010 9999", ["phone"]), ("order phone 555-010-9999", []), ("card 4111 1111 1111 1111", ["card"]),
    ("card 4111 1111 1111 1112", [])])
def test_context_and_checksums_decide(spark, text, kinds):
    spans = personal.find(text, personal._word_patterns(), personal.THRESHOLD)
    assert [s[0] for s in spans] == kinds and all(text[s[1]:s[2]] == s[4] for s in spans)


def test_context_moves_the_score():
    patterns = personal._word_patterns()
    score = lambda t: personal.find(t, patterns, 0.0)[0][3]
    assert score("host 10.0.0.1") > score("it 10.0.0.1 is") > score("version 10.0.0.1")


@pytest.mark.parametrize("unit", ["a", "1", "1 ", "+", "+1", "@", "a@", "1.", "A1", "a.", "+1 ", "a@b", "AB12 ", "-"])
def test_hostile_long_texts_take_linear_time(unit):
    text = unit * (400_000 // len(unit))
    start = time.time()
    list(personal.confirmed(text))
    assert time.time() - start < 5


def test_spans_with_odd_rows_and_masking(spark, odd_documents, no_documents):
    docs = odd_documents.withColumn("spans", F.lit(3))
    found = personal.personal_spans(docs)
    assert found.count() == odd_documents.count() and found.columns.count("spans") == 1
    assert all(r.spans == [] for r in found.where("text is null or text = ''").collect())
    assert personal.personal_spans(no_documents).count() == 0
    said = spark.createDataFrame([("é me@x.org or 10.0.0.1, +4111 1111 1111 1111 end",), ("none",), (None,)], "text string")
    spans = personal.personal_spans(said)
    assert [r.m for r in spans.select(personal.masked(F.col("text"), F.col("spans")).alias("m")).collect()] == [
        "é [EMAIL] or [IP], +[CARD] end", "none", None]


@pytest.mark.parametrize("bits", [3, 6, 19])
def test_merges_are_found_by_hash_whatever_collides(monkeypatch, bits):
    monkeypatch.setattr(merges, "BITS", bits)
    rng = np.random.default_rng(bits)
    table = {(int(a), int(b)): (r, 100 + r) for r, (a, b) in enumerate({(int(a), int(b)) for a, b in rng.integers(0, 40, (300, 2))})}
    known = merges.PairMerges(table, 40)
    assert len(known.places) == 2 and (bits == 19) == (not len(known.left))
    left, right = np.divmod(np.arange(1600), 40)
    ranks, made = known._look_up(left, right)
    for a, b, rank, symbol in zip(left.tolist(), right.tolist(), ranks.tolist(), made.tolist()):
        assert (rank, symbol) == table[a, b] if (a, b) in table else rank == merges.NO_PAIR
