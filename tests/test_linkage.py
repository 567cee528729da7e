import datetime as dt
import difflib
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilgauge.operators import evaluate, linkage, nearest, rounds, textkeys
from veilgauge.operators.linkage import Linkage, explain_matches, match_attribute_matrix
from workbook.views import view

WEIGHTS = {"categorical": 0.3, "numeric": 0.3, "text": 0.2, "date": 0.2}


def link(spark, rows_a, rows_b, schema, **options) -> Linkage:
    a = spark.createDataFrame([(i, *r) for i, r in enumerate(rows_a)], f"ka int, {schema}")
    b = spark.createDataFrame([(i, *r) for i, r in enumerate(rows_b)], f"kb int, {schema}")
    return linkage.linkage(a, b, "ka", "kb", **options)


def brute_force(rows_a, rows_b, kinds, threshold=0.55, top=3):
    """All pairs, one by one."""
    spans = {}
    for i, kind in enumerate(kinds):
        if kind == "numeric":
            present = [r[i] for r in rows_a if r[i] is not None]
            spans[i] = (max(present) - min(present)) or 1
    found = []
    for ka, a in enumerate(rows_a):
        scored = []
        for kb, b in enumerate(rows_b):
            total = 0.0
            for i, kind in enumerate(kinds):
                x, y = a[i], b[i]
                if x is None or y is None:
                    s = 0.0
                elif kind == "categorical":
                    s = float(str(x) == str(y))
                elif kind == "numeric":
                    s = max(0.0, 1 - abs(x - y) / spans[i])
                elif kind == "date":
                    s = max(0.0, 1 - abs((x - y).days) / 730)
                else:
                    s = difflib.SequenceMatcher(None, x.lower().strip(), y.lower().strip()).ratio()
                # Same half-up rounding at three decimals as the engine.
                total += WEIGHTS[kind] * (int(s * 1000 + 0.5 + 1e-9) / 1000)
            score = round(total / sum(WEIGHTS[k] for k in kinds), 9)
            if score >= threshold:
                scored.append((-score, kb))
        found += [(ka, kb, round(-s, 3)) for s, kb in sorted(scored)[:top]]
    return sorted(found)


def as_tuples(result: Linkage):
    return sorted((r["key_a"], r["key_b"], r["match_probability"]) for r in result.matches.collect())


def close(left, right):
    assert [(a, b) for a, b, _ in left] == [(a, b) for a, b, _ in right]
    assert all(abs(x[2] - y[2]) <= 0.0011 for x, y in zip(left, right))


def random_rows(seed, n, nulls=True):
    rng = random.Random(seed)
    maybe = lambda v: None if nulls and rng.random() < 0.08 else v
    return [(maybe(rng.choice("MF")), maybe(rng.choice(["x", "y", "z"])), maybe(rng.randint(18, 40)),
             maybe(rng.choice(["p", "q"]))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1])
def test_blocked_plan_equals_all_pairs_with_nulls_and_copies(spark, seed):
    a, b = random_rows(seed, 60), random_rows(seed + 100, 70)
    a += a[:20]
    b += [b[0]] * 30
    schema = "g string, c string, age int, h string"
    got = as_tuples(link(spark, a, b, schema))
    close(got, brute_force(a, b, ["categorical", "categorical", "numeric", "categorical"]))


def test_salted_leaves_change_nothing(spark, monkeypatch):
    a, b = random_rows(5, 60), random_rows(6, 60)
    schema = "g string, c string, age int, h int"
    a, b = [(*r[:3], i % 5) for i, r in enumerate(a)], [(*r[:3], i % 4) for i, r in enumerate(b)]
    plain = as_tuples(link(spark, a, b, schema))
    monkeypatch.setattr(rounds, "PAIRS_PER_SALT", 500)
    assert as_tuples(link(spark, a, b, schema)) == plain


@pytest.mark.parametrize("kind", ["numeric", "date"])
def test_nearest_cells_hold_every_best_partner(spark, monkeypatch, kind):
    monkeypatch.setattr(linkage, "CROWDED", 0)
    rng = random.Random(11)
    # Dense, sparse and far-away stretches, nulls, and values outside the target's range.
    spots = [0, 1, 2, 3, 500, 501, 502, 10_000, 40_000]
    pick = lambda: None if rng.random() < 0.05 else rng.choice(spots) + rng.randint(0, 40)
    day = lambda v: None if v is None else dt.date(1990, 1, 1) + dt.timedelta(days=v)
    value = pick if kind == "numeric" else lambda: day(pick())
    a = [(rng.choice("MF"), rng.choice("xy"), value()) for _ in range(70)]
    b = [(rng.choice("MF"), rng.choice("xy"), value()) for _ in range(150)]
    b += [("M", "x", 90_000 if kind == "numeric" else day(90_000)), ("M", "x", None)]
    got = as_tuples(link(spark, a, b, f"g string, c string, v {'int' if kind == 'numeric' else 'date'}"))
    close(got, brute_force(a, b, ["categorical", "categorical", kind]))


def test_dates_and_two_graded_columns(spark):
    rng = random.Random(9)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 900))
    a = [(rng.choice("MF"), rng.randint(1, 50), day()) for _ in range(40)]
    b = [(rng.choice("MF"), rng.randint(1, 50), day()) for _ in range(40)]
    got = as_tuples(link(spark, a, b, "g string, v int, d date"))
    close(got, brute_force(a, b, ["categorical", "numeric", "date"]))


def test_text_columns_use_the_matching_blocks_ratio(spark):
    words = ["anna maria", "ana maria", "peter pan", "petra pane", "zoe", "zoey b", "john smith", "jon smyth"]
    a = [(w, "x") for w in words]
    b = [(w.upper() + " ", "x") for w in reversed(words)]
    kinds = {"name": "text", "g": "categorical"}
    got = as_tuples(link(spark, a, b, "name string, g string", kinds=kinds))
    close(got, brute_force(a, b, ["text", "categorical"]))
    edit = as_tuples(link(spark, a, b, "name string, g string", kinds=kinds, text_method="levenshtein"))
    assert (0, 7, 1.0) in edit


def test_numbers_only_need_no_shared_category(spark):
    a, b = [(i,) for i in range(30)], [(i * 2,) for i in range(30)]
    close(as_tuples(link(spark, a, b, "v int")), brute_force(a, b, ["numeric"]))


def test_identical_records_match_with_high_confidence(spark):
    rows = [(30, "Male", "110001", "Engineer")]
    result = link(spark, rows, rows, "Age int, Gender string, Pincode string, Occupation string")
    match = result.matches.first()
    assert match["match_probability"] > 0.9 and match["risk_level"] in ("HIGH", "CRITICAL")
    assert result.summary().first()["candidates_tested"] == 1


def test_disjoint_columns_give_nothing(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "ka int, X int")
    b = spark.createDataFrame([(1, 1), (2, 2)], "kb int, Y int")
    row = linkage.linkage(a, b, "ka", "kb").summary().first()
    assert (row["matches_found"], row["candidates_tested"], row["target_rows_tested"]) == (0, 0, 0)


def test_dissimilar_records_do_not_match(spark):
    a = spark.createDataFrame([(1, 20, "Male"), (2, 80, "Male")], "ka int, Age int, Gender string")
    b = spark.createDataFrame([(1, 80, "Female")], "kb int, Age int, Gender string")
    assert linkage.linkage(a, b, "ka", "kb").matches.count() == 0


@pytest.mark.parametrize("code,score", [(110099, 0.0), (110045, 1.0)])
def test_numeric_codes_are_compared_exactly(spark, code, score):
    a = spark.createDataFrame([(1, 110045, "Male")], "ka int, Pincode int, Gender string")
    b = spark.createDataFrame([(1, float(code), "Male")], "kb int, Pincode double, Gender string")
    row = linkage.linkage(a, b, "ka", "kb", threshold=0.3).matches.first()
    assert row["matching_attributes"]["Pincode"]["score"] == score
    assert row["matching_attributes"]["Pincode"]["kind"] == "categorical"


def test_every_row_takes_part(spark):
    rows = [(20 + i % 50, "Male" if i % 2 else "Female") for i in range(500)]
    schema = "Age int, Gender string"
    full = link(spark, rows, rows, schema).summary().first()
    assert full["target_rows_tested"] == 500 and not full["was_truncated"] and full["matches_found"] == 1500


def test_weights_go_by_either_name(spark):
    rows, schema = [(20, "Male"), (30, "Female")], "Age int, Gender string"
    a, b = (link(spark, rows, rows, schema, weights=w).matches.orderBy("key_a", "match_rank").collect()
            for w in ({"numeric_closeness": 0.9, "categorical_exact": 0.1}, {"numeric": 0.9, "categorical": 0.1}))
    assert a == b and len(a)
    with pytest.raises(ValueError, match="unknown weights"):
        link(spark, rows, rows, schema, weights={"colour": 1.0})


@pytest.mark.parametrize("seed,halvings", [(0, 30), (1, 30), (2, 3)])
def test_crowded_numbers_equal_all_pairs(spark, monkeypatch, seed, halvings):
    """Crowds, values exactly on the rounding cuts, and outliers, with cells halved from two values on."""
    monkeypatch.setattr(linkage, "CROWDED", 0)
    monkeypatch.setattr(nearest, "CROWD", 2)
    monkeypatch.setattr(nearest, "HALVINGS", halvings)
    monkeypatch.setattr(nearest, "SMALLEST", halvings + 1)
    rng = random.Random(seed)
    spots = [0.0, 10.0, 20.0, 500.0, 19_990.0, 20_000.0]
    value = lambda: rng.choice(spots) + rng.choice([0, rng.random() * 40, rng.randint(0, 40) * 0.5, rng.randint(0, 4) * 10])
    a = [(rng.choice("MF"), value()) for _ in range(80)] + [("M", 0.0), ("M", 20_000.0)]
    b = [(rng.choice("MF"), value()) for _ in range(150)] + [("F", 1e7), ("M", None), ("M", -1e7)] + [("M", 1e7 + k) for k in range(20)]
    close(as_tuples(link(spark, a, b, "g string, v double")), brute_force(a, b, ["categorical", "numeric"]))


def test_crowded_incomes_make_few_pairs(spark):
    rng = random.Random(4)
    a = [(float(rng.randint(0, 99_999)),) for _ in range(3000)] + [(1e9,)]
    b = [(float(rng.randint(0, 99_999)),) for _ in range(3000)]
    result = link(spark, a, b, "income double")
    assert result.matches.count() >= 9000 and result.scored_pairs < 100_000
    # All of them are within half a step of each other, so the smallest keys win.
    assert {(r.key_b, r.match_rank) for r in result.matches.where("key_a < 3000").collect()} == {(0, 1), (1, 2), (2, 3)}


@pytest.mark.parametrize("group", range(4))
def test_text_join_equals_all_pairs(spark, monkeypatch, group):
    """Twenty seeds, five at a time."""
    a, b = [], []
    for seed in range(5 * group, 5 * group + 5):
        rng = random.Random(seed)
        name = lambda: rng.choice(["anna", "ana", "hannah", "peter", "petra", "zoë", "o", "", "jon smith", "john smyth"]) + rng.choice(  # noqa: B023, E731
            ["", " m", " maria", "son", "s", "son son"]) + (str(rng.randint(0, 99)) if rng.random() < 0.3 else "")  # noqa: B023
        odd = lambda v: None if rng.random() < 0.06 else v  # noqa: B023, E731
        mine = [(odd(name()), rng.choice("xyz")) for _ in range(40)]
        a += mine
        b += [(odd(rng.choice([name().upper() + " ", (mine[i % 40][0] or "q") + "x"])), rng.choice("xyz")) for i in range(45)]
    monkeypatch.setattr(rounds, "ROUND_COST", 0)
    monkeypatch.setattr(rounds, "TEXT_SHARE", 1e-6)  # as if texts were the most selective key
    threshold = [0.55, 0.8, 0.9, 0.6][group]
    result = link(spark, a, b, "name string, g string", kinds={"name": "text", "g": "categorical"}, threshold=threshold)
    close(as_tuples(result), brute_force(a, b, ["text", "categorical"], threshold=threshold))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test data not mounted")
def test_customer_names_need_few_exact_ratios(spark, capsys):
    a, b = (view(spark, "/root/testdata/sf0.01", name) for name in ("subjects", "names_aux"))
    result = linkage.linkage(a, b, "customer_id", "aux_id", columns=["full_name", "region", "occupation"])
    pairs = a.count() * b.count()
    with capsys.disabled():
        print(f" {result.scored_pairs} of {pairs} pairs scored ", end="")
    assert result.scored_pairs < 0.01 * pairs


def test_text_join_by_edit_distance_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(rounds, "TEXT_SHARE", 1e-6)
    monkeypatch.setattr(rounds, "ROUND_COST", 0)
    monkeypatch.setattr(rounds, "WORTH", 1.0)

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, before = [i], row
            for j, d in enumerate(y, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
        return row[-1]

    rng = random.Random(77)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
    a, b = [(word(),) for _ in range(60)], [(word(),) for _ in range(60)]
    want = []
    for i, (x,) in enumerate(a):
        scored = []
        for j, (y,) in enumerate(b):
            s = 1 - distance(x, y) / max(len(x), len(y)) if x or y else 1.0
            scored.append((-round(int(s * 1000 + 0.5 + 1e-9) / 1000, 9), j))
        want += [(i, j, -s) for s, j in sorted(scored)[:3] if -s >= 0.55]
    got = as_tuples(link(spark, a, b, "name string", kinds={"name": "text"}, text_method="levenshtein"))
    close(got, sorted(want))


@pytest.mark.parametrize("rows", [1_000_000, -1])
def test_names_that_differ_in_digits_meet_by_what_they_have_in_common(spark, monkeypatch, rows):
    """Nearly all share some character pair, so those are listed only for the few names without similar ones."""
    looking, listed = [], textkeys.with_tokens
    monkeypatch.setattr(textkeys, "with_tokens", lambda *given: looking.append(given[0].count()) or listed(*given))
    monkeypatch.setattr(rounds, "ROUND_COST", 0)
    monkeypatch.setattr(rounds, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(rounds, "BROADCAST_KEYS", rows, raising=False)
    monkeypatch.setattr(rounds, "PAIRS_PER_SALT", 500)
    a = [(f"Customer#{i:09}", "x") for i in range(250)]
    b = [([n, n.replace("#", ""), f"{n.upper()}x"][i % 3], None if i == 7 else "x") for i, (n, _) in enumerate(a)] + [(None, "x"), ("", "x")]
    result = link(spark, a, b, "name string, g string", kinds={"name": "text", "g": "categorical"})
    close(as_tuples(result), brute_force(a, b, ["text", "categorical"]))
    assert sum(looking) < 0.2 * len(a), (looking, result.scored_pairs)


@pytest.mark.parametrize("method", ["ratcliff", "levenshtein"])
def test_similar_texts_list_a_subsequence_in_common(spark, method):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé😀") for _ in range(rng.randint(0, 9)))
    pairs = [(word(), word()) for _ in range(3000)] + [(w, w[:k] + w[k + 1:]) for w in (word() for _ in range(500)) for k in (0, 3)]
    lengths = list(range(10))
    listed = lambda c: textkeys.subsequences(F.col(c), lengths, lengths, method, 0.8)
    score = linkage.similarity.TEXT_METHODS[method]
    found = spark.createDataFrame([*pairs, (None, "a")], "a string, b string").select(
        "a", "b", F.round(score(F.col("a"), F.col("b")), 3).alias("s"), listed("a").alias("x"), listed("b").alias("y")).collect()
    alike = [r for r in found if r.s >= 0.8]
    assert len(alike) > 300 and all(set(r.x) & set(r.y) for r in alike)
    assert all(len(set(r.x)) == len(r.x) for r in found) and not [r for r in found if r.a is None and r.x]


@pytest.mark.parametrize("a,b,method,least", [("anna maria", "ana maria", "ratcliff", 0.9), ("abcd", "abce", "levenshtein", 0.75)])
def test_similar_texts_share_as_many_pairs_as_stated(spark, a, b, method, least):
    marked = lambda t: [f"\2{t}\3"[k:k + 2] for k in range(len(t) + 1)]
    shared = sum((Counter(marked(a)) & Counter(marked(b))).values())
    stated = spark.range(1).selectExpr(f"{textkeys.shared_at_least(method, str(len(a)), f'{least}D')} AS n").first().n
    assert 1 <= stated <= shared


@pytest.mark.parametrize("seed", range(2))
def test_several_graded_columns_equal_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(rounds, "ROUND_COST", 0)
    rng = random.Random(seed)
    day = lambda: None if rng.random() < 0.05 else dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 2500))
    a = [(rng.choice("MFX"), rng.uniform(1, 50), day(), rng.randint(0, 9)) for _ in range(70)]
    b = [(rng.choice("MFX"), rng.uniform(-20, 90), day(), rng.randint(0, 9)) for _ in range(80)]
    result = link(spark, a, b, "g string, v double, d date, n int")
    close(as_tuples(result), brute_force(a, b, ["categorical", "numeric", "date", "numeric"]))
    assert result.scored_pairs < 70 * 80 * 0.8


@pytest.mark.parametrize("width,threshold", [(20, 0.55), (20, 0.85), (65, 0.75)])
def test_any_number_of_shared_categories(spark, width, threshold):
    rng = random.Random(width)
    a = [tuple(rng.choice("abcd") for _ in range(width)) for _ in range(40)]
    b = [tuple(v if rng.random() < 0.75 else rng.choice("abcd") for v in rng.choice(a)) for _ in range(60)]
    schema = ", ".join(f"c{i} string" for i in range(width))
    close(as_tuples(link(spark, a, b, schema, threshold=threshold)), brute_force(a, b, ["categorical"] * width, threshold=threshold))


def test_tuples_under_many_leaves_are_not_broadcast(spark, monkeypatch):
    """The planner sees a side's size before it is listed under every leaf, and would send it to the driver."""
    plans, write = [], rounds.materialise
    monkeypatch.setattr(rounds, "BROADCAST_ROWS", 50, raising=False)
    monkeypatch.setattr(rounds, "ROUND_COST", 1)
    monkeypatch.setattr(rounds, "materialise", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or write(df))
    rng = random.Random(4)
    rows = [[str(rng.randrange(4)) for _ in range(12)] for _ in range(300)]
    link(spark, rows, rows, ", ".join(f"c{i} string" for i in range(12)), kinds={f"c{i}": "categorical" for i in range(12)}).matches.count()
    joins = [line for plan in plans for line in plan.splitlines() if "Join [x" in line]
    assert joins and not [line for line in joins if "Broadcast" in line]


def test_rounds_of_many_categories_grow_in_small_steps():
    """Twice the loss lists twenty categories under twenty times the leaves, for few tuples that need it."""
    plan = linkage.Comparison([str(i) for i in range(20)], ["categorical"] * 20, [0.3] * 20, [1.0] * 20, 0.55, 3, "ratcliff")
    stats = rounds.Statistics(15_000, 15_000, dict.fromkeys(range(20), 0.2), {})
    losses = rounds.schedule(plan, stats)
    costs = [rounds.cheapest(plan, stats, loss, stats.target)[1] for loss in losses]
    assert all(after < 10 * before for before, after in zip(costs, costs[1:]))


@pytest.mark.parametrize("columns", [9, 16])
def test_values_packed_as_bytes_equal_all_pairs_with_nulls(spark, monkeypatch, columns):
    """Several numbers of bytes, more values than a byte tells apart, missing values on both sides, repeated rows."""
    monkeypatch.setattr(rounds, "ROUND_COST", 1)
    monkeypatch.setattr(rounds, "PAIRS_PER_SALT", 500)
    rng = random.Random(columns)

    def rows(n):
        made = [[None if rng.random() < 0.15 else str(rng.randrange(1200 if i < 2 else 3)) for i in range(columns)] for _ in range(n)]
        return made + [list(r) for r in made[:10]]
    a, b = rows(120), rows(150)
    names = [f"c{i}" for i in range(columns)]
    result = link(spark, a, b, ", ".join(f"{c} string" for c in names), kinds=dict.fromkeys(names, "categorical"), threshold=0.5)
    found = as_tuples(result)
    assert found
    close(found, brute_force(a, b, ["categorical"] * columns, threshold=0.5))


def categories(seed, n, columns, values=4, missing=0.0):
    rng = random.Random(seed)
    return [tuple(None if rng.random() < missing else str(rng.randrange(values)) for _ in range(columns)) for _ in range(n)]


def schema_of(columns):
    return ", ".join(f"c{i} string" for i in range(columns)), dict.fromkeys((f"c{i}" for i in range(columns)), "categorical")


def test_many_categories_are_listed_under_few_sets_of_columns(spark, monkeypatch):
    """Twenty categories of which every sixth value is lost: rows listed under every set have to be written, pairs looked at don't."""
    asked, listed = [], rounds._listed
    monkeypatch.setattr(rounds, "_listed", lambda df, rows: asked.append(rows) or listed(df, rows))
    a = categories(3, 1000, 20)
    b = [tuple("none" if (k + i) % 6 == 0 else v for i, v in enumerate(r)) for k, r in enumerate(a)]
    schema, kinds = schema_of(20)
    result = link(spark, a, b, schema, kinds=kinds)
    assert result.matches.where("match_rank = 1 and key_a = key_b").count() > 900
    assert sum(asked) < 30 * (len(a) + len(b)), asked


@pytest.mark.parametrize("columns,threshold,missing", [(3, 0.0, 0.3), (3, 1.0, 0.1), (8, 0.55, 0.1), (24, 0.5, 0.05), (62, 0.35, 0.0)])
def test_packed_categories_equal_all_pairs_and_meet_once(spark, monkeypatch, columns, threshold, missing):
    """From all columns differing to none, hot keys dealt to tasks, long codes, repeated rows, one round and many."""
    monkeypatch.setattr(rounds, "CODED", 3)
    monkeypatch.setattr(rounds, "HOT_PAIRS", 20)
    a, b = categories(columns, 40, columns, 3, missing), categories(columns + 1, 50, columns, 4, missing)
    a, b = a + a[:9] + [("0",) * columns] * 3, b + b[:9] + b[:9] + [("0",) * columns, (None,) * columns]
    schema, kinds = schema_of(columns)
    want = brute_force(a, b, ["categorical"] * columns, threshold=threshold)
    once = link(spark, a, b, schema, kinds=kinds, threshold=threshold)
    close(as_tuples(once), want)
    agree = lambda x, y: sum(v is not None and v == w for v, w in zip(x, y)) / columns
    assert once.scored_pairs == sum(agree(x, y) > threshold - 1e-9 for x in set(a) for y in set(b))
    if columns < 10:
        monkeypatch.setattr(rounds, "ROUND_COST", 0)
        monkeypatch.setattr(rounds, "WORTH", 1.0)
        monkeypatch.setattr(rounds, "BROADCAST_ROWS", -1)
        close(as_tuples(link(spark, a, b, schema, kinds=kinds, threshold=threshold)), want)


def test_equal_scores_go_to_the_smallest_keys_of_packed_tuples(spark):
    """Keys in no order of rows, texts, some on the same tuple, one missing."""
    rng = random.Random(8)
    keys = [f"k{n:03}" for n in rng.sample(range(1000), 200)]
    a = spark.createDataFrame([(1, "x", "y", "z")], "ka int, c string, d string, e string")
    rows = [(k, "x", "y" if rng.random() < 0.5 else None, str(i % 70)) for i, k in enumerate(keys)] + [(None, "x", "y", "none")]
    b = spark.createDataFrame(rows, "kb string, c string, d string, e string").repartition(7)
    result = linkage.linkage(a, b, "ka", "kb", kinds=dict.fromkeys("cde", "categorical"))
    assert [r["key_b"] for r in result.matches.orderBy("match_rank").collect()] == sorted(r[0] for r in rows if r[0] and r[2])[:3]


@pytest.mark.parametrize("few", [1024, 10])
def test_codes_tell_all_values_of_a_column_apart(spark, monkeypatch, few):
    monkeypatch.setattr(rounds, "CODED", few)
    numbers = [1, 6, 300, 900, 0]
    plan = linkage.Comparison(list("abcde"), ["categorical"] * 5, [0.3] * 5, [1.0] * 5, 0.55, 3, "ratcliff")
    counted = spark.createDataFrame([(str(i), f"v{k}") for i, n in enumerate(numbers) for k in range(n)], "i string, v string")
    codes = rounds._codes(counted, plan)
    taken = [0] * len(rounds._words(codes))
    for i, code in codes.items():
        seen = [r["c"] for r in counted.where(f"i = '{i}'").selectExpr(f"{code.of('v', False)} AS c").collect()]
        null = spark.range(1).selectExpr("string(null) AS v").selectExpr(code.of("v", False), code.of("v", True)).first()
        assert len({*seen, *null}) == numbers[i] + 2 and all(c & ~code.mask == 0 for c in [*seen, *null])
        assert taken[code.word] & code.mask == 0
        taken[code.word] |= code.mask
    assert max(taken) < 1 << rounds.BITS


@pytest.mark.parametrize("a,b", [([], [("x", "y")]), ([("x", "y")], []), ([(None, "y")], [(None, "y"), (None, None)])])
def test_categories_without_rows_or_values(spark, a, b):
    schema, kinds = schema_of(2)
    result = link(spark, a, b, schema, kinds=kinds, threshold=0.5)
    close(as_tuples(result), brute_force(a, b, ["categorical"] * 2, threshold=0.5))
    assert result.summary().first()["matches_found"] == len(brute_force(a, b, ["categorical"] * 2, threshold=0.5))


def test_explanations_and_matrix(spark):
    rows = [(30, "Male"), (60, "Female")]
    result = link(spark, rows, [(31, "Male")], "Age int, Gender string")
    told = {r["attribute"]: r["strength"] for r in explain_matches(result.matches).where("key_a = 0").collect()}
    assert told == {"Age": "strong", "Gender": "strong"}
    assert match_attribute_matrix(result).first()["Gender"] == 1.0


def test_precision_recall_of_empty_sets_is_perfect(spark):
    none = spark.createDataFrame([], "k int")
    one = spark.createDataFrame([(1,)], "k int")
    row = evaluate.precision_recall(none, none, ["k"]).first()
    assert (row["precision"], row["recall"], row["f1"]) == (1.0, 1.0, 1.0)
    row = evaluate.precision_recall(none, one, ["k"]).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)


def test_linkable_overlap_equals_brute_force(spark):
    rng = random.Random(3)
    a = [(rng.choice("ab"), rng.uniform(0, 40)) for _ in range(120)] + [("a", None), (None, 3.0)]
    b = [(rng.choice("ab"), rng.uniform(0, 40)) for _ in range(25)]
    want = sum(any(x == p and v is not None and abs(v - q) <= 1.5 for p, q in b) for x, v in a)
    got = evaluate.linkable_overlap(spark.createDataFrame(a, "c string, v double"),
                                    spark.createDataFrame(b, "c string, v double"), ["c"], "v", 1.5)
    assert got.first()["linkable_records"] == want
