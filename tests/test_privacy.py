from collections import Counter

import numpy as np
import pytest

from veilgauge.operators import frequencies, privacy, profile, quantiles, skew
from veilgauge.session import materialise

QI = ["Age", "Gender", "Pincode"]


def test_uniqueness_counts_classes_and_single_rows(privacy_small):
    row = privacy.uniqueness(privacy_small, QI).first()
    assert (row["equivalence_classes"], row["unique_records"], row["unique_pct"]) == (3, 1, 16.67)


def test_k_anonymity_is_violated_at_two_and_holds_at_one(privacy_small):
    checks = {r["k"]: r for r in privacy.k_anonymity(privacy_small, QI, [1, 2, 3]).collect()}
    assert checks[1]["satisfies_k_anonymity"] and not checks[2]["satisfies_k_anonymity"]
    assert checks[2]["at_risk_records"] == 1 and checks[3]["at_risk_records"] == 3
    assert checks[2]["min_class_size"] == 1


def test_l_diversity_finds_classes_with_one_value(privacy_small):
    row = privacy.l_diversity(privacy_small, QI, ["Diagnosis"]).first()
    assert (row["min_l"], row["classes_with_l1"], row["records_at_risk"], row["total_classes"]) == (1, 2, 3, 3)


def test_nulls_form_one_class_and_one_sensitive_value(spark):
    df = spark.createDataFrame([(None, None), (None, None), ("nan", "x")], "q string, s string")
    assert privacy.uniqueness(df, ["q"]).first()["equivalence_classes"] == 2
    row = privacy.l_diversity(df, ["q"], ["s"]).first()
    assert (row["classes_with_l1"], row["total_classes"]) == (2, 2)


def test_no_rows_and_no_quasi_identifiers(spark, privacy_small):
    empty = privacy_small.limit(0)
    assert privacy.uniqueness(empty, QI).first()["unique_pct"] == 0.0
    assert privacy.k_anonymity(empty, QI).count() == 0
    assert privacy.k_anonymity(privacy_small, []).count() == 0
    assert privacy.uniqueness(privacy_small, []).first()["equivalence_classes"] == 0
    assert [r["records"] for r in privacy.class_size_distribution(empty, QI).collect()] == [0] * 5


def test_distribution_counts_records(privacy_small):
    got = {r["size_bucket"]: r["records"] for r in privacy.class_size_distribution(privacy_small, QI).collect()}
    assert got == {"1": 1, "2-4": 5, "5-9": 0, "10-49": 0, "50+": 0}


def test_vulnerable_clusters_are_numbered_by_size(privacy_small):
    rows = privacy.vulnerable_clusters(privacy_small, QI, k=3).collect()
    assert [(r["cluster_id"], r["class_size"], r["risk_level"]) for r in rows] == [
        (1, 1, "CRITICAL"), (2, 2, "MODERATE")]
    assert rows[0]["total_vulnerable_clusters"] == 2


@pytest.mark.parametrize("group_count", [None, 10])
@pytest.mark.parametrize("heavy", [1, 3, 1024])
def test_attach_equals_a_plain_lookup_with_hot_and_null_keys(spark, monkeypatch, heavy, group_count):
    monkeypatch.setattr(skew, "HEAVY_GROUPS", heavy)
    rows = [(i, "hot" if i % 3 else None if i % 2 else f"k{i % 9}") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k string")
    sizes = Counter(k for _, k in rows)
    groups = privacy.equivalence_classes(df, ["k"])
    got = skew.attach(df, groups, ["k"], "class_size", ["class_size"], "inner", group_count)
    assert {r["id"]: r["class_size"] for r in got.collect()} == {i: sizes[k] for i, k in rows}
    assert got.count() == 300


def test_duplicate_flags_keep_the_smallest_key(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (5, None), (4, "x" * 500), (9, "x" * 500)],
                               "id int, t string")
    flags = {r["id"]: r["is_duplicate"] for r in frequencies.duplicate_flags(df, "id").collect()}
    assert flags == {1: False, 3: True, 2: False, 5: True, 4: False, 9: True}


def test_exact_quantiles_equal_sorted_values(spark):
    rng = np.random.default_rng(3)
    columns = {"even": rng.random(5000) * 1e6, "skewed": np.where(rng.random(5000) < 0.4, 7.0, np.exp(rng.normal(0, 9, 5000))),
               "few": rng.integers(-2, 3, 5000).astype(float), "one": np.full(5000, 4.0)}
    rows = [tuple(float(v[k]) for v in columns.values()) + (None, None if k % 3 else float(k), float("nan")) for k in range(5000)]
    df = spark.createDataFrame(rows, "even double, skewed double, few double, one double, empty double, gaps double, broken double").repartition(6)
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = quantiles.exact_quantiles(df, df.columns, shares)
    for name, values in columns.items():
        assert np.allclose(got[name], np.quantile(values, shares), rtol=1e-12), name
    assert np.allclose(got["gaps"], np.quantile(np.arange(0, 5000, 3.0), shares), rtol=1e-12)
    assert got["empty"] == got["broken"] == [None] * len(shares)
    assert quantiles.exact_quantiles(df.limit(0), ["even"], shares) == {"even": [None] * len(shares)}


def test_exact_quantiles_read_the_source_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quantiles, "materialise", lambda df: seen.append(df) or materialise(df))
    df = spark.range(1000).selectExpr("double(id) AS a", "double(id % 7) AS b", "double(id * id) AS c")
    quantiles.exact_quantiles(df, ["a", "b", "c"], [0.1, 0.25, 0.5, 0.75, 0.9])
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in seen]
    assert len(plans) == 2 and "Range (0, 1000" in plans[0] and "Range (0, 1000" not in plans[1]


def test_profile_types_and_flags(spark):
    df = spark.createDataFrame(
        [(i, f"user {i} with a rather long description text", "2024-01-%02d" % (i % 28 + 1), "a" if i % 2 else "b",
          110000 + i, None) for i in range(60)],
        "id int, note string, seen string, flag string, ZipCode int, nothing string")
    got = {r["name"]: r for r in profile.profile_columns(df).collect()}
    kinds = {c: got[c]["inferred_type"] for c in got}
    assert kinds == {"id": "numeric", "note": "text", "seen": "datetime", "flag": "categorical",
                     "ZipCode": "categorical", "nothing": "text"}
    assert got["nothing"]["missing_pct"] == 100.0 and got["nothing"]["is_constant"]
    assert got["id"]["is_high_cardinality"]


def test_classification_by_name_then_by_statistics(spark):
    df = spark.createDataFrame([(i, f"n{i}", i % 7, "x", f"z{i}", i % 3) for i in range(50)],
                               "PatientID int, FullName string, Age int, Diagnosis string, token string, PinCode int")
    rows = profile.classify_columns(profile.profile_columns(df), df.columns).collect()
    category = {r["column"]: r["category"] for r in rows}
    assert category["PatientID"] == category["FullName"] == "direct_identifier"
    assert category["Age"] == category["PinCode"] == "quasi_identifier"
    assert category["Diagnosis"] == "sensitive_attribute"
    assert category["token"] == "possible_direct_identifier" or category["token"] == "unclassified"
    assert profile.roles(rows)["sensitive"] == ["Diagnosis"]


def test_hostile_names_and_values_do_not_break_the_profile(spark):
    names = ["a.b", "drop table x; --", "[a-z]+(", "`tick`", "c" * 300, "Same", "same"]
    values = ["x" * 50_000, "\u0000\u0001", "😀é", "  ", "'", "\\", None]
    df = spark.createDataFrame([tuple(values[(i + j) % 7] for j in range(7)) for i in range(7)],
                               ", ".join(f"c{i} string" for i in range(7))).toDF(*names)
    rows = profile.profile_columns(df).collect()
    assert {r["name"] for r in rows} == set(names) and all(r["missing_count"] == 1 for r in rows)
    assert privacy.k_anonymity(df, names).count() == 4
    same = spark.createDataFrame([(1, "a")] * 10, "n int, t string")
    assert frequencies.duplicate_summary(same).first()["duplicate_rows"] == 9
