import pytest

from veilgauge.functions.columns import normalise_name
from veilgauge.operators import mitigate, privacy, profile, tradeoff


def values(df, column):
    return [r[column] for r in df.collect()]


def step(column, action, **params):
    return [{"column": column, "action": action, "params": params}]


def test_age_bands_reduce_distinct_values_and_floor_negatives(spark):
    df = spark.createDataFrame([(v,) for v in [21, 22, 24, 25, 29, -3, None]], "Age int")
    assert values(mitigate.apply_age_band(df, "Age"), "Age") == [
        "20-24", "20-24", "20-24", "25-29", "25-29", "-5--1", None]
    text = spark.createDataFrame([("31",), ("n/a",)], "Age string")
    assert values(mitigate.apply_age_band(text, "Age"), "Age") == ["30-34", None]


def test_buckets_share_their_labels(spark):
    df = spark.createDataFrame([(9999.5,), (10000.0,), (float("nan"),)], "v double")
    assert values(mitigate.apply_bucket(df, "v"), "v") == ["0-10000", "10000-20000", None]


def test_truncation_reads_float_codes_and_honours_its_parameter(spark):
    df = spark.createDataFrame([(110045.0,), (None,)], "Pincode double")
    assert values(mitigate.apply_truncation(df, "Pincode"), "Pincode") == ["110***", None]
    assert values(mitigate.apply_mitigations(df, step("Pincode", "truncation_generalization", keep_digits="4")),
                  "Pincode") == ["1100**", None]


def test_dates_generalise_from_mixed_formats(spark):
    df = spark.createDataFrame([("2026-01-05",), ("25/01/2026",), ("01-31-2026",), ("nope",), (None,)], "d string")
    assert values(mitigate.apply_date_generalisation(df, "d"), "d") == ["January 2026"] * 3 + [None, None]
    assert values(mitigate.apply_date_generalisation(df, "d", "quarter"), "d")[0] == "2026Q1"
    assert values(mitigate.apply_date_generalisation(df, "d", "year"), "d")[1] == "2026"


def test_rare_categories_become_other_and_the_column_stays(spark):
    df = spark.createDataFrame([(c,) for c in ["a"] * 5 + ["b"] * 3 + ["c", "d", None]], "City string")
    out = mitigate.apply_top_values(df, "City", 2)
    assert sorted(values(out, "City")) == sorted(["a"] * 5 + ["b"] * 3 + ["Other"] * 3)


def test_unknown_actions_and_absent_columns_change_nothing(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert mitigate.apply_mitigations(df, step("a", "unheard") + step("z", "suppression")).columns == ["a"]
    assert mitigate.apply_mitigations(df, step("a", "suppression")).columns == []


@pytest.mark.parametrize("name,words", [("AdmissionDate", "Admission Date"), ("patient_id", "patient id"),
                                        ("zip-code", "zip code")])
def test_names_are_split_into_words(name, words):
    assert normalise_name(name) == words


def test_recommendations_follow_the_column_statistics(spark):
    df = spark.createDataFrame(
        [(i % 40, "MF"[i % 2], f"1100{i:02d}", f"2024-01-{i % 28 + 1:02d}", f"city{i % 9}") for i in range(60)],
        "Age int, Gender string, Pincode string, JoinDate string, City string")
    classified = profile.classify_columns(profile.profile_columns(df), df.columns)
    got = {r["column"]: r["action"] for r in mitigate.recommend(classified).collect()}
    assert got == {"Age": "generalization_bucketing", "Pincode": "truncation_generalization",
                   "JoinDate": "date_generalization", "City": "generalization"}


def test_optimizer_agrees_with_applying_each_step_alone(spark):
    df = spark.createDataFrame([(20 + i % 17, "MF"[i % 2], f"c{i % 11}", i) for i in range(90)],
                               "age int, g string, city string, score int")
    qi = ["age", "g", "city"]
    steps = (step("age", "generalization_bucketing") + step("city", "generalization", keep_top_n=3)
             + step("city", "suppression") + step("score", "bucketing", bucket_size=10))
    got = {(r["column"], r["action"]): r for r in tradeoff.optimize(df, steps, qi).collect()}
    risk = lambda t: privacy.k_anonymity(t, [c for c in qi if c in t.columns], [5]).first()["at_risk_pct"]
    before = risk(df)
    for s in steps:
        after = mitigate.apply_mitigations(df, [s])
        kept = after.select(s["column"]).distinct().count() if s["column"] in after.columns else 0
        had = df.select(s["column"]).distinct().count()
        row = got[(s["column"], s["action"])]
        assert row["risk_reduction_pct"] == pytest.approx(max(0, before - risk(after)), abs=0.01)
        assert row["utility_loss_pct"] == pytest.approx((1 - kept / had) * 100, abs=0.01)
    ranked = [r["weighted_score"] for r in tradeoff.optimize(df, steps, qi).collect()]
    assert ranked == sorted(ranked, reverse=True)
