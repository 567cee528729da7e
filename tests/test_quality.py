import math

import pytest
from pyspark.sql import functions as F

from veilgauge.functions import dates
from veilgauge.operators import faults, fixes, ml, quality, scores
from veilgauge.operators.frequencies import column_statistics


def issues(df):
    return {r["issue_type"]: r for r in quality.quality_issues(df).collect()}


def test_one_dirty_table_shows_every_kind_of_issue(spark):
    rows = [(float(i) if i % 7 else None, ["Male", "MALE", "male", "Female"][i % 4],
             "  padded " if i == 3 else f"plain{i}", "2024-01-05" if i % 4 else "bad", 1, 10_000.0 if i == 30 else 1.0 + i)
            for i in range(40)]
    rows += rows[:2]
    df = spark.createDataFrame(rows, "A double, Gender string, Name string, AdmissionDate string, Source int, Value double")
    got = issues(df)
    assert got["missing_values"]["columns"] == ["A"] and got["missing_values"]["affected_rows"] == 7
    assert got["missing_values"]["suggested_action"] == "impute_missing_median"
    assert got["duplicate_rows"]["affected_rows"] == 2 and got["duplicate_rows"]["auto_fix_eligible"]
    assert got["whitespace"]["affected_rows"] == 1
    assert got["case_inconsistency"]["columns"] == ["Gender"]
    assert got["malformed_dates"]["affected_rows"] == 11
    assert got["constant_column"]["columns"] == ["Source"]
    assert got["outliers"]["affected_rows"] == 1 and got["outliers"]["columns"] == ["Value"]
    assert got["possible_unit_inconsistency"]["confidence"] == 0.35


def test_clean_and_empty_tables_have_no_issues(spark):
    clean = spark.createDataFrame([(i % 9, f"v{i % 9}") for i in range(9)], "n int, t string")
    assert set(issues(clean)) <= {"high_cardinality_column"}
    assert not {"missing_values", "duplicate_rows", "outliers"} & set(issues(clean.limit(0)))


def test_fixes_keep_nulls_and_do_what_the_detectors_expect(spark):
    df = spark.createDataFrame([(" a ", None, "25/12/2024", 1.0), ("TYPE-A b", 4.0, "12-25-2024", 2.0),
                                (None, 2.0, "later", 3.0), ("x1 y", 3.0, None, 1e9)],
                               "t string, n double, d string, o double")
    column = lambda f, c: [r[c] for r in f.collect()]
    assert column(fixes.trim_whitespace(df, "t"), "t") == ["a", "TYPE-A b", None, "x1 y"]
    assert column(fixes.standardize_case(df, "t"), "t")[1:] == ["Type-a B", None, "x1 y"]
    assert column(fixes.standardize_date_format(df, "d"), "d") == ["2024-12-25", "2024-12-25", None, None]
    assert column(fixes.impute_missing_median(df, "n"), "n") == [3.0, 4.0, 2.0, 3.0]
    wide = spark.createDataFrame([(float(v),) for v in list(range(50)) + [10_000]] + [(None,)], "v double")
    assert fixes.remove_outliers(wide, "v").count() == 51
    modes = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "m string")
    assert column(fixes.impute_missing_mode(modes, "m"), "m").count("a") == 3
    assert fixes.apply_fix(df, "unheard", "t") is df


def test_readiness_findings(spark):
    rows = [(i, 2 * i + 1, "const", f"id{i}", "yes" if i % 20 else "no", 3 * i) for i in range(1, 100)]
    df = spark.createDataFrame(rows + rows[:1], "A int, B int, C string, ID string, label string, Target int")
    found = ml.ml_findings(df, "label").collect()
    kinds = {r["check"] for r in found}
    assert {"constant_feature", "duplicate_observations", "high_cardinality_categorical",
            "suspicious_correlation", "class_imbalance"} <= kinds
    leaks = {tuple(r["columns"]) for r in ml.target_checks(df, "Target").collect()
             if r["check"] == "possible_target_leakage"}
    assert leaks == {("A", "Target"), ("B", "Target")}
    assert ml.target_checks(df, "nope").first()["check"] == "target_not_found"
    sparse = spark.createDataFrame([(1, None), (None, None), (2, None)], "a int, b int")
    assert {r["check"]: r["severity"] for r in ml.ml_findings(sparse, "a").collect()}["high_sparsity"] == "HIGH"


def test_correlation_handles_nulls_and_constants(spark):
    rows = [(float(i), float(i * i), 7.0, float(-i) if i % 3 else None, 1e9 + i) for i in range(30)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    got = {(r["column_a"], r["column_b"]): r["correlation"] for r in ml.correlation_pairs(df).collect()}
    frame = df.toPandas()
    for (a, b), value in got.items():
        want = frame[a].corr(frame[b])
        assert value is None if math.isnan(want) else value == pytest.approx(want, abs=1e-9)


def test_scores(spark):
    inputs = "highest_confidence double, unique_pct double, k5_at_risk_pct double, sensitive_pct double"
    one = lambda *v: scores.risk_score(spark.createDataFrame([v], inputs))
    assert one(0.95, 80.0, 90.0, 20.0).first()["overall_score"] > 70
    assert one(0.0, 5.0, 5.0, 5.0).first()["risk_level"] == "LOW"
    assert one(1.0, 100.0, 100.0, 100.0).first()["overall_score"] == 100.0
    halves = {"linkage_confidence": 0.5, "uniqueness": 0.5, "equivalence_class_risk": 0.0,
              "sensitive_attribute_exposure": 0.0}
    row = scores.risk_score(spark.createDataFrame([(0.5, 50.0, None, 0.0)], inputs), halves).first()
    assert row["overall_score"] == 50.0 and row["equivalence_component"] == 50.0
    pairs = [(70.0, 50.0), (50.0, 100.0), (50.0, 75.0), (100.0, 100.0)]
    got = scores.rescue_score(spark.createDataFrame(pairs, "health_before double, health_after double"))
    assert [r["rescue_score"] for r in got.collect()] == [0.0, 100.0, 50.0, 100.0]


def test_injected_faults_are_found_again(spark):
    df = spark.range(400).select(
        F.col("id"), (F.col("id") % 37).cast("int").alias("age"), F.lit("Alpha").alias("label"),
        F.concat(F.lit("t"), F.col("id")).alias("note"), F.expr("date_add(date'2024-01-01', cast(id % 90 as int))")
        .alias("seen_date"))
    dirty = faults.inject_quality_faults(df, "id")
    assert {"missing_values", "duplicate_rows", "whitespace", "case_inconsistency", "malformed_dates",
            "constant_column"} <= set(issues(dirty))
    assert dirty.exceptAll(faults.inject_quality_faults(df, "id")).isEmpty()
    aux = faults.derive_auxiliary(df, "id", ["label"], "age")
    known = aux.where(F.col("id") < 400)
    assert 200 < known.count() < 360 and aux.count() > known.count()
    off = known.join(df.select("id", F.col("age").alias("true_age")), "id")
    assert off.where(F.abs(F.col("age") - F.col("true_age")) > 1).isEmpty()


def test_strangers_draw_from_all_values(spark):
    """Every value can occur, rare ones too, about as often as in the table; nulls are never drawn."""
    rows = [(i, 30 + i % 9, "common" if i % 3 == 0 else f"rare{i}" if i % 3 == 1 else None, None) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, age int, label string, empty string")
    strangers = faults.derive_auxiliary(df, "id", ["label", "empty"], "age", coverage=0.0, noise=100.0)
    drawn = [r.label for r in strangers.collect()]
    assert len(drawn) == 3000 and None not in drawn
    rare = {v for v in drawn if v != "common"}
    assert len(rare) > 600 and 1300 < drawn.count("common") < 1700
    assert strangers.where("empty is not null").isEmpty() and strangers.where(F.col("id") < faults.NOISE_KEY_OFFSET).isEmpty()
    again = faults.derive_auxiliary(df.repartition(7), "id", ["label", "empty"], "age", coverage=0.0, noise=100.0)
    assert sorted(map(str, again.collect())) == sorted(map(str, strangers.collect()))


def test_an_infinity_correlates_with_nothing(spark):
    rows = [(float(i % 7), float(i * 31 % 11), math.inf if i == 3 else float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["column_a"], r["column_b"]): r["correlation"] for r in ml.correlation_pairs(df).collect()}
    assert got["a", "c"] is None and got["b", "c"] is None and abs(got["a", "b"]) < 0.5
    assert not [r for r in ml.ml_findings(df, "c").collect() if "correlation" in r["check"] or "leakage" in r["check"]]


def test_long_padding_hides_no_label(spark):
    df = spark.createDataFrame([("abc",), (" " * 200 + "Abc",), ("xyz",), (" " * 60 + "2024-01-05" + "\t" * 90,)], "t string")
    row = column_statistics(df).first()
    assert (row["stripped_unique"], row["folded_unique"], row["parsed_rows"]) == (4, 3, 1)


@pytest.mark.parametrize("value, want", [
    ("01/02/24", "2024-01-02 00:00:00"), ("1/2/2024 10:30", "2024-01-02 10:30:00"), ("01/02/2024 10:30 AM", "2024-01-02 10:30:00"),
    ("01/02/2024 12:05 am", "2024-01-02 00:05:00"), ("01/02/2024 1:05:09 PM", "2024-01-02 13:05:09"),
    ("2024-01-01T10:00:00.123Z", "2024-01-01 10:00:00.123000"), ("2024-01-01T10:00:00+05:30", "2024-01-01 04:30:00"),
    ("20240101", "2024-01-01 00:00:00"), ("5-Jan-2024", "2024-01-05 00:00:00"), ("Jan 05 2024 10:00", "2024-01-05 10:00:00"),
    ("\t2024-01-05\t", "2024-01-05 00:00:00"), ("31/12/99", "1999-12-31 00:00:00"), ("2024-01-05 25:00", None),
    ("2024-13-45", None), ("12:30", None), ("99999999", None), ("", None), (None, None), ("not-a-date", None)])
def test_mixed_dates(spark, value, want):
    got = spark.createDataFrame([(value,)], "t string").select(dates.parse_mixed(F.col("t")).alias("d")).first()["d"]
    assert (got and str(got)) == want
