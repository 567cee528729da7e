import pytest

from veilgauge.plans import analysis, report, rescue
from veilgauge.sources import files
from veilgauge.sources.catalog import Catalog


@pytest.fixture(scope="module")
def messy(spark):
    rows = [(f"P{i:03d}", 20 + i, "Male" if i % 2 == 0 else "Female", f"11000{i}", "Flu") for i in range(30)]
    return spark.createDataFrame(rows + rows[:5],
                                 "PatientID string, Age int, Gender string, Pincode string, Diagnosis string")


@pytest.fixture(scope="module")
def plan(messy):
    return rescue.make_plan(messy, "job")


def decide(spark, plan, rejected=(), alternative=None):
    rows = [(r["action_id"], "rejected" if r["action_type"] in rejected else "approved")
            for r in plan.actions.collect() if r["policy"] == "REVIEW"]
    if alternative:
        rows += [(r[0] + "-alt", alternative) for r in rows if r[1] == "rejected"]
    return spark.createDataFrame(rows, "action_id string, decision string")


def test_plan_proposes_the_duplicate_fix_and_privacy_steps(plan):
    rows = {r["action_type"]: r for r in plan.actions.collect()}
    assert rows["drop_exact_duplicates"]["policy"] == "AUTO"
    assert rows["truncation_generalization"]["policy"] == "REVIEW"
    assert [r["affected_rows"] for r in plan.before.issues.collect() if r["issue_type"] == "duplicate_rows"] == [5]


def test_rescue_improves_and_writes_a_new_version(spark, messy, plan, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "lake"))
    source = catalog.save(messy, "messy")
    done = rescue.apply_plan(messy, plan, decide(spark, plan), catalog=catalog, parent_id=source)
    assert done.after.first()["quality_score"] >= done.before.first()["quality_score"]
    assert done.verification.first()["passed"] and catalog.load(done.dataset_id).count() == 30
    assert catalog.lookup(done.dataset_id).first()["parent_id"] == source
    assert catalog.load(source).count() == 35
    text = [r["value"] for r in report.markdown(report.rescue_report("job", done), "Rescue").collect()]
    assert text[0] == "# Rescue" and any(line.startswith("- rescue_score:") for line in text)


def test_rejection_offers_a_milder_step_that_is_really_applied(spark, messy, plan):
    said = decide(spark, plan, rejected=("truncation_generalization",), alternative="approved")
    resolved = rescue.resolve(plan.actions, said)
    alternative = [a for a in resolved if a["action_id"].endswith("-alt")]
    assert len(alternative) == 1 and alternative[0]["params"]["keep_digits"] == "4"
    assert [a["status"] for a in resolved if a["action_type"] == "truncation_generalization"] == ["rejected", "applied"]
    codes = {r["Pincode"] for r in rescue.execute(messy, resolved).select("Pincode").collect()}
    assert all(c.startswith("1100") and c[4:].strip("*") == "" for c in codes)


def test_undecided_steps_are_skipped(messy, plan):
    resolved = rescue.resolve(plan.actions, None)
    assert {a["status"] for a in resolved if a["policy"] == "REVIEW"} == {"timeout"}
    assert rescue.execute(messy, resolved).columns == messy.columns


def test_a_harmful_plan_is_rolled_back(spark, messy, plan):
    # Suppressing everything else leaves one constant column: less healthy than before.
    schema = rescue.ACTION
    harm = [(i, f"x{i}", "privacy", "suppression", c, {"column": c}, "AUTO", "", "", "", "pending")
            for i, c in enumerate(messy.columns[:4], start=1)]
    bad = rescue.RescuePlan("bad", plan.before, spark.createDataFrame(harm, schema))
    healthy = rescue.Assessment(plan.before.analysis, plan.before.issues, plan.before.findings,
                                spark.createDataFrame([(99.0, 99.0, 1.0, "LOW", 99.0, 99.0)],
                                                      plan.before.metrics.schema))
    done = rescue.apply_plan(messy, rescue.RescuePlan("bad", healthy, bad.actions))
    row = done.verification.first()
    assert not row["passed"] and row["rescue_score"] == 0.0 and row["health_after"] == row["health_before"]
    assert done.table.columns == messy.columns and done.table.count() == 35


def test_safe_data_gets_no_privacy_steps(spark):
    rows = [(f"R{i:03d}", ["18-30", "31-50", "51-70"][i % 3], ["North", "South"][i % 2]) for i in range(200)]
    plan = rescue.make_plan(spark.createDataFrame(rows, "RecordID string, AgeBand string, Region string"), "safe")
    assert plan.before.metrics.first()["privacy_risk_level"] == "LOW"
    assert plan.actions.where("source = 'privacy'").isEmpty()


def test_unknown_actions_need_review(spark):
    df = spark.createDataFrame([("trim_whitespace",), ("invented",)], "action_type string")
    assert {r["action_type"]: r["policy"] for r in rescue.with_policy(df).collect()} == {
        "trim_whitespace": "AUTO", "invented": "REVIEW"}


def test_fix_and_retest_lowers_the_risk(spark, messy):
    aux = messy.selectExpr("PatientID as name", "Age", "Gender", "Pincode").distinct()
    steps = [{"column": "Age", "action": "generalization_bucketing"},
             {"column": "Pincode", "action": "truncation_generalization"}]
    _, after, compared = analysis.fix_and_retest(messy, steps, aux, "PatientID", "name")
    row = compared.first()
    assert row["risk_score_delta"] > 0 and row["at_risk_records_after"] <= row["at_risk_records_before"]
    made = report.privacy_report("messy", after, comparison=compared)
    assert made.where("metric = 'risk_score_delta'").count() == 1


def test_catalog_keeps_history_and_shows_the_latest(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))
    assert catalog.audit_tail().count() == 0 and catalog.jobs().count() == 0
    for n in (1, 2):
        catalog.save_analysis("d", "risk", {"score": n})
        catalog.save_job("j", "d", f"step{n}", {"n": n})
    catalog.save_analysis("d", "attack", {"score": 9})
    assert catalog.latest_analysis("d", "risk").first()["result_json"] == '{"score": 2}'
    assert catalog.latest_analyses().count() == 2
    assert [r["status"] for r in catalog.jobs().collect()] == ["step2"]
    catalog.log("d", "look")
    assert catalog.audit_tail("d").first()["action"] == "look" and catalog.audit_tail("other").count() == 0
    with pytest.raises(KeyError):
        catalog.load("missing")


def test_compacted_logs_lose_and_repeat_nothing(spark, tmp_path, monkeypatch):
    catalog = Catalog(spark, str(tmp_path / "c"))
    catalog.compact("audit_log")
    for n in range(5):
        catalog.log("d", f"step{n}")
    # A crash before the old files go: they are still there, and are not read.
    files = lambda: [f for f in (tmp_path / "c" / "_audit_log").iterdir() if f.suffix == ".parquet"]
    with monkeypatch.context() as patch:
        patch.setattr(Catalog, "_delete", lambda self, name, files: None)
        catalog.compact("audit_log")
    assert len(files()) == 6 and catalog.table("audit_log").count() == 5
    catalog.log("d", "later")
    catalog.compact("audit_log")
    assert len(files()) == 1
    catalog.log("d", "last")
    told = sorted(r["action"] for r in catalog.table("audit_log").collect())
    assert told == ["last", "later", "step0", "step1", "step2", "step3", "step4"]
    assert catalog.table("audit_log").columns == ["id", "dataset_id", "action", "detail", "created_at"]


def test_decisions_of_other_plans_stay_out(spark, plan):
    others = spark.createDataFrame([("other-a1", "approved")], "action_id string, decision string")
    said = decide(spark, plan, rejected=("truncation_generalization",), alternative="approved")
    assert rescue.resolve(plan.actions, said.unionByName(others)) == rescue.resolve(plan.actions, said)


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, "ü")], "n int, t string")
    files.write_csv(df, str(tmp_path / "out"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "out")).collect())) == [(1, "a,b"), (2, "ü")]
    (tmp_path / "blank.csv").write_text(",x\n1,2\n")
    blank = files.read_csv(spark, str(tmp_path / "blank.csv"))
    assert all(c.strip() for c in blank.columns) and blank.count() == 1
    with pytest.raises(ValueError):
        files.require_rows(df.limit(0))
    spark.createDataFrame([(float("nan"),)], "v double").write.parquet(str(tmp_path / "p"))
    assert files.read_parquet(spark, str(tmp_path / "p")).first()["v"] is None
