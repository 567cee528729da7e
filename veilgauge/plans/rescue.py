"""Plan, apply and verify a rescue of one table, in two restartable batch steps.

``make_plan`` measures the table and proposes actions. ``apply_plan`` takes the
plan and a table of human decisions, applies what is allowed, measures again
and keeps the result only if the data got healthier. State lives in tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgauge import settings
from veilgauge.functions.columns import nan_to_null
from veilgauge.operators import evaluate, frequencies, mitigate, ml, quality, scores
from veilgauge.operators.fixes import FIXES, apply_fix
from veilgauge.plans.analysis import Analysis, full_analysis
from veilgauge.session import materialise, pin
from veilgauge.sources.catalog import Catalog

ACTION = ("seq int, action_id string, source string, action_type string, column string, "
          "params map<string,string>, policy string, description string, reason string, "
          "expected_benefit string, status string")
ACTIONABLE_LEVELS = ("MODERATE", "HIGH", "CRITICAL")
METRICS = ("quality_score double, ml_readiness_score double, privacy_risk_score double, "
           "privacy_risk_level string")


@dataclass
class Assessment:
    analysis: Analysis
    issues: DataFrame
    findings: DataFrame
    metrics: DataFrame

    @property
    def health(self) -> float:
        return self.metrics.first()["data_health"]


def assess(df: DataFrame, aux: DataFrame | None = None, key: str | None = None, aux_key: str | None = None,
           target: str | None = None) -> Assessment:
    """Quality, privacy and ML readiness of one table, measured the same way before and after."""
    df = nan_to_null(df)
    analysis = full_analysis(df, aux, key, aux_key, diversity=False)
    duplicates = pin(frequencies.duplicate_summary(df))
    issues = pin(quality.issues_from(analysis.stats, duplicates, pin(quality.numeric_facts(df))))
    findings = pin(ml.findings_from(df, analysis.stats, duplicates, target))
    risk = analysis.risk.first()
    row = (scores.quality_score(issues).first()["score"], scores.ml_score(findings).first()["score"],
           risk["overall_score"], risk["risk_level"])
    metrics = scores.data_health(df.sparkSession.createDataFrame([row], METRICS))
    return Assessment(analysis, issues, findings, pin(metrics))


def with_policy(actions: DataFrame, policy: dict[str, str] | None = None) -> DataFrame:
    """Attach AUTO or REVIEW by action type; an unknown action is never automatic.

    The policy table has one row per known action type, so it is broadcast.
    """
    table = actions.sparkSession.createDataFrame(
        list((policy or settings.POLICY).items()), "action_type string, __policy string")
    joined = actions.drop("policy").join(F.broadcast(table), "action_type", "left")
    return joined.withColumn("policy", F.coalesce("__policy", F.lit(settings.POLICY_DEFAULT))).drop("__policy")


def proposals(issues: DataFrame, recommended: DataFrame | None, plan_id: str,
              include_review_fixes: bool = False) -> DataFrame:
    """Action rows from quality issues and, where given, privacy recommendations; numbered in issue order."""
    known = [*FIXES, "drop_exact_duplicates"]
    wanted = F.col("suggested_action").isNotNull() & F.col("auto_fix_eligible")
    if include_review_fixes:
        wanted = F.col("suggested_action").isin(known)
    fixes = issues.where(wanted).select(
        F.lit(0).alias("part"), F.col("detector"), F.col("ordinal"), F.lit("quality").alias("source"),
        F.col("suggested_action").alias("action_type"), F.try_element_at("columns", F.lit(1)).alias("column"),
        F.col("action_params").alias("params"), "description", F.col("description").alias("reason"),
        F.format_string("Resolves a %s severity %s issue.", "severity", "issue_type").alias("expected_benefit"))
    both = fixes
    if recommended is not None:
        both = fixes.unionByName(recommended.select(
            F.lit(1).alias("part"), F.lit(0).alias("detector"), "ordinal", F.lit("privacy").alias("source"),
            F.col("action").alias("action_type"), "column",
            F.create_map(F.lit("column"), F.col("column")).alias("params"), "description", "reason",
            F.lit("Lowers the re-identification risk of this column.").alias("expected_benefit")))
    # At most a few rows per column: numbering them as one sorted array is metadata-sized.
    listed = both.agg(F.sort_array(F.collect_list(F.struct(
        "part", "detector", "ordinal", "source", "action_type", "column",
        F.map_entries("params").alias("params"), "description", "reason", "expected_benefit"))).alias("rows"))
    numbered = listed.select(F.posexplode("rows").alias("pos", "r"))
    seq = F.col("pos") + 1
    return with_policy(numbered.select(
        seq.alias("seq"), F.concat(F.lit(plan_id + "-a"), seq.cast("string")).alias("action_id"),
        "r.source", "r.action_type", "r.column", F.map_from_entries("r.params").alias("params"),
        "r.description", "r.reason", "r.expected_benefit", F.lit("pending").alias("status"),
    )).select("seq", "action_id", "source", "action_type", "column", "params", "policy", "description",
              "reason", "expected_benefit", "status")


@dataclass
class RescuePlan:
    plan_id: str
    before: Assessment
    actions: DataFrame


def make_plan(df: DataFrame, plan_id: str, aux: DataFrame | None = None, key: str | None = None,
              aux_key: str | None = None, target: str | None = None, include_review_fixes: bool = False) -> RescuePlan:
    """Measure and propose; privacy actions only if the risk is at least moderate."""
    before = assess(df, aux, key, aux_key, target)
    level = before.metrics.first()["privacy_risk_level"]
    recommended = mitigate.recommend(before.analysis.classified) if level in ACTIONABLE_LEVELS else None
    return RescuePlan(plan_id, before, pin(proposals(before.issues, recommended, plan_id, include_review_fixes)))


def milder(action: dict) -> dict | None:
    """The documented gentler variant of a rejected action, if there is one."""
    change = settings.MILDER.get(action["action_type"])
    if change is None:
        return None
    params = {**(action["params"] or {}), **{k: str(v) for k, v in change.items()}}
    shown = ", ".join(f"{k}={v}" for k, v in change.items())
    return {**action, "action_id": action["action_id"] + "-alt", "params": params, "policy": "REVIEW",
            "description": f"Milder alternative: {action['action_type']} with {shown}",
            "reason": "Offered after the original proposal was rejected.",
            "expected_benefit": "Costs less utility than the rejected version.", "status": "pending"}


def _apply(df: DataFrame, action: dict) -> DataFrame:
    if action["source"] == "quality":
        return apply_fix(df, action["action_type"], action["column"])
    return mitigate.apply_mitigations(df, [{"column": action["column"], "action": action["action_type"],
                                            "params": action["params"]}])


def resolve(actions: DataFrame, decisions: DataFrame | None) -> list[dict]:
    """Final action list: every action with its status, alternatives included (plan-sized, on the driver)."""
    rows = sorted((r.asDict() for r in actions.collect()), key=lambda r: r["seq"])
    said = {}
    if decisions is not None:
        # A table of decisions may hold those of many plans; only this plan's reach the driver.
        ids = [(x,) for r in rows for x in (r["action_id"], r["action_id"] + "-alt")]
        mine = decisions.join(F.broadcast(actions.sparkSession.createDataFrame(ids, "action_id string")), "action_id", "left_semi")
        said = {r["action_id"]: r["decision"] for r in mine.select("action_id", "decision").distinct().collect()}
    verdict = {"approved": "applied", "rejected": "rejected"}
    out = []
    for action in rows:
        if action["policy"] == "AUTO":
            out.append({**action, "status": "applied"})
            continue
        action["status"] = verdict.get(said.get(action["action_id"]), "timeout")
        out.append(action)
        alternative = milder(action) if action["status"] == "rejected" else None
        if alternative:
            alternative["status"] = verdict.get(said.get(alternative["action_id"]), "timeout")
            out.append(alternative)
    return [{**a, "seq": i} for i, a in enumerate(out, start=1)]


def execute(df: DataFrame, resolved: list[dict]) -> DataFrame:
    """Fold all applied actions into one lazy table: AUTO first, then REVIEW.

    Duplicates go after trimming and recasing, so copies that only differed in
    spelling are caught as well.
    """
    applied = [a for a in resolved if a["status"] == "applied"]
    automatic = [a for a in applied if a["policy"] == "AUTO"]
    ordered = ([a for a in automatic if a["action_type"] != "drop_exact_duplicates"]
               + [a for a in automatic if a["action_type"] == "drop_exact_duplicates"]
               + [a for a in applied if a["policy"] != "AUTO"])
    for action in ordered:
        df = _apply(df, action)
    return df


@dataclass
class Rescue:
    table: DataFrame
    actions: DataFrame
    before: DataFrame
    after: DataFrame
    verification: DataFrame
    utility: DataFrame
    dataset_id: str | None
    problems: DataFrame


def apply_plan(df: DataFrame, plan: RescuePlan, decisions: DataFrame | None = None, aux: DataFrame | None = None,
               key: str | None = None, aux_key: str | None = None, target: str | None = None,
               catalog: Catalog | None = None, name: str = "rescued", parent_id: str | None = None) -> Rescue:
    """Apply, re-measure, verify; a result less healthy than the original is rolled back."""
    spark = df.sparkSession
    resolved = resolve(plan.actions, decisions)
    candidate, _ = materialise(execute(df, resolved))
    after = assess(candidate, aux, key, aux_key, target)
    before_health, after_health = plan.before.health, after.health
    passed = after_health >= before_health
    kept, final = (candidate, after) if passed else (df, plan.before)
    verification = scores.rescue_score(spark.createDataFrame(
        [(passed, before_health, after_health, final.health)],
        "passed boolean, health_before double, health_measured double, health_after double"))
    utility = evaluate.utility_retained(plan.before.analysis.stats, final.analysis.stats)
    dataset_id = None
    if catalog is not None:
        dataset_id = catalog.save(kept, name, parent_id)
        catalog.log(dataset_id, "rescue", f"plan={plan.plan_id}, rolled_back={not passed}")
    fields = [f.strip().split(" ")[0] for f in ACTION.replace("map<string,string>", "map").split(",")]
    actions = spark.createDataFrame([tuple(a[f] for f in fields) for a in resolved], ACTION)
    return Rescue(kept, actions, plan.before.metrics, final.metrics, pin(verification), pin(utility), dataset_id,
                  plan.before.issues)
