"""Reports as long tables ``(section, position, metric, value)``, and their Markdown text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgauge.functions.columns import ref
from veilgauge.plans.analysis import Analysis
from veilgauge.plans.rescue import Rescue

ROW = "section string, position int, metric string, value string"
DISCLAIMER = ("A technical risk assessment under the configured attack only. It does not certify that a table "
              "cannot be re-identified.")


def _rows(frame: DataFrame, section: str, metrics: dict[str, str], start: int = 0) -> DataFrame:
    """Columns of a one-row frame as report rows."""
    cells = F.array(*[F.struct(F.lit(section).alias("section"), F.lit(start + i).alias("position"),
                               F.lit(label).alias("metric"), ref(c).cast("string").alias("value"))
                      for i, (c, label) in enumerate(metrics.items())])
    return frame.select(F.explode(cells).alias("r")).select("r.*")


def privacy_report(name: str, analysis: Analysis, recommended: DataFrame | None = None,
                   comparison: DataFrame | None = None) -> DataFrame:
    """Every computed number of a privacy analysis, by section."""
    spark = analysis.risk.sparkSession
    table = analysis.stats.agg(F.max("row_count").alias("rows"), F.count(F.lit(1)).alias("columns"))
    listed = [(label, ",".join(analysis.roles[role])) for role, label in
              (("direct", "direct_identifiers"), ("quasi", "quasi_identifiers"), ("sensitive", "sensitive_attributes"))]
    parts = [
        spark.createDataFrame([("summary", 0, "dataset", name)], ROW),
        _rows(table, "summary", {"rows": "rows", "columns": "columns"}, 1),
        _rows(analysis.risk, "summary", {"overall_score": "overall_risk_score", "risk_level": "overall_risk_level"}, 3),
        spark.createDataFrame([("findings", i, m, v) for i, (m, v) in enumerate(listed)], ROW),
        _rows(analysis.risk, "findings", {"min_class_size": "min_class_size", "unique_pct": "unique_records_pct"}, 3),
        _rows(analysis.risk, "risk_breakdown", {
            "linkage_component": "linkage_confidence", "uniqueness_component": "uniqueness",
            "equivalence_component": "equivalence_class_risk", "sensitive_component": "sensitive_attribute_exposure"}),
    ]
    if analysis.linkage_summary is not None:
        parts.append(_rows(analysis.linkage_summary, "attack", {
            c: c for c in ("shared_columns", "candidates_tested", "matches_found", "highest_confidence")}))
    if recommended is not None:
        parts.append(recommended.select(
            F.lit("recommendations").alias("section"), F.col("ordinal").alias("position"),
            F.col("column").alias("metric"), F.col("action").alias("value")))
    if comparison is not None:
        parts.append(_rows(comparison, "before_after", {c: c for c in comparison.columns}))
    parts.append(spark.createDataFrame([("disclaimer", 0, "text", DISCLAIMER)], ROW))
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


STATUS_LABELS = {"applied": "applied", "rejected": "rejected_by_human", "timeout": "skipped_no_response",
                 "pending": "still_pending"}
ACTION_SECTIONS = {"applied": "applied_actions", "rejected": "rejected_actions", "timeout": "skipped_actions",
                   "pending": "pending_actions"}


def rescue_report(plan_id: str, rescue: Rescue) -> DataFrame:
    """Problems found, actions by status with their columns, health and privacy before and after, verification and utility."""
    spark = rescue.actions.sparkSession
    order = F.create_map(*[F.lit(x) for i, s in enumerate(STATUS_LABELS) for x in (s, i + 1)])
    names = F.create_map(*[F.lit(x) for s, n in STATUS_LABELS.items() for x in (s, n)])
    by_status = rescue.actions.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("decisions").alias("section"), order[F.col("status")].alias("position"),
        names[F.col("status")].alias("metric"), F.col("n").cast("string").alias("value"))
    total = rescue.actions.agg(F.count(F.lit(1)).alias("total_proposed"))
    sections = F.create_map(*[F.lit(x) for s, n in ACTION_SECTIONS.items() for x in (s, n)])
    by_action = rescue.actions.select(
        sections[F.col("status")].alias("section"), F.col("seq").alias("position"),
        F.col("action_type").alias("metric"), F.coalesce("column", F.lit("the dataset")).alias("value"))
    columns = F.when(F.size("columns") > 0, F.concat_ws(",", "columns")).otherwise("the dataset")
    problems = rescue.problems.select(
        F.lit("problems").alias("section"), (F.col("detector") * 1000 + F.col("ordinal")).cast("int").alias("position"),
        F.col("issue_type").alias("metric"), F.concat(F.col("severity"), F.lit(": "), columns).alias("value"))
    privacy = [_rows(frame, "privacy_assessment", {"privacy_risk_score": f"risk_score_{when}", "privacy_risk_level": f"risk_level_{when}"}, start)
               for start, (frame, when) in enumerate(((rescue.before, "before"), (rescue.after, "after")))]
    measured = {c: c for c in ("quality_score", "ml_readiness_score", "privacy_risk_score", "privacy_risk_level",
                               "data_health")}
    return _union([
        spark.createDataFrame([("summary", 0, "plan", plan_id)], ROW),
        _rows(rescue.verification, "summary", {"health_before": "data_health_before",
                                               "health_after": "data_health_after",
                                               "rescue_score": "rescue_score", "passed": "verification_passed"}, 1),
        _rows(total, "decisions", {"total_proposed": "total_proposed"}),
        by_status, by_action, problems, *privacy,
        _rows(rescue.before, "before", measured), _rows(rescue.after, "after", measured),
        _rows(rescue.utility, "utility", {c: c for c in rescue.utility.columns}),
    ])


def markdown(report: DataFrame, title: str) -> DataFrame:
    """One text line per report row under a heading per section, ready for ``write.text``."""
    label = F.initcap(F.replace(F.col("section"), F.lit("_"), F.lit(" ")))
    lines = report.select(
        "section", "position", F.format_string("- %s: %s", "metric", F.coalesce("value", F.lit("none"))).alias("line"))
    heads = report.select("section").distinct().select(
        "section", F.lit(-1).alias("position"), F.concat(F.lit("## "), label).alias("line"))
    first = report.sparkSession.range(1).select(
        F.lit("").alias("section"), F.lit(-2).alias("position"), F.lit(f"# {title}").alias("line"))
    return first.unionByName(heads).unionByName(lines).orderBy("section", "position", "line").select(
        F.col("line").alias("value"))
