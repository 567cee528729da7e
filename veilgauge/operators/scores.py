"""Scores in 0..100: re-identification risk, quality, ML readiness and their composite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgauge import settings
from veilgauge.functions.ladders import risk_band


def _clamp(score: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 2)


def risk_score(inputs: DataFrame, weights: dict | None = None) -> DataFrame:
    """Risk of one-row inputs ``highest_confidence, unique_pct, k5_at_risk_pct, sensitive_pct``.

    Without a k=5 check (no quasi-identifiers) uniqueness stands in for it.
    """
    w = weights or settings.RISK_WEIGHTS
    link = F.round(F.coalesce("highest_confidence", F.lit(0.0)) * 100.0, 2)
    unique = F.round(F.coalesce("unique_pct", F.lit(0.0)), 2)
    classes = F.round(F.coalesce("k5_at_risk_pct", unique), 2)
    exposure = F.round(F.coalesce("sensitive_pct", F.lit(0.0)), 2)
    parts = inputs.withColumns({
        "linkage_component": link, "uniqueness_component": unique,
        "equivalence_component": classes, "sensitive_component": exposure,
    })
    total = (F.lit(w["linkage_confidence"]) * F.col("linkage_component")
             + F.lit(w["uniqueness"]) * F.col("uniqueness_component")
             + F.lit(w["equivalence_class_risk"]) * F.col("equivalence_component")
             + F.lit(w["sensitive_attribute_exposure"]) * F.col("sensitive_component"))
    return parts.withColumn("overall_score", _clamp(total)).withColumn("risk_level", risk_band(F.col("overall_score")))


def _bucketed(findings: DataFrame, label: str, buckets: dict, weights: dict, count: str) -> DataFrame:
    points = F.create_map(*[F.lit(x) for k, v in settings.SEVERITY_POINTS.items() for x in (k, float(v))])
    weight = F.coalesce(F.try_element_at(points, F.col("severity")), F.lit(10.0)) * F.col("confidence")
    sums = {b: F.round(F.least(F.lit(100.0), F.coalesce(
        F.sum(F.when(F.col(label).isin(members), weight)), F.lit(0.0))), 2) for b, members in buckets.items()}
    wide = findings.agg(*[s.alias(f"{b}_penalty") for b, s in sums.items()], F.count(F.lit(1)).alias(count))
    total = sum((F.lit(weights[b]) * F.col(f"{b}_penalty") for b in buckets), F.lit(0.0))
    return wide.withColumn("score", _clamp(F.lit(100.0) - total))


def quality_score(issues: DataFrame) -> DataFrame:
    """Penalties per bucket and the quality score of an issue table, in one row."""
    return _bucketed(issues, "issue_type", settings.QUALITY_BUCKETS, settings.QUALITY_WEIGHTS, "issue_count")


def ml_score(findings: DataFrame) -> DataFrame:
    return _bucketed(findings, "check", settings.ML_BUCKETS, settings.ML_WEIGHTS, "finding_count")


def data_health(scores: DataFrame) -> DataFrame:
    """Mean of quality, privacy (100 - risk) and ML readiness from one-row scores."""
    privacy = F.round(F.lit(100.0) - F.col("privacy_risk_score"), 2)
    return scores.withColumn("privacy_score", privacy).withColumn(
        "data_health", F.round((F.col("quality_score") + F.col("privacy_score") + F.col("ml_readiness_score"))
                               / F.lit(3.0), 2))


def rescue_score(health: DataFrame) -> DataFrame:
    """Share of the gap to 100 that was closed, from ``health_before`` and ``health_after``."""
    before, after = F.col("health_before"), F.col("health_after")
    share = F.try_divide((after - before) * 100.0, F.lit(100.0) - before)
    return health.withColumn("rescue_score", F.when(before >= 100, 100.0).otherwise(_clamp(share)))
