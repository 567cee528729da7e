"""The privacy loop: profile, classify, measure, attack, score; then fix and test again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgauge import settings
from veilgauge.functions.columns import nan_to_null, shared_columns
from veilgauge.operators import frequencies, privacy, profile, scores
from veilgauge.operators.linkage import Linkage, kinds_from, linkage
from veilgauge.operators.mitigate import apply_mitigations
from veilgauge.session import materialise, pin

RISK_INPUTS = ("highest_confidence double, unique_pct double, k5_at_risk_pct double, sensitive_pct double, "
               "at_risk_records bigint, min_class_size bigint")


@dataclass
class Analysis:
    """Frames with one row per column, threshold or metric; ``linkage.matches`` stays lazy and large."""

    stats: DataFrame
    profile: DataFrame
    classified: DataFrame
    roles: dict[str, list[str]]
    uniqueness: DataFrame
    k_anonymity: DataFrame
    l_diversity: DataFrame
    linkage: Linkage | None
    linkage_summary: DataFrame | None
    risk: DataFrame


def full_analysis(df: DataFrame, aux: DataFrame | None = None, key: str | None = None,
                  aux_key: str | None = None, *, diversity: bool = True, weights: dict | None = None,
                  **linkage_options) -> Analysis:
    """Everything known about one table's re-identification risk, optionally under attack by ``aux``."""
    df = nan_to_null(df)
    stats = pin(frequencies.column_statistics(df))
    described = pin(profile.describe(stats, df.columns))
    classified = pin(profile.classify_columns(described, df.columns))
    roles = profile.roles(classified.collect())
    qi = roles["quasi"]

    if qi:
        ks = sorted({*settings.K_VALUES, settings.REPRESENTATIVE_K})
        totals = pin(privacy.class_totals(privacy.equivalence_classes(df, qi), ks))
        unique, checks = privacy.uniqueness_of(totals), privacy.k_anonymity_of(totals, ks)
    else:
        unique, checks = pin(privacy.uniqueness(df, qi)), pin(privacy.k_anonymity(df, qi))
    spread = pin(privacy.l_diversity(df, qi, roles["sensitive"] if diversity else []))

    attack = summary = None
    if aux is not None:
        known = kinds_from(stats, shared_columns(df, aux))
        attack = linkage(df, aux, key, aux_key, **{"kinds": known, **linkage_options})
        summary = pin(attack.summary())
    risk = scores.risk_score(_risk_inputs(df, roles, unique, checks, summary), weights)
    return Analysis(stats, described, classified, roles, unique, checks, spread, attack, summary, pin(risk))


def _risk_inputs(df: DataFrame, roles: dict, unique: DataFrame, checks: DataFrame,
                 summary: DataFrame | None) -> DataFrame:
    """The one-row input of the risk score, from metric-sized frames."""
    u = unique.first()
    k5 = checks.where(F.col("k") == settings.REPRESENTATIVE_K).first()
    confidence = summary.first()["highest_confidence"] if summary is not None else 0.0
    exposure = len(roles["sensitive"]) * 100.0 / max(1, len(df.columns))
    row = (float(confidence), float(u["unique_pct"]), float(k5["at_risk_pct"]) if k5 else None, exposure,
           int(k5["at_risk_records"]) if k5 else int(u["unique_records"]), int(k5["min_class_size"]) if k5 else None)
    return df.sparkSession.createDataFrame([row], RISK_INPUTS)


def compare_risk(before: DataFrame, after: DataFrame) -> DataFrame:
    """Before and after of two one-row risk frames, side by side, with the drop in score."""
    fields = {"overall_score": "risk_score", "risk_level": "risk_level", "at_risk_records": "at_risk_records",
              "min_class_size": "min_class_size"}
    b = before.select(*[F.col(c).alias(f"{n}_before") for c, n in fields.items()])
    a = after.select(*[F.col(c).alias(f"{n}_after") for c, n in fields.items()])
    return b.join(F.broadcast(a)).withColumn(
        "risk_score_delta", F.round(F.col("risk_score_before") - F.col("risk_score_after"), 2))


def fix_and_retest(df: DataFrame, steps: list[dict], aux: DataFrame | None = None, key: str | None = None,
                   aux_key: str | None = None, *, generalize_aux: bool = False, before: Analysis | None = None,
                   **options) -> tuple[DataFrame, Analysis, DataFrame]:
    """Apply the steps, analyse again, and compare: ``(table, analysis, comparison)``.

    By default the attacker still holds exact values; ``generalize_aux`` gives
    them the generalised ones too, which is the stricter test.
    """
    before = before or full_analysis(df, aux, key, aux_key, **options)
    changed, _ = materialise(apply_mitigations(df, steps))
    attacker = aux
    if aux is not None and generalize_aux:
        attacker = apply_mitigations(aux, [s for s in steps if s["column"] in aux.columns])
    after = full_analysis(changed, attacker, key, aux_key, **options)
    return changed, after, compare_risk(before.risk, after.risk)
