"""Ranking mitigations by privacy gained against utility lost, all in one job.

Every mitigation maps one quasi-identifier value to another, so rows are not
needed: the class frame is expanded once per candidate, the candidate's own
column is transformed, and one aggregation re-sizes all candidates' classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgauge import settings
from veilgauge.functions import dates
from veilgauge.functions.columns import as_text, ref
from veilgauge.operators.mitigate import ACTIONS, OTHER, age_band, bucket, generalise_date, truncate
from veilgauge.session import materialise, pin

SCHEMA = ("candidate int, column string, action string, risk_reduction_pct double, utility_loss_pct double, "
          "score double, weighted_score double")


def _value_of(action: str, text: Column, kept: list[str], params: dict) -> Column:
    if action == "generalization_bucketing":
        return age_band(text, int(params.get("band_size", 5)))
    if action == "bucketing":
        return bucket(text, int(params.get("bucket_size", 10000)))
    if action == "truncation_generalization":
        return truncate(text, int(params.get("keep_digits", 3)))
    if action == "date_generalization":
        return generalise_date(dates.parse_mixed(text), params.get("granularity", "month"))
    if action == "generalization":
        return F.when(text.isin(kept), text).otherwise(OTHER) if kept else F.lit(OTHER)
    return F.lit(None).cast("string")


def _top_values(values: DataFrame, limits: dict[str, int]) -> dict[str, list[str]]:
    """Most frequent values of several columns, at most ``limits`` each, in one job."""
    if not limits:
        return {}
    most = max(limits.values())
    rank = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("n"), "v"))
    rows = (values.where(F.col("c").isin(list(limits)) & F.col("v").isNotNull())
            .withColumn("rank", rank).where(F.col("rank") <= most).collect())
    return {c: [r["v"] for r in rows if r["c"] == c and r["rank"] <= limit] for c, limit in limits.items()}


def optimize(df: DataFrame, steps: list[dict], qi: list[str], risk_weight: float = 0.6,
             utility_weight: float = 0.4, k: int = settings.REPRESENTATIVE_K) -> DataFrame:
    """Each step judged alone: drop in at-risk percentage against loss of distinct values.

    Rows come ranked: highest weighted score first, then the order of ``steps``.
    """
    steps = [s for s in steps if s["action"] in ACTIONS and s["column"] in df.columns]
    if not steps:
        return df.sparkSession.createDataFrame([], SCHEMA)
    columns = list(dict.fromkeys([*qi, *[s["column"] for s in steps]]))
    names = {c: f"q{i}" for i, c in enumerate(columns)}
    text = df.select(*[as_text(c, df.schema[c].dataType).alias(names[c]) for c in columns])
    keys = [names[c] for c in qi]

    # One scan serves both frames when every candidate is a quasi-identifier.
    if set(columns) == set(qi):
        classes, _ = materialise(text.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")))
        tall = classes.unpivot(["size"], [ref(q) for q in keys], "c", "v")
    else:
        classes = text.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
        tall = text.withColumn("size", F.lit(1).cast("bigint")).unpivot(
            ["size"], [ref(names[c]) for c in columns], "c", "v")
    values, _ = materialise(tall.groupBy("c", "v").agg(F.sum("size").alias("n")))
    limits = {names[s["column"]]: int((s.get("params") or {}).get("keep_top_n", 5))
              for s in steps if s["action"] == "generalization"}
    kept = _top_values(values, limits)

    def changed(step: dict, value: Column) -> Column:
        return _value_of(step["action"], value, kept.get(names[step["column"]], []), step.get("params") or {})

    variants = [F.struct(F.lit(0).alias("candidate"), *[F.col(q) for q in keys])]
    for i, step in enumerate(steps, start=1):
        own = names[step["column"]]
        variants.append(F.struct(F.lit(i).alias("candidate"), *[
            (changed(step, F.col(q)) if q == own else F.col(q)).alias(q) for q in keys]))
    sized = (classes.select("size", F.explode(F.array(*variants)).alias("s")).select("size", "s.*")
             .groupBy("candidate", *keys).agg(F.sum("size").alias("size")))
    at_risk = sized.groupBy("candidate").agg(F.round(
        F.sum(F.when(F.col("size") < k, F.col("size")).otherwise(0)) * 100.0 / F.sum("size"), 2).alias("pct"))

    pieces = F.array(*[
        F.struct(F.lit(i).alias("candidate"),
                 (F.col("c") == names[s["column"]]).alias("own"),
                 changed(s, F.col("v")).alias("after")) for i, s in enumerate(steps, start=1)])
    mapped = (values.where(F.col("v").isNotNull()).select(F.explode(pieces).alias("p")).where("p.own")
              .groupBy("p.candidate", "p.after").agg(F.count(F.lit(1)).alias("n")))
    distinct = mapped.groupBy("candidate").agg(F.sum("n").alias("before"), F.count("after").alias("after"))

    risk = {r["candidate"]: r["pct"] for r in at_risk.collect()}
    loss = {r["candidate"]: (r["before"], r["after"]) for r in distinct.collect()}
    rows = []
    for i, step in enumerate(steps, start=1):
        # Suppressing the only quasi-identifier leaves nothing to be at risk by.
        gone = step["action"] == "suppression" and qi == [step["column"]]
        before, after = loss.get(i, (0, 0))
        rows.append((i, step["column"], step["action"], risk.get(0, 0.0) if qi else 0.0,
                     0.0 if gone or not qi else risk.get(i, 0.0), int(before), int(after)))
    metrics = df.sparkSession.createDataFrame(
        rows, "candidate int, column string, action string, risk_before double, risk_after double, "
              "distinct_before bigint, distinct_after bigint")
    reduction = F.round(F.greatest(F.lit(0.0), F.col("risk_before") - F.col("risk_after")), 2)
    lost = F.coalesce(F.round((F.lit(1.0) - F.try_divide(
        F.col("distinct_after").cast("double"), F.col("distinct_before"))) * 100.0, 2), F.lit(0.0))
    ranked = (metrics.withColumn("risk_reduction_pct", reduction)
              .withColumn("utility_loss_pct", F.greatest(F.lit(0.0), lost))
              .withColumn("score", F.round(F.col("risk_reduction_pct") - F.col("utility_loss_pct"), 2))
              .withColumn("weighted_score", F.round(
                  F.lit(risk_weight) * F.col("risk_reduction_pct")
                  - F.lit(utility_weight) * F.col("utility_loss_pct"), 2)))
    return pin(ranked.select("candidate", "column", "action", "risk_reduction_pct", "utility_loss_pct",
                             "score", "weighted_score").orderBy(F.desc("weighted_score"), "candidate"))
