"""One entry per operator, each over whole given tables or whole tables derived from them.

Results are flat: dates as text, lists joined by commas, scores rounded, so that
the same table can be computed by plain SQL (see :mod:`workbook.oracle`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgauge.functions import similarity
from veilgauge.functions.columns import ref
from veilgauge.operators import (evaluate, faults, fixes, frequencies, latest, linkage, mitigate, ml, privacy,
                                 profile, quality, quantiles, scores, sketches, tradeoff)
from veilgauge.plans import analysis, report, rescue
from veilgauge.session import LOCAL_CONFIG, pin
from workbook.views import raw, view

SUBJECT_QI = ["age", "region", "state", "occupation", "postal_code"]
COARSE_QI = ["region", "state", "occupation"]
LINE_QI = ["l_returnflag", "l_linestatus", "l_quantity", "ship_month"]
EXACT = ["region", "state", "occupation", "postal_code"]


def _prepare(spark: SparkSession) -> None:
    if spark.sparkContext.master.startswith("local"):
        for key, value in LOCAL_CONFIG.items():
            spark.conf.set(key, value)


def _subjects(spark, d) -> DataFrame:
    return view(spark, d, "subjects")


def _dirty(spark, d) -> DataFrame:
    return view(spark, d, "dirty")


def _lines(spark, d) -> DataFrame:
    return raw(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity",
        F.date_format("l_shipdate", "yyyy-MM").alias("ship_month"))


def _attack(spark, d, **options) -> linkage.Linkage:
    return linkage.linkage(_subjects(spark, d), view(spark, d, "subjects_aux"), "customer_id", "aux_id", **options)


def _flat(df: DataFrame) -> DataFrame:
    """Dates as text."""
    return df.select(*[ref(f.name).cast("string").alias(f.name) if f.dataType.typeName() in ("date", "timestamp")
                       else ref(f.name) for f in df.schema])


# --- Sources and catalog -------------------------------------------------------

def scan_parquet(spark, d):
    return raw(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


def latest_per_key(spark, d):
    return latest.latest_per_key(raw(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select(
        "event_id", "user_id", "event_type", "value")


def audit_tail(spark, d):
    return latest.newest(raw(spark, d, "events"), ["ts", "event_id"], 200).select("event_id", "user_id", "event_type")


def jobs_latest(spark, d):
    current = latest.latest_per_key(raw(spark, d, "events"), ["user_id"], ["ts", "event_id"])
    return latest.newest(current, ["ts", "event_id"], 50).select("user_id", "event_id", "event_type")


# --- Privacy classes -----------------------------------------------------------

def equivalence_classes(spark, d):
    return privacy.equivalence_classes(_lines(spark, d), LINE_QI)


def class_size_per_row(spark, d):
    return privacy.class_size_per_row(_lines(spark, d), LINE_QI).select("l_orderkey", "l_linenumber", "class_size")


def uniqueness(spark, d):
    return privacy.uniqueness(_lines(spark, d), LINE_QI)


def class_size_distribution(spark, d):
    return privacy.class_size_distribution(_lines(spark, d), LINE_QI)


def k_anonymity(spark, d):
    return privacy.k_anonymity(_lines(spark, d), LINE_QI)


def l_diversity(spark, d):
    return privacy.l_diversity(_subjects(spark, d), COARSE_QI, ["income", "postal_code"])


def vulnerable_clusters(spark, d):
    return privacy.vulnerable_clusters(_subjects(spark, d), SUBJECT_QI)


# --- Profile and classification ------------------------------------------------

def profile_table(spark, d):
    return profile.profile_table(_dirty(spark, d))


def profile_columns(spark, d):
    return profile.profile_columns(_dirty(spark, d)).drop("dtype")


def profile_samples(spark, d):
    return profile.profile_samples(_subjects(spark, d))


def classify_columns(spark, d):
    df = _dirty(spark, d)
    return profile.classify_columns(profile.profile_columns(df), df.columns).select(
        "ordinal", "column", "category", "confidence")


def duplicate_rows(spark, d):
    return frequencies.duplicate_summary(_dirty(spark, d))


def duplicate_flags(spark, d):
    return frequencies.duplicate_flags(raw(spark, d, "documents"), "doc_id", ["text"])


def topn_values(spark, d):
    return frequencies.top_values(raw(spark, d, "part"), "p_type", 5)


def profile_merged(spark, d):
    """Exact counts of merged states, and whether they equal the whole table's and keep the stated error."""
    lines = raw(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    parts = [sketches.column_sketches(lines.where(f"l_partkey % 4 = {k}")) for k in range(4)]
    merged, whole = sketches.estimates(sketches.merged(*parts)), sketches.estimates(sketches.column_sketches(lines))
    exact = profile.profile_columns(lines).select(F.col("name").alias("column"), "unique_count")
    near = F.abs(F.col("m.approx_distinct") - F.col("unique_count")) <= F.ceil(4 * sketches.DISTINCT_ERROR * F.col("unique_count"))
    return merged.alias("m").join(whole.alias("w"), "column").join(exact, "column").select(
        "column", F.col("m.row_count").alias("row_count"), F.col("m.missing_count").alias("missing_count"),
        (F.col("m.approx_distinct") == F.col("w.approx_distinct")).alias("same_state"), near.alias("within_bound"))


def class_balance(spark, d):
    return frequencies.class_balance(raw(spark, d, "labels"), "quality")


def iqr_fences(spark, d):
    lines, events = raw(spark, d, "lineitem"), raw(spark, d, "events")
    found = {**quantiles.iqr_fences(lines, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
             **quantiles.iqr_fences(events, ["value"])}
    return spark.createDataFrame([(c, *[round(x, 6) for x in f]) for c, f in found.items()],
                                 "column string, q1 double, q3 double, lower double, upper double")


def correlation_pairs(spark, d):
    return ml.correlation_pairs(raw(spark, d, "lineitem")).select(
        "column_a", "column_b", F.round("correlation", 6).alias("correlation"))


# --- Similarities ---------------------------------------------------------------

def numeric_similarity(spark, d):
    parts = raw(spark, d, "lineitem").join(raw(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return parts.select("l_orderkey", "l_linenumber", similarity.numeric_similarity(
        unit, F.col("p_retailprice"), 2000.0).alias("score"))


def date_similarity(spark, d):
    both = raw(spark, d, "lineitem").join(raw(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("l_orderkey", "l_linenumber", F.round(
        similarity.date_similarity(F.to_date("o_orderdate"), F.to_date("l_shipdate")), 6).alias("score"))


def string_similarity(spark, d):
    return raw(spark, d, "part").select("p_partkey", F.round(
        similarity.edit_similarity(F.col("p_name"), F.col("p_type")), 6).alias("score"))


# --- Linkage ---------------------------------------------------------------------

MATCH = ["key_a", "key_b", "match_rank", "match_probability", "risk_level"]


def linkage_matches(spark, d):
    return _attack(spark, d).matches.select(*MATCH)


def linkage_top(spark, d):
    return _attack(spark, d).top_matches().select(*MATCH)


def linkage_summary(spark, d):
    return _attack(spark, d).summary()


def linkage_coverage(spark, d):
    return linkage.coverage(_subjects(spark, d), view(spark, d, "subjects_aux"))


def explain_matches(spark, d):
    return linkage.explain_matches(_attack(spark, d).matches).select(
        "key_a", "key_b", "attribute", "kind", "score", "strength")


def match_attribute_matrix(spark, d):
    return linkage.match_attribute_matrix(_attack(spark, d))


def linkage_text(spark, d):
    """Misspelt names, compared by the default measure."""
    return linkage.linkage(_subjects(spark, d), view(spark, d, "names_aux"), "customer_id", "aux_id",
                           columns=["full_name", "region", "occupation"]).matches.select(*MATCH)


def linkage_dates_numbers(spark, d):
    return linkage.linkage(_subjects(spark, d), view(spark, d, "visits_aux"), "customer_id", "aux_id",
                           columns=["postal_code", "income", "order_date"]).matches.select(*MATCH)


def linkage_crowded(spark, d):
    """Incomes crowded by an outlier."""
    return linkage.linkage(view(spark, d, "incomes"), view(spark, d, "incomes_aux"), "customer_id", "aux_id").matches.select(*MATCH)


def linkage_wide(spark, d):
    """Twenty shared categories."""
    return linkage.linkage(view(spark, d, "traits"), view(spark, d, "traits_aux"), "customer_id", "aux_id").matches.select(*MATCH)


def linkage_precision_recall(spark, d):
    truth = _subjects(spark, d).select(F.col("customer_id").alias("key_a"), F.col("customer_id").alias("key_b"))
    return evaluate.precision_recall(_attack(spark, d).matches, truth, ["key_a", "key_b"])


def linkable_overlap(spark, d):
    return evaluate.linkable_overlap(_subjects(spark, d), view(spark, d, "subjects_aux"), EXACT, "age")


# --- Mitigation ------------------------------------------------------------------

def _mitigated(action: str, column: str, **params) -> Callable:
    def run(spark, d):
        step = {"column": column, "action": action, "params": params}
        return mitigate.apply_mitigations(_subjects(spark, d), [step]).select("customer_id", column)
    return run


def mitigate_suppress(spark, d):
    return _flat(mitigate.apply_suppression(_subjects(spark, d), "full_name"))


def _recommended(spark, d) -> tuple[DataFrame, DataFrame]:
    df = _subjects(spark, d)
    classified = profile.classify_columns(profile.profile_columns(df), df.columns)
    return df, mitigate.recommend(classified)


def recommend_mitigations(spark, d):
    return _recommended(spark, d)[1].select("ordinal", "column", "action")


def apply_mitigations(spark, d):
    df, recommended = _recommended(spark, d)
    return _flat(mitigate.apply_mitigations(df, mitigate.as_steps(recommended.collect())))


def optimize_mitigations(spark, d):
    df = raw(spark, d, "orders").select(
        "o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        F.floor(F.col("o_totalprice") / 10000).cast("int").alias("price_level"))
    steps = [{"column": "order_date", "action": "date_generalization"},
             {"column": "order_date", "action": "date_generalization", "params": {"granularity": "year"}},
             {"column": "price_level", "action": "generalization_bucketing"},
             {"column": "order_date", "action": "suppression"},
             {"column": "o_orderpriority", "action": "generalization", "params": {"keep_top_n": 2}}]
    return tradeoff.optimize(df, steps, ["o_orderstatus", "o_orderpriority", "order_date", "price_level"])


def derive_auxiliary(spark, d):
    return faults.derive_auxiliary(_subjects(spark, d), "customer_id",
                                   ["region", "state", "occupation", "postal_code"], "age")


FAULTS = {"missing_number": "age", "missing_text": "region", "case": "occupation", "padding": "state",
          "date": "order_date"}


def inject_quality_faults(spark, d):
    return faults.inject_quality_faults(_subjects(spark, d), "customer_id", FAULTS).select(
        "customer_id", "age", "region", "occupation", "state", "order_date", "data_source")


# --- Quality ----------------------------------------------------------------------

def _issues(issues: DataFrame) -> DataFrame:
    return issues.select("issue_type", "severity", F.concat_ws(",", "columns").alias("column_names"), "affected_rows",
                         "confidence", "auto_fix_eligible", F.coalesce("suggested_action", F.lit("")).alias("action"))


def _column_detector(detect: Callable, name: str = "dirty") -> Callable:
    def run(spark, d):
        return _issues(detect(pin(frequencies.column_statistics(view(spark, d, name)))))
    return run


def _numeric_detector(detect: Callable) -> Callable:
    def run(spark, d):
        return _issues(detect(quality.numeric_facts(_dirty(spark, d))))
    return run


def quality_issues(spark, d):
    return _issues(quality.quality_issues(_dirty(spark, d)))


def quality_score(spark, d):
    return scores.quality_score(quality.quality_issues(_dirty(spark, d)))


def fix_trim(spark, d):
    return fixes.trim_whitespace(_dirty(spark, d), "state").select("customer_id", "state")


def fix_case(spark, d):
    return fixes.standardize_case(_dirty(spark, d), "occupation").select("customer_id", "occupation")


def fix_date_format(spark, d):
    return fixes.standardize_date_format(_dirty(spark, d), "order_date").select("customer_id", "order_date")


def fix_drop_duplicates(spark, d):
    return fixes.drop_exact_duplicates(_dirty(spark, d))


def fix_impute_median(spark, d):
    return fixes.impute_missing_median(_dirty(spark, d), "age").select("customer_id", "age")


def fix_impute_mode(spark, d):
    return fixes.impute_missing_mode(_dirty(spark, d), "region").select("customer_id", "region")


def fix_remove_outliers(spark, d):
    return fixes.remove_outliers(_dirty(spark, d), "income").select("customer_id", "income")


def utility_retained(spark, d):
    df = _dirty(spark, d)
    fixed = fixes.drop_exact_duplicates(fixes.standardize_case(fixes.trim_whitespace(df, "state"), "occupation"))
    return evaluate.utility_retained(frequencies.column_statistics(df), frequencies.column_statistics(fixed))


# --- ML readiness ------------------------------------------------------------------

def _findings(findings: DataFrame) -> DataFrame:
    return findings.select("check", "severity", F.concat_ws(",", "columns").alias("column_names"), "confidence")


def ml_findings(spark, d):
    return _findings(ml.ml_findings(_dirty(spark, d), "flag"))


def ml_score(spark, d):
    return scores.ml_score(ml.ml_findings(_dirty(spark, d), "flag"))


def ml_target_checks(spark, d):
    df = raw(spark, d, "labels").withColumn("agreement", F.col("quality") * 2 + 1)
    return _findings(ml.target_checks(df, "quality"))


# --- Composites ---------------------------------------------------------------------

RISK = ["linkage_component", "uniqueness_component", "equivalence_component", "sensitive_component",
        "overall_score", "risk_level", "at_risk_records", "min_class_size"]


def _analysed(spark, d, **options) -> analysis.Analysis:
    return analysis.full_analysis(_subjects(spark, d), view(spark, d, "subjects_aux"), "customer_id", "aux_id",
                                  **options)


def risk_score(spark, d):
    return _analysed(spark, d, diversity=False).risk.select(*RISK)


def full_analysis(spark, d):
    """Everything an analysis measures: report, k-anonymity, l-diversity and the class of every column."""
    result = _analysed(spark, d)
    told = report.privacy_report("subjects", result).where("section <> 'disclaimer'").select("section", "metric", "value")
    classes = result.k_anonymity.selectExpr("'k_anonymity' AS section", "concat('at_risk_records k=', k) AS metric", "string(at_risk_records) AS value")
    diverse = result.l_diversity.selectExpr(
        "'l_diversity' AS section", "stack(3, concat(sensitive_column, ' min_l'), string(min_l), concat(sensitive_column, ' classes_with_l1'), "
        "string(classes_with_l1), concat(sensitive_column, ' records_at_risk'), string(records_at_risk)) AS (metric, value)")
    columns = result.classified.selectExpr("'columns' AS section", "column AS metric", "category AS value")
    return told.unionByName(classes).unionByName(diverse).unionByName(columns)


def before_after(spark, d):
    aux = view(spark, d, "subjects_aux")
    df = _subjects(spark, d)
    before = analysis.full_analysis(df, aux, "customer_id", "aux_id", diversity=False)
    steps = mitigate.as_steps(mitigate.recommend(before.classified).collect())
    return analysis.fix_and_retest(df, steps, aux, "customer_id", "aux_id", before=before, diversity=False)[2]


def privacy_report(spark, d):
    result = _analysed(spark, d)
    return report.privacy_report("subjects", result, mitigate.recommend(result.classified)).where(
        "section <> 'disclaimer'").select("section", "metric", "value")


def plan_policy(spark, d):
    listed = _recommended(spark, d)[1].select("column", F.col("action").alias("action_type"))
    return rescue.with_policy(listed).select("column", "action_type", "policy")


def _planned(spark, d) -> tuple[DataFrame, rescue.RescuePlan]:
    df = _dirty(spark, d)
    return df, rescue.make_plan(df, "plan", target="flag")


def rescue_plan(spark, d):
    return _planned(spark, d)[1].actions.select(
        "seq", "action_id", "source", "action_type", F.coalesce("column", F.lit("")).alias("column"), "policy",
        "status")


def data_health(spark, d):
    return rescue.assess(_dirty(spark, d), target="flag").metrics


def _rescued(spark, d) -> rescue.Rescue:
    df, plan = _planned(spark, d)
    approved = plan.actions.where(F.col("policy") == "REVIEW").select(
        "action_id", F.lit("approved").alias("decision"))
    return rescue.apply_plan(df, plan, approved, target="flag")


def rescue_decided(spark, d):
    """A rescue under attack: one step rejected, its milder form and one other step approved, the rest undecided."""
    df, aux = _subjects(spark, d), view(spark, d, "subjects_aux")
    plan = rescue.make_plan(df, "plan", aux, "customer_id", "aux_id")
    kind = F.col("action_type")
    said = plan.actions.select(
        F.explode(F.when(kind == "truncation_generalization", F.array(
            F.struct("action_id", F.lit("rejected").alias("decision")),
            F.struct(F.concat("action_id", F.lit("-alt")).alias("action_id"), F.lit("approved").alias("decision"))))
            .when(kind == "date_generalization", F.array(F.struct("action_id", F.lit("approved").alias("decision"))))).alias("d")).select("d.*")
    done = rescue.apply_plan(df, plan, said, aux, "customer_id", "aux_id")
    return done.actions.select("seq", "action_id", "source", "action_type", F.coalesce("column", F.lit("")).alias("column"), "policy", "status",
                               F.coalesce(F.col("params")["keep_digits"], F.lit("")).alias("keep_digits"))


def rescue_apply(spark, d):
    return _rescued(spark, d).table


def rescue_score(spark, d):
    return _rescued(spark, d).verification.select("passed", "health_before", "health_after", "rescue_score")


def rescue_report(spark, d):
    return report.rescue_report("plan", _rescued(spark, d)).select("section", "metric", "value")


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f.__name__: f for f in (
        scan_parquet, latest_per_key, audit_tail, jobs_latest,
        equivalence_classes, class_size_per_row, uniqueness, class_size_distribution, k_anonymity, l_diversity,
        vulnerable_clusters,
        profile_table, profile_columns, profile_merged, profile_samples, classify_columns, duplicate_rows, duplicate_flags,
        topn_values, class_balance, iqr_fences, correlation_pairs,
        numeric_similarity, date_similarity, string_similarity,
        linkage_matches, linkage_top, linkage_summary, linkage_coverage, explain_matches, match_attribute_matrix,
        linkage_text, linkage_dates_numbers, linkage_crowded, linkage_wide, linkage_precision_recall, linkable_overlap,
        mitigate_suppress, recommend_mitigations, apply_mitigations, optimize_mitigations, derive_auxiliary,
        inject_quality_faults,
        quality_issues, quality_score, fix_trim, fix_case, fix_date_format, fix_drop_duplicates, fix_impute_median,
        fix_impute_mode, fix_remove_outliers, utility_retained,
        ml_findings, ml_score, ml_target_checks,
        risk_score, full_analysis, before_after, privacy_report, plan_policy, rescue_plan, data_health,
        rescue_decided, rescue_apply, rescue_score, rescue_report)}
    found |= {
        "mitigate_age_band": _mitigated("generalization_bucketing", "age"),
        "mitigate_bucket": _mitigated("bucketing", "income"),
        "mitigate_truncate": _mitigated("truncation_generalization", "postal_code"),
        "mitigate_date_month": _mitigated("date_generalization", "order_date"),
        "mitigate_date_quarter": _mitigated("date_generalization", "order_date", granularity="quarter"),
        "mitigate_date_year": _mitigated("date_generalization", "order_date", granularity="year"),
        "mitigate_topn_other": _mitigated("generalization", "state"),
        "quality_missing": _column_detector(quality.missing_values),
        "quality_whitespace": _column_detector(quality.whitespace),
        "case_inconsistency": _column_detector(quality.case_inconsistency),
        "malformed_dates": _column_detector(quality.date_formats),
        "date_patterns": _column_detector(quality.date_formats, "mixed_dates"),
        "quality_cardinality": _column_detector(quality.cardinality),
        "quality_outliers": _numeric_detector(quality.outliers),
        "quality_unit_ratio": _numeric_detector(quality.unit_ratio),
    }

    def prepared(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            _prepare(spark)
            return f(spark, sf_dir)
        return run

    return {name: prepared(f) for name, f in found.items()}


