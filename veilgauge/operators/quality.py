"""Data-quality detectors. Each returns issue rows; all read two small fact frames.

``column_statistics`` gives one row per column for everything counted by value;
``numeric_facts`` gives one row per numeric column for fences and ranges. Both
have as many rows as the table has columns, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgauge.functions.columns import numeric_columns
from veilgauge.functions.ladders import above
from veilgauge.operators.frequencies import column_statistics, duplicate_summary
from veilgauge.operators.quantiles import as_number, iqr_fences
from veilgauge.session import pin

ISSUE = ("struct<detector:int,ordinal:int,issue_type:string,severity:string,columns:array<string>,"
         "affected_rows:bigint,description:string,confidence:double,auto_fix_eligible:boolean,"
         "suggested_action:string,action_params:map<string,string>>")
FACTS = ("ordinal int, column string, present bigint, lower double, upper double, spread double, "
         "outliers bigint, positives bigint, smallest double, largest double")


def _issue(detector: int, issue_type: str, severity: Column | str, affected: Column, description: Column,
           confidence: float, auto: bool, action: Column | str | None, scoped: bool = True) -> Column:
    column = F.col("column")
    params = F.create_map(F.lit("column"), column) if scoped and action is not None \
        else F.create_map().cast("map<string,string>")
    lit = lambda v: F.lit(v) if not isinstance(v, Column) else v
    return F.struct(
        F.lit(detector).alias("detector"), F.col("ordinal"), F.lit(issue_type).alias("issue_type"),
        lit(severity).alias("severity"),
        (F.array(column) if scoped else F.array().cast("array<string>")).alias("columns"),
        affected.cast("bigint").alias("affected_rows"), description.alias("description"),
        F.lit(confidence).alias("confidence"), F.lit(auto).alias("auto_fix_eligible"),
        lit(action).cast("string").alias("suggested_action"), params.alias("action_params")).cast(ISSUE)


def _emit(facts: DataFrame, found: list[tuple[Column, Column]]) -> DataFrame:
    """All issues whose condition holds, one row each."""
    listed = F.array(*[F.when(condition, issue) for condition, issue in found])
    return facts.select(F.explode(F.filter(listed, lambda i: i.isNotNull())).alias("i")).select("i.*")


def _pct(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(part * F.lit(100.0), whole), 2), F.lit(0.0))


def missing_values(stats: DataFrame) -> DataFrame:
    pct = _pct(F.col("missing_count"), F.col("row_count"))
    severity = above(pct, [(5, "MEDIUM"), (20, "HIGH"), (50, "CRITICAL")], "LOW")
    action = F.when(F.col("numeric"), "impute_missing_median").otherwise("impute_missing_mode")
    text = F.format_string("'%s' lacks %d values (%s%% of rows).", "column", "missing_count", pct.cast("string"))
    return _emit(stats, [(F.col("missing_count") > 0, _issue(
        1, "missing_values", severity, F.col("missing_count"), text, 1.0, False, action))])


def duplicate_rows(duplicates: DataFrame) -> DataFrame:
    """From the one-row ``duplicate_summary``."""
    facts = duplicates.select("*", F.lit(None).cast("string").alias("column"), F.lit(-1).alias("ordinal"))
    severity = above(F.col("duplicate_pct"), [(2, "MEDIUM"), (10, "HIGH")], "LOW")
    text = F.format_string("%d rows repeat another row exactly (%s%%).", "duplicate_rows",
                           F.col("duplicate_pct").cast("string"))
    return _emit(facts, [(F.col("duplicate_rows") > 0, _issue(
        2, "duplicate_rows", severity, F.col("duplicate_rows"), text, 1.0, True, "drop_exact_duplicates", False))])


def whitespace(stats: DataFrame) -> DataFrame:
    text = F.format_string("'%s' has %d values with surrounding whitespace.", "column", "padded_rows")
    return _emit(stats, [(F.col("padded_rows") > 0, _issue(
        3, "whitespace", "LOW", F.col("padded_rows"), text, 1.0, True, "trim_whitespace"))])


def case_inconsistency(stats: DataFrame) -> DataFrame:
    """Labels that collapse when case is ignored; every non-null row counts as affected."""
    present = F.col("row_count") - F.col("missing_count")
    found = (F.col("textual") & (present > 0) & (F.col("folded_unique") < F.col("stripped_unique"))
             & (F.col("stripped_unique") <= F.greatest(F.lit(30.0), F.lit(0.3) * present)))
    text = F.format_string("'%s' has %d labels that are %d when case is ignored.", "column",
                           "stripped_unique", "folded_unique")
    return _emit(stats, [(found, _issue(
        4, "case_inconsistency", "LOW", present, text, 0.85, True, "standardize_case"))])


def date_formats(stats: DataFrame) -> DataFrame:
    """Unparseable values in a date-like column, or several formats if all of them parse."""
    present = F.col("row_count") - F.col("missing_count")
    looks = F.col("textual") & (present >= 5) & (F.col("date_like_rows") >= F.lit(0.5) * present)
    broken = present - F.col("parsed_rows")
    severity = above(_pct(broken, present), [(5, "MEDIUM")], "LOW")
    unparsed = F.format_string("'%s' holds dates, but %d values do not parse.", "column", broken)
    mixed = F.format_string("'%s' writes dates in %d patterns.", "column", "pattern_count")
    return _emit(stats, [
        (looks & (broken > 0), _issue(
            5, "malformed_dates", severity, broken, unparsed, 0.8, False, "standardize_date_format")),
        (looks & (broken == 0) & (F.col("pattern_count") > 1), _issue(
            5, "inconsistent_date_format", "LOW", present, mixed, 0.7, True, "standardize_date_format")),
    ])


def cardinality(stats: DataFrame) -> DataFrame:
    rows, distinct = F.col("row_count"), F.col("unique_count")
    ratio = F.try_divide(distinct.cast("double"), rows)
    constant = distinct <= 1
    nearly = ~constant & (ratio < 0.02) & (distinct <= 3)
    unique = ~constant & ~nearly & (ratio > 0.95) & ~F.col("numeric")
    return _emit(stats, [
        (constant, _issue(6, "constant_column", "LOW", rows,
                          F.format_string("'%s' never varies.", "column"), 1.0, False, "suppression")),
        (nearly, _issue(6, "near_constant_column", "LOW", rows,
                        F.format_string("'%s' has only %d distinct values.", "column", distinct),
                        0.6, False, None)),
        (unique, _issue(6, "high_cardinality_column", "LOW", rows,
                        F.format_string("'%s' is almost unique per row, like an identifier.", "column"),
                        0.7, False, None)),
    ])


def numeric_facts(df: DataFrame) -> DataFrame:
    """Fences, outlier counts and positive range of every numeric column, from one scan after the quartiles."""
    columns = numeric_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], FACTS)
    fences = iqr_fences(df, columns)
    aggregates = []
    for i, c in enumerate(columns):
        v = as_number(df, c)
        _, _, low, high = fences.get(c, (None, None, None, None))
        outside = (v < F.lit(low)) | (v > F.lit(high)) if low is not None else F.lit(False)
        positive = F.when(v > 0, v)
        aggregates += [F.count(v).alias(f"present{i}"), F.count(F.when(outside, 1)).alias(f"outliers{i}"),
                       F.count(positive).alias(f"positives{i}"), F.min(positive).alias(f"smallest{i}"),
                       F.max(positive).alias(f"largest{i}")]
    position = {c: i for i, c in enumerate(df.columns)}
    wide = df.agg(*aggregates)
    rows = F.array(*[F.struct(
        F.lit(position[c]).alias("ordinal"), F.lit(c).alias("column"), F.col(f"present{i}").alias("present"),
        *[F.lit(fences[c][j] if c in fences else None).cast("double").alias(n) for j, n in ((2, "lower"), (3, "upper"))],
        F.lit(fences[c][1] - fences[c][0] if c in fences else None).cast("double").alias("spread"),
        F.col(f"outliers{i}").alias("outliers"), F.col(f"positives{i}").alias("positives"),
        F.col(f"smallest{i}").alias("smallest"), F.col(f"largest{i}").alias("largest"))
        for i, c in enumerate(columns)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def outliers(facts: DataFrame) -> DataFrame:
    """Values outside three interquartile ranges, for columns with ten or more values."""
    found = (F.col("present") >= 10) & (F.col("spread") != 0) & (F.col("outliers") > 0)
    severity = above(_pct(F.col("outliers"), F.col("present")), [(2, "MEDIUM")], "LOW")
    text = F.format_string("'%s' has %d values outside [%s, %s].", "column", "outliers",
                           F.round("lower", 2).cast("string"), F.round("upper", 2).cast("string"))
    return _emit(facts, [(found, _issue(
        7, "outliers", severity, F.col("outliers"), text, 0.75, False, "remove_outliers"))])


def unit_ratio(facts: DataFrame) -> DataFrame:
    """Positive values spanning more than three orders of magnitude: a hint, never a finding."""
    ratio = F.try_divide(F.col("largest"), F.col("smallest"))
    text = F.format_string("'%s' spans a factor of more than 1000; units may be mixed.", "column")
    return _emit(facts, [((F.col("positives") >= 10) & (ratio > 1000), _issue(
        8, "possible_unit_inconsistency", "LOW", F.col("positives"), text, 0.35, False, None))])


def issues_from(stats: DataFrame, duplicates: DataFrame, facts: DataFrame) -> DataFrame:
    frames = [missing_values(stats), duplicate_rows(duplicates), whitespace(stats), case_inconsistency(stats),
              date_formats(stats), cardinality(stats), outliers(facts), unit_ratio(facts)]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def quality_issues(df: DataFrame) -> DataFrame:
    """Every detector's issues; order them by ``detector, ordinal``."""
    return issues_from(pin(column_statistics(df)), pin(duplicate_summary(df)), pin(numeric_facts(df)))
