"""ML-readiness checks: constant, duplicate, high-cardinality, sparse and correlated data, and target checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgauge import settings
from veilgauge.functions.columns import is_numeric, numeric_columns, ref
from veilgauge.functions.ladders import above
from veilgauge.operators.frequencies import column_statistics, duplicate_summary
from veilgauge.operators.quantiles import as_number
from veilgauge.session import pin

FINDING = ("struct<step:int,ordinal:int,check:string,severity:string,columns:array<string>,"
           "description:string,confidence:double>")


def _finding(step: int, check: str, severity: Column | str, columns: Column, text: Column,
             confidence: float) -> Column:
    return F.struct(
        F.lit(step).alias("step"), F.col("ordinal"), F.lit(check).alias("check"),
        (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"),
        columns.alias("columns"), text.alias("description"), F.lit(confidence).alias("confidence")).cast(FINDING)


def _emit(frame: DataFrame, found: list[tuple[Column, Column]]) -> DataFrame:
    listed = F.array(*[F.when(condition, f) for condition, f in found])
    return frame.select(F.explode(F.filter(listed, lambda f: f.isNotNull())).alias("f")).select("f.*")


def _pct(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(part * F.lit(100.0), whole), 2), F.lit(0.0))


def column_checks(stats: DataFrame) -> DataFrame:
    named = F.array("column")
    ratio = F.try_divide(F.col("unique_count").cast("double"), F.col("row_count"))
    return _emit(stats, [
        (F.col("unique_count") <= 1, _finding(
            1, "constant_feature", "MEDIUM", named,
            F.format_string("'%s' has zero variance.", "column"), 1.0)),
        (F.col("textual") & (ratio > 0.5), _finding(
            3, "high_cardinality_categorical", "LOW", named,
            F.format_string("'%s' has too many distinct values to encode one by one.", "column"), 0.8)),
    ])


def table_checks(stats: DataFrame, duplicates: DataFrame) -> DataFrame:
    nothing = F.array().cast("array<string>")
    copies = duplicates.withColumn("ordinal", F.lit(-1))
    repeated = _emit(copies, [(F.col("duplicate_rows") > 0, _finding(
        2, "duplicate_observations", above(F.col("duplicate_pct"), [(5, "MEDIUM")], "LOW"), nothing,
        F.format_string("%d repeated rows could leak between training and test data.", "duplicate_rows"), 1.0))])
    cells = stats.agg(F.sum("missing_count").alias("missing"), F.sum("row_count").alias("cells"))
    cells = cells.withColumn("ordinal", F.lit(-1)).withColumn("pct", _pct(F.col("missing"), F.col("cells")))
    sparse = _emit(cells, [(F.col("pct") > 20, _finding(
        4, "high_sparsity", above(F.col("pct"), [(40, "HIGH")], "MEDIUM"), nothing,
        F.format_string("%s%% of all cells are missing.", F.col("pct").cast("string")), 1.0))])
    return repeated.unionByName(sparse)


def _gram_partials(columns: int, centres: list[float]) -> Callable:
    """Per partition: sums of products over complete pairs, as matrix products on Arrow batches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((4, columns, columns))
        for batch in batches:
            x = batch.to_numpy(dtype="float64") - np.array(centres)
            known = ~np.isnan(x)
            x = np.where(known, x, 0.0)
            known = known.astype("float64")
            with np.errstate(invalid="ignore", over="ignore"):  # infinities end as non-finite sums
                total += np.stack([known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x])
        a, b = np.indices((columns, columns))
        yield pd.DataFrame({"a": a.ravel(), "b": b.ravel(), **{
            name: total[i].ravel() for i, name in enumerate(("n", "x", "xx", "xy"))}})
    return run


def correlation_pairs(df: DataFrame, columns: list[str] | None = None,
                      against: str | None = None) -> DataFrame:
    """``(ordinal, column_a, column_b, correlation)`` of all numeric pairs, or all against one column.

    Pearson over rows where both exist; null for a constant column and for one
    that holds an infinity. Values are centred on their mean first, so plain sums
    stay accurate.
    """
    columns = list(columns or numeric_columns(df))
    if against and against not in columns:
        columns.append(against)
    at = {c: i for i, c in enumerate(columns)}
    named = [(c, against) for c in columns if c != against] if against else list(combinations(columns, 2))
    if not named:
        return df.sparkSession.createDataFrame([], "ordinal int, column_a string, column_b string, correlation double")
    numbers = df.select(*[as_number(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    means = numbers.agg(*[F.avg(f"c{i}") for i in range(len(columns))]).first()
    centres = [m if m is not None and np.isfinite(m) else 0.0 for m in means]
    sums = (numbers.mapInPandas(_gram_partials(len(columns), centres), "a int, b int, n double, x double, xx double, xy double")
            .groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "x", "xx", "xy")]))
    other = sums.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("x").alias("y"), F.col("xx").alias("yy"))
    wanted = df.sparkSession.createDataFrame([(i, a, b, at[a], at[b]) for i, (a, b) in enumerate(named)],
                                             "ordinal int, column_a string, column_b string, a int, b int")
    mean = lambda c: F.try_divide(F.col(c), F.col("n"))
    spread_a, spread_b = mean("xx") - mean("x") * mean("x"), mean("yy") - mean("y") * mean("y")
    value = F.when((F.col("n") >= 2) & (spread_a > 0) & (spread_b > 0),
                   (mean("xy") - mean("x") * mean("y")) / F.sqrt(spread_a * spread_b))
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    return (wanted.join(sums, ["a", "b"], "left").join(other, ["a", "b"], "left")
            .select("ordinal", "column_a", "column_b", finite.alias("correlation")))


def correlation_checks(pairs: DataFrame, step: int = 5, check: str = "suspicious_correlation",
                       severity: str = "MEDIUM", confidence: float = 0.7) -> DataFrame:
    strong = F.abs("correlation") >= settings.CORRELATION_LIMIT
    text = F.format_string("'%s' and '%s' correlate at %s.", "column_a", "column_b",
                           F.round("correlation", 3).cast("string"))
    return _emit(pairs, [(strong, _finding(
        step, check, severity, F.array("column_a", "column_b"), text, confidence))])


def target_checks(df: DataFrame, target: str) -> DataFrame:
    """Missing labels, imbalance over at most twenty classes, and near-perfect numeric predictors."""
    spark = df.sparkSession
    if target not in df.columns:
        one = spark.range(1).select(F.lit(-1).alias("ordinal"))
        return _emit(one, [(F.lit(True), _finding(
            6, "target_not_found", "HIGH", F.array(F.lit(target)),
            F.lit(f"The table has no column '{target}'."), 1.0))])
    counts = df.groupBy(ref(target).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    labelled = F.col("label").isNotNull()
    facts = counts.agg(
        F.coalesce(F.sum(F.when(~labelled, F.col("n"))), F.lit(0)).alias("missing"),
        F.count("label").alias("classes"),
        F.coalesce(F.try_divide(F.max(F.when(labelled, F.col("n"))).cast("double"),
                                F.sum(F.when(labelled, F.col("n")))), F.lit(0.0)).alias("majority"),
    ).withColumn("ordinal", F.lit(-1))
    named = F.array(F.lit(target))
    found = _emit(facts, [
        (F.col("missing") > 0, _finding(
            6, "missing_target_rows", "HIGH", named,
            F.format_string("%d rows have no label.", "missing"), 1.0)),
        (F.col("classes").between(1, 20) & (F.col("majority") > 0.9), _finding(
            7, "class_imbalance", "MEDIUM", named,
            F.format_string("One class makes up %s%% of labelled rows.",
                            F.round(F.col("majority") * 100.0, 1).cast("string")), 0.9)),
    ])
    if not is_numeric(df.schema[target].dataType):
        return found
    leaks = correlation_pairs(df, against=target)
    return found.unionByName(correlation_checks(leaks, 8, "possible_target_leakage", "HIGH", 0.6))


def findings_from(df: DataFrame, stats: DataFrame, duplicates: DataFrame, target: str | None = None) -> DataFrame:
    out = (column_checks(stats).unionByName(table_checks(stats, duplicates))
           .unionByName(correlation_checks(correlation_pairs(df))))
    return out.unionByName(target_checks(df, target)) if target else out


def ml_findings(df: DataFrame, target: str | None = None) -> DataFrame:
    """Every readiness finding; order them by ``step, ordinal``."""
    return findings_from(df, pin(column_statistics(df)), pin(duplicate_summary(df)), target)
