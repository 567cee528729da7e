"""Equivalence classes, uniqueness, k-anonymity and l-diversity.

Everything starts from the class frame: one row per combination of
quasi-identifiers with its size. Spark aggregates it map-side first, so a class
holding a third of the table costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgauge import settings
from veilgauge.functions.columns import as_text, quoted, ref
from veilgauge.operators.skew import attach

SIZE_BUCKETS = [("1", 1, 1), ("2-4", 2, 4), ("5-9", 5, 9), ("10-49", 10, 49), ("50+", 50, None)]
MISSING = "__MISSING__"


def equivalence_classes(df: DataFrame, qi: list[str]) -> DataFrame:
    """One row per quasi-identifier combination with ``class_size``; nulls group together."""
    return df.groupBy(*[ref(c) for c in qi]).agg(F.count(F.lit(1)).alias("class_size"))


def class_size_per_row(df: DataFrame, qi: list[str]) -> DataFrame:
    return attach(df, equivalence_classes(df, qi), qi, "class_size", ["class_size"], "inner")


def _pct(part, whole):
    return F.coalesce(F.round(F.try_divide(part * F.lit(100.0), whole), 2), F.lit(0.0))


def class_totals(classes: DataFrame, k_values: list[int] | None = None) -> DataFrame:
    """Everything uniqueness and k-anonymity need, in one row from one pass over the classes."""
    size = F.col("class_size")
    zero = F.lit(0).cast("bigint")
    return classes.agg(
        F.count(F.lit(1)).alias("equivalence_classes"),
        F.coalesce(F.sum(F.when(size == 1, 1).otherwise(0)), zero).alias("unique_records"),
        F.coalesce(F.sum(size), zero).alias("total_records"),
        F.min(size).alias("min_class_size"),
        *[F.coalesce(F.sum(F.when(size < k, size)), zero).alias(f"k{k}") for k in k_values or settings.K_VALUES])


def uniqueness_of(totals: DataFrame) -> DataFrame:
    return totals.select(
        "equivalence_classes", "unique_records", "total_records",
        _pct(F.col("unique_records"), F.col("total_records")).alias("unique_pct"))


def uniqueness(df: DataFrame, qi: list[str]) -> DataFrame:
    """Class count, unique rows and unique percentage; zeros without rows or quasi-identifiers."""
    if not qi:
        return df.agg(F.count(F.lit(1)).alias("total_records")).select(
            F.lit(0).cast("bigint").alias("equivalence_classes"),
            F.lit(0).cast("bigint").alias("unique_records"), "total_records",
            F.lit(0.0).alias("unique_pct"))
    return uniqueness_of(class_totals(equivalence_classes(df, qi)))


def class_size_distribution(df: DataFrame, qi: list[str]) -> DataFrame:
    """Records (not classes) per class-size bucket; all five buckets are always present."""
    size = F.col("class_size")
    sums = []
    for i, (_, low, high) in enumerate(SIZE_BUCKETS):
        inside = size >= low if high is None else size.between(low, high)
        sums.append(F.coalesce(F.sum(F.when(inside, size)), F.lit(0)).alias(f"b{i}"))
    wide = equivalence_classes(df, qi).agg(*sums)
    pairs = ", ".join(f"'{label}', b{i}" for i, (label, _, _) in enumerate(SIZE_BUCKETS))
    return wide.selectExpr(f"stack({len(SIZE_BUCKETS)}, {pairs}) as (size_bucket, records)")


def k_anonymity_of(totals: DataFrame, k_values: list[int] | None = None) -> DataFrame:
    ks = k_values or settings.K_VALUES
    pairs = ", ".join(f"{k}, k{k}" for k in ks)
    tall = totals.selectExpr("total_records", "min_class_size", f"stack({len(ks)}, {pairs}) as (k, at_risk_records)")
    return tall.where(F.col("total_records") > 0).select(
        "k", "total_records", "min_class_size", "at_risk_records",
        _pct(F.col("at_risk_records"), F.col("total_records")).alias("at_risk_pct"),
        (F.col("at_risk_records") == 0).alias("satisfies_k_anonymity"),
    )


def k_anonymity(df: DataFrame, qi: list[str], k_values: list[int] | None = None) -> DataFrame:
    """One row per k: records in classes smaller than k; no rows without data or quasi-identifiers."""
    classes = equivalence_classes(df, qi)
    return k_anonymity_of(class_totals(classes if qi else classes.where(F.lit(False)), k_values), k_values)


def l_diversity(df: DataFrame, qi: list[str], sensitive: list[str]) -> DataFrame:
    """Distinct sensitive values per class, summarised, one row per sensitive column.

    Two aggregations, (class, value) then (class): both combine map-side, so
    neither a hot class nor a column of unique values lands in one task whole.
    """
    kept = [c for c in sensitive if c in df.columns]
    if not kept or not qi:
        return df.sparkSession.createDataFrame(
            [], "sensitive_column string, min_l bigint, classes_with_l1 bigint, "
                "records_at_risk bigint, total_classes bigint")
    types = {f.name: f.dataType for f in df.schema}
    narrow = df.select(
        *[ref(c).alias(f"q{i}") for i, c in enumerate(qi)],
        *[F.coalesce(as_text(c, types[c]), F.lit(MISSING)).alias(f"s{i}") for i, c in enumerate(kept)],
    )
    keys = [f"q{i}" for i in range(len(qi))]
    tall = narrow.unpivot(keys, [f"s{i}" for i in range(len(kept))], "s", "v")
    per_value = tall.groupBy(*keys, "s", "v").agg(F.count(F.lit(1)).alias("n"))
    per_class = per_value.groupBy(*keys, "s").agg(
        F.count(F.lit(1)).alias("distinct_l"), F.sum("n").alias("class_size"))
    single = F.col("distinct_l") == 1
    names = F.create_map(*[x for i, c in enumerate(kept) for x in (F.lit(f"s{i}"), F.lit(c))])
    return per_class.groupBy("s").agg(
        F.min("distinct_l").alias("min_l"),
        F.sum(F.when(single, 1).otherwise(0)).alias("classes_with_l1"),
        F.sum(F.when(single, F.col("class_size")).otherwise(0)).alias("records_at_risk"),
        F.count(F.lit(1)).alias("total_classes"),
    ).select(names[F.col("s")].alias("sensitive_column"), "min_l", "classes_with_l1",
             "records_at_risk", "total_classes")


def vulnerable_clusters(df: DataFrame, qi: list[str], k: int = 5, limit: int = 100) -> DataFrame:
    """Smallest classes below k, numbered in size order, with the count of all such classes."""
    small = equivalence_classes(df, qi).where(F.col("class_size") < k)
    total = small.agg(F.count(F.lit(1)).alias("total_vulnerable_clusters"))
    first = small.orderBy("class_size", *[F.asc_nulls_first(quoted(c)) for c in qi]).limit(limit)
    level = (F.when(F.col("class_size") == 1, "CRITICAL")
             .when(F.col("class_size") < F.lit(k / 2), "HIGH").otherwise("MODERATE"))
    # The list is at most ``limit`` rows, so numbering it in one task is fine.
    ordered = F.sort_array(F.collect_list(F.struct(
        F.col("class_size"), *[ref(c).alias(f"q{i}") for i, c in enumerate(qi)])))
    numbered = first.agg(ordered.alias("rows")).select(F.posexplode("rows").alias("pos", "r"))
    return numbered.join(F.broadcast(total)).select(
        (F.col("pos") + 1).alias("cluster_id"),
        F.col("r.class_size").alias("class_size"),
        *[F.col("r")[f"q{i}"].alias(c) for i, c in enumerate(qi)],
        F.col("total_vulnerable_clusters"),
    ).withColumn("risk_level", level)
