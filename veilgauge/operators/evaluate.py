"""Measuring detection and linkage against a known truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgauge.functions.columns import ref


def precision_recall(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of a predicted key set; two empty sets count as perfect."""
    p = predicted.select(*[ref(k) for k in keys], F.lit(1).alias("p"), F.lit(0).alias("t"))
    t = truth.select(*[ref(k) for k in keys], F.lit(0).alias("p"), F.lit(1).alias("t"))
    sets = p.unionByName(t).groupBy(*[ref(k) for k in keys]).agg(F.max("p").alias("p"), F.max("t").alias("t"))
    zero = F.lit(0).cast("bigint")
    counts = sets.agg(F.coalesce(F.sum("p"), zero).alias("predicted"), F.coalesce(F.sum("t"), zero).alias("actual"),
                      F.coalesce(F.sum(F.col("p") * F.col("t")), zero).alias("true_positives"))
    tp, n, m = F.col("true_positives").cast("double"), F.col("predicted"), F.col("actual")
    empty = (n == 0) & (m == 0)
    precision = F.coalesce(F.try_divide(tp, n), F.lit(0.0))
    recall = F.coalesce(F.try_divide(tp, m), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * precision * recall, precision + recall), F.lit(0.0))
    perfect = lambda c: F.when(empty, 1.0).otherwise(F.round(c, 3))
    return counts.select("predicted", "actual", "true_positives", perfect(precision).alias("precision"),
                         perfect(recall).alias("recall"), perfect(f1).alias("f1"))


def linkable_overlap(df: DataFrame, aux: DataFrame, exact: list[str], near: str, tolerance: float = 1.0) -> DataFrame:
    """Rows of ``df`` with at least one auxiliary row equal on ``exact`` and within ``tolerance`` on ``near``.

    Values fall into cells one tolerance wide. Two values in one cell are always
    near; of a neighbouring cell only the closest end matters, so every cell of
    the auxiliary side is reduced to its smallest and largest value.
    """
    cell = F.floor(ref(near).cast("double") / F.lit(float(tolerance)))
    # Equality drops nulls, so rows with a null cannot match; they only count as tested.
    tuples = df.groupBy(*[ref(c).alias(f"e{i}") for i, c in enumerate(exact)],
                        ref(near).cast("double").alias("v"), cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("copies"))
    keys = [f"e{i}" for i in range(len(exact))]
    cells = aux.where(ref(near).isNotNull()).groupBy(
        *[ref(c).alias(k) for c, k in zip(exact, keys)], cell.alias("own")).agg(
        F.min(ref(near).cast("double")).alias("low"), F.max(ref(near).cast("double")).alias("high"))
    reach = cells.withColumn("cell", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)))
    on = [tuples[k] == reach[k] for k in [*keys, "cell"]]
    close = (reach["own"] == tuples["cell"]) \
        | ((reach["own"] < tuples["cell"]) & (reach["high"] >= tuples["v"] - F.lit(float(tolerance)))) \
        | ((reach["own"] > tuples["cell"]) & (reach["low"] <= tuples["v"] + F.lit(float(tolerance))))
    matched = tuples.join(reach, [*on, close], "left_semi")
    return matched.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("linkable_records"))


def utility_retained(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows, columns and distinct values kept, from the column statistics of both versions."""
    b = before.select(F.col("column").alias("name"), F.col("unique_count").alias("distinct_before"),
                      F.col("row_count").alias("rows_before"))
    a = after.select(F.col("column").alias("name"), F.col("unique_count").alias("distinct_after"),
                     F.col("row_count").alias("rows_after"))
    both = b.join(a, "name", "left")
    shared = F.col("distinct_after").isNotNull()
    kept = F.when(shared & (F.col("distinct_before") > 0),
                  F.least(F.lit(1.0), F.col("distinct_after") / F.col("distinct_before")))
    share = both.agg(
        F.max("rows_before").alias("rows_before"), F.max("rows_after").alias("rows_after"),
        F.count(F.lit(1)).alias("columns_before"), F.count("distinct_after").alias("shared"),
        F.avg(kept).alias("kept"))
    return share.select(
        F.coalesce(F.round(F.try_divide(F.col("rows_after") * 100.0, F.col("rows_before")), 2),
                   F.lit(100.0)).alias("row_retention_pct"),
        F.round(F.col("shared") * 100.0 / F.greatest(F.lit(1), F.col("columns_before")), 2).alias("column_retention_pct"),
        F.when(F.col("shared") == 0, 0.0).otherwise(F.coalesce(F.round(F.col("kept") * 100.0, 2), F.lit(100.0)))
        .alias("avg_cardinality_retention_pct"))
