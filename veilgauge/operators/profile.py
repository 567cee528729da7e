"""Table and column profile, and the classification of columns into roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgauge import settings
from veilgauge.functions.columns import as_text, first_term, is_code_like, ref
from veilgauge.operators.frequencies import _lookup, column_statistics, duplicate_summary


def semantic_type(code_like: Column) -> Column:
    """numeric / datetime / categorical / text, from whole-column statistics."""
    values = F.col("row_count") - F.col("missing_count")
    wide = F.greatest(F.lit(20.0), F.lit(0.2) * F.col("row_count"))
    return (F.when(code_like, "categorical")
            .when(F.col("numeric"), "numeric")
            .when(F.col("temporal"), "datetime")
            .when(values == 0, "text")
            .when(F.col("parsed_rows") > F.lit(0.8) * values, "datetime")
            .when((F.col("unique_count") <= wide) & (F.col("average_chars") < 25), "categorical")
            .otherwise("text"))


def describe(stats: DataFrame, names: list[str]) -> DataFrame:
    """Profile rows from a column-statistics frame of a table with these column names."""
    code_like = _lookup(F.col("ordinal"), [is_code_like(c) for c in names])
    rows = F.col("row_count")
    ratio = F.coalesce(F.round(F.try_divide(F.col("unique_count").cast("double"), rows), 4), F.lit(0.0))
    return stats.select(
        "ordinal", F.col("column").alias("name"), "dtype",
        semantic_type(code_like).alias("inferred_type"),
        "row_count", "missing_count",
        F.coalesce(F.round(F.try_divide(F.col("missing_count") * F.lit(100.0), rows), 2),
                   F.lit(0.0)).alias("missing_pct"),
        "unique_count",
        ratio.alias("cardinality_ratio"),
        (F.col("unique_count") <= 1).alias("is_constant"),
        (ratio > 0.9).alias("is_high_cardinality"),
    )


def profile_columns(df: DataFrame) -> DataFrame:
    """One row per column: types, missing and distinct counts, cardinality flags."""
    return describe(column_statistics(df), df.columns)


def profile_samples(df: DataFrame, limit: int = 5) -> DataFrame:
    """The ``limit`` smallest distinct values of each column, as text."""
    fields = list(df.schema)
    narrow = df.select(*[as_text(f.name, f.dataType).alias(str(i)) for i, f in enumerate(fields)])
    tall = narrow.unpivot([], [ref(c) for c in narrow.columns], "ordinal", "value")
    values = tall.where(F.col("value").isNotNull()).groupBy("ordinal", "value").agg(F.count(F.lit(1)).alias("n"))
    # Each task keeps its own first few before the shuffle (window group limit).
    rank = F.row_number().over(Window.partitionBy("ordinal").orderBy("value"))
    kept = values.select("ordinal", "value", rank.alias("sample_rank")).where(F.col("sample_rank") <= limit)
    names = F.create_map(*[x for i, f in enumerate(fields) for x in (F.lit(str(i)), F.lit(f.name))])
    return kept.select(names[F.col("ordinal")].alias("name"), "sample_rank", "value")


def profile_table(df: DataFrame) -> DataFrame:
    """One row: rows, columns, exact duplicates and missing cells of the whole table."""
    missing = df.agg(F.coalesce(
        F.sum(sum((F.when(as_text(f.name, f.dataType).isNull(), 1).otherwise(0) for f in df.schema),
                  F.lit(0))), F.lit(0)).alias("total_missing_cells"))
    return duplicate_summary(df).join(F.broadcast(missing)).select(
        "row_count", F.lit(len(df.columns)).alias("column_count"),
        "duplicate_rows", "duplicate_pct", "total_missing_cells")


def classify_columns(profile: DataFrame, names: list[str]) -> DataFrame:
    """Role, confidence and reasons per column, from its name first and its statistics second.

    Names are matched against the term lists up front (they are schema, not
    data); the statistics stay a Spark expression over the profile frame.
    """
    o = F.col("ordinal")
    direct = _lookup(o, [first_term(settings.DIRECT_TERMS, c) for c in names]).cast("string")
    sensitive = _lookup(o, [first_term(settings.SENSITIVE_TERMS, c) for c in names]).cast("string")
    quasi = _lookup(o, [first_term(settings.QUASI_TERMS, c) for c in names]).cast("string")
    ratio, kind = F.col("cardinality_ratio"), F.col("inferred_type")

    cases = [
        (direct.isNotNull() & (ratio > 0.85), "direct_identifier", 0.95,
         [F.concat(F.lit("Name matches the direct-identifier term '"), direct, F.lit("'")),
          F.lit("Nearly every value is distinct, as in an identifier")]),
        (direct.isNotNull(), "direct_identifier", 0.90,
         [F.concat(F.lit("Name matches the direct-identifier term '"), direct, F.lit("'"))]),
        (sensitive.isNotNull(), "sensitive_attribute", 0.85,
         [F.concat(F.lit("Name matches the sensitive-attribute term '"), sensitive, F.lit("'"))]),
        (quasi.isNotNull(), "quasi_identifier", 0.80,
         [F.concat(F.lit("Name matches the quasi-identifier term '"), quasi, F.lit("'"))]),
        ((ratio > 0.9) & kind.isin("text", "numeric"), "possible_direct_identifier", 0.55,
         [F.lit("No term matches, but values are almost all distinct")]),
        ((kind == "categorical") & (ratio > 0.001) & (ratio < 0.5), "possible_quasi_identifier", 0.45,
         [F.lit("No term matches; a category of moderate cardinality may identify in combination")]),
    ]

    def choose(pick, fallback):
        chain = F.when(cases[0][0], pick(cases[0]))
        for case in cases[1:]:
            chain = chain.when(case[0], pick(case))
        return chain.otherwise(fallback)

    return profile.select(
        "ordinal", F.col("name").alias("column"),
        choose(lambda c: F.lit(c[1]), F.lit("unclassified")).alias("category"),
        choose(lambda c: F.lit(c[2]), F.lit(0.35)).alias("confidence"),
        choose(lambda c: F.array(*c[3]), F.array(F.lit("No signal; classify by hand if needed"))).alias("reasons"),
        "inferred_type", "unique_count", "cardinality_ratio",
    )


ROLES = {
    "direct": ("direct_identifier", "possible_direct_identifier"),
    "quasi": ("quasi_identifier", "possible_quasi_identifier"),
    "sensitive": ("sensitive_attribute",),
}


def roles(classified_rows: list) -> dict[str, list[str]]:
    """Column names per role from collected classification rows (one row per column)."""
    ordered = sorted(classified_rows, key=lambda r: r["ordinal"])
    return {role: [r["column"] for r in ordered if r["category"] in categories]
            for role, categories in ROLES.items()}


__all__ = ["classify_columns", "describe", "profile_columns", "profile_samples",
           "profile_table", "roles", "semantic_type"]
