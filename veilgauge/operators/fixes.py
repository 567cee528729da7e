"""Data-quality fixes. Each returns a new lazy table; nulls stay null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgauge.functions import text
from veilgauge.functions.columns import as_text, is_text, ref
from veilgauge.operators.frequencies import most_frequent
from veilgauge.operators.mitigate import _replace, moment_of
from veilgauge.operators.quantiles import as_number, exact_quantiles, iqr_fences


def trim_whitespace(df: DataFrame, column: str) -> DataFrame:
    return _replace(df, column, text.strip(as_text(column, df.schema[column].dataType)))


def standardize_case(df: DataFrame, column: str) -> DataFrame:
    if not is_text(df.schema[column].dataType):
        return df
    return _replace(df, column, text.title_words(ref(column)))


def standardize_date_format(df: DataFrame, column: str) -> DataFrame:
    return _replace(df, column, F.date_format(moment_of(df, column), "yyyy-MM-dd"))


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.distinct()


def impute_missing_median(df: DataFrame, column: str) -> DataFrame:
    median = exact_quantiles(df, [column], [0.5])[column][0]
    return _replace(df, column, F.coalesce(as_number(df, column), F.lit(median).cast("double")))


def impute_missing_mode(df: DataFrame, column: str) -> DataFrame:
    """Nulls become the most frequent value; the joined side is one row."""
    mode = most_frequent(df, column).select(F.col("value").alias("__mode"))
    joined = df.join(F.broadcast(mode), how="left")
    return joined.select(*[F.coalesce(ref(c), F.col("__mode")).alias(c) if c == column else ref(c)
                           for c in df.columns])


def remove_outliers(df: DataFrame, column: str) -> DataFrame:
    """Drop rows outside the fences the detector uses; rows without a value stay."""
    fence = iqr_fences(df, [column]).get(column)
    if fence is None or fence[0] == fence[1]:
        return df
    value = as_number(df, column)
    return df.where(value.between(F.lit(fence[2]), F.lit(fence[3])) | value.isNull())


FIXES: dict[str, Callable[..., DataFrame]] = {
    "trim_whitespace": trim_whitespace,
    "standardize_case": standardize_case,
    "standardize_date_format": standardize_date_format,
    "impute_missing_median": impute_missing_median,
    "impute_missing_mode": impute_missing_mode,
    "remove_outliers": remove_outliers,
}


def apply_fix(df: DataFrame, action: str, column: str | None) -> DataFrame:
    if action == "drop_exact_duplicates":
        return drop_exact_duplicates(df)
    fix = FIXES.get(action)
    return fix(df, column) if fix and column in df.columns else df
