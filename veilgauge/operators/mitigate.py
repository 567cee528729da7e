"""Generalisation and suppression: recommend, apply, and the value expressions behind both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgauge import settings
from veilgauge.functions import dates
from veilgauge.functions.columns import as_text, is_temporal, ref
from veilgauge.functions.text import keep_prefix
from veilgauge.operators.frequencies import top_values

OTHER = "Other"


def _number(text: Column) -> Column:
    n = text.try_cast("double")
    return F.when(~F.isnan(n), n)


def age_band(text: Column, band_size: int = 5) -> Column:
    """``20-24``; anything that is not a number becomes null."""
    low = (F.floor(_number(text) / F.lit(band_size)) * F.lit(band_size)).cast("bigint")
    return F.concat(low.cast("string"), F.lit("-"), (low + F.lit(band_size - 1)).cast("string"))


def bucket(text: Column, bucket_size: int = 10000) -> Column:
    """``0-10000``: the upper label is the next bucket's lower label."""
    low = (F.floor(_number(text) / F.lit(bucket_size)) * F.lit(bucket_size)).cast("bigint")
    return F.concat(low.cast("string"), F.lit("-"), (low + F.lit(bucket_size)).cast("string"))


def truncate(text: Column, keep_digits: int = 3) -> Column:
    return keep_prefix(text, keep_digits)


def generalise_date(moment: Column, granularity: str = "month") -> Column:
    """``January 2026``, ``2026Q1`` or ``2026``."""
    if granularity == "month":
        return F.date_format(moment, "MMMM yyyy")
    if granularity == "quarter":
        return F.concat(F.year(moment).cast("string"), F.lit("Q"), F.quarter(moment).cast("string"))
    return F.year(moment).cast("string")


def moment_of(df: DataFrame, column: str) -> Column:
    dtype = df.schema[column].dataType
    return ref(column) if is_temporal(dtype) else dates.parse_mixed(as_text(column, dtype))


# --- Transforms: (table, column, parameters) -> table ------------------------

def _replace(df: DataFrame, column: str, value: Column) -> DataFrame:
    return df.select(*[value.alias(c) if c == column else ref(c) for c in df.columns])


def _text(df: DataFrame, column: str) -> Column:
    return as_text(column, df.schema[column].dataType)


def apply_age_band(df: DataFrame, column: str, band_size: int = 5, **_) -> DataFrame:
    return _replace(df, column, age_band(_text(df, column), int(band_size)))


def apply_bucket(df: DataFrame, column: str, bucket_size: int = 10000, **_) -> DataFrame:
    return _replace(df, column, bucket(_text(df, column), int(bucket_size)))


def apply_truncation(df: DataFrame, column: str, keep_digits: int = 3, **_) -> DataFrame:
    return _replace(df, column, truncate(_text(df, column), int(keep_digits)))


def apply_date_generalisation(df: DataFrame, column: str, granularity: str = "month", **_) -> DataFrame:
    return _replace(df, column, generalise_date(moment_of(df, column), granularity))


def apply_suppression(df: DataFrame, column: str, **_) -> DataFrame:
    return df.select(*[ref(c) for c in df.columns if c != column])


def apply_top_values(df: DataFrame, column: str, keep_top_n: int = 5, **_) -> DataFrame:
    """Keep the most frequent values, everything else (nulls too) becomes ``Other``.

    The kept values are ``keep_top_n`` rows, so that side is broadcast.
    """
    kept = top_values(df, column, int(keep_top_n)).select(F.col("value").alias("__kept"))
    joined = df.join(F.broadcast(kept), ref(column) == F.col("__kept"), "left")
    label = F.coalesce(F.col("__kept").cast("string") if not isinstance(df.schema[column].dataType, T.StringType)
                       else F.col("__kept"), F.lit(OTHER))
    return joined.select(*[label.alias(c) if c == column else ref(c) for c in df.columns])


ACTIONS: dict[str, Callable[..., DataFrame]] = {
    "generalization_bucketing": apply_age_band,
    "truncation_generalization": apply_truncation,
    "date_generalization": apply_date_generalisation,
    "generalization": apply_top_values,
    "suppression": apply_suppression,
    "bucketing": apply_bucket,
}


def apply_mitigations(df: DataFrame, steps: list[dict]) -> DataFrame:
    """Apply ``{column, action, params}`` steps in order as one lazy plan.

    Unknown actions and absent columns leave the table as it is.
    """
    for step in steps:
        action = ACTIONS.get(step["action"])
        if action and step["column"] in df.columns:
            params = {k: v for k, v in (step.get("params") or {}).items() if k != "column"}
            df = action(df, step["column"], **params)
    return df


def recommend(classified: DataFrame) -> DataFrame:
    """One mitigation per quasi-identifier that needs one, from its statistics."""
    name = F.lower("column")
    kind, ratio, distinct = F.col("inferred_type"), F.col("cardinality_ratio"), F.col("unique_count")
    postal = dates.any_of([name.contains(t) for t in settings.POSTAL_TERMS])
    action = (F.when((kind == "numeric") & (name.contains("age") | (ratio > 0.05)), "generalization_bucketing")
              .when(postal, "truncation_generalization")
              .when((kind == "datetime") | name.contains("date"), "date_generalization")
              .when((kind == "categorical") & (distinct <= settings.LOW_CARDINALITY), F.lit(None))
              .when((kind == "categorical") & (ratio > 0.5), "suppression")
              .otherwise("generalization"))
    quoted = F.concat(F.lit("'"), F.col("column"), F.lit("'"))
    texts = {
        "generalization_bucketing": ("Group {} into ranges such as 5-year bands.",
                                     "Exact numbers split records into small classes."),
        "truncation_generalization": ("Keep only the leading characters of {}.",
                                      "A full postal code narrows a person down to a small area."),
        "date_generalization": ("Reduce {} to month or quarter.",
                                "Exact dates together with other attributes form very small classes."),
        "suppression": ("Remove {}.",
                        "Almost every value differs, so no generalisation would hide a record."),
        "generalization": ("Keep the most common values of {} and merge the rest into 'Other'.",
                           "Rare values form small classes; merging them keeps the column usable."),
    }

    def pick(part: int) -> Column:
        chain = None
        for key, pair in texts.items():
            before, _, after = pair[part].partition("{}")
            value = F.concat(F.lit(before), quoted, F.lit(after)) if part == 0 else F.lit(pair[1])
            chain = F.when(F.col("action") == key, value) if chain is None \
                else chain.when(F.col("action") == key, value)
        return chain

    quasi = classified.where(F.col("category").isin("quasi_identifier", "possible_quasi_identifier"))
    return (quasi.withColumn("action", action).where(F.col("action").isNotNull())
            .select("ordinal", "column", "action", pick(0).alias("description"), pick(1).alias("reason")))


def as_steps(recommended_rows: list) -> list[dict]:
    """Collected recommendation rows (one per column) as ordered steps."""
    return [{"column": r["column"], "action": r["action"]}
            for r in sorted(recommended_rows, key=lambda r: r["ordinal"])]
