"""Reading tables into the library and exporting them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilgauge.functions.columns import nan_to_null, ref


def safe_names(df: DataFrame) -> DataFrame:
    """Blank column names get a position-based one; everything else is kept as written."""
    if all(c.strip() for c in df.columns):
        return df
    return df.toDF(*[c if c.strip() else f"column_{i}" for i, c in enumerate(df.columns)])


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; a malformed file raises. Pass a schema to skip the inference scan."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return nan_to_null(safe_names(reader.csv(path)))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(safe_names(spark.read.parquet(path)))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("the table has no rows")
    return df.select(*[ref(c) for c in df.columns])
