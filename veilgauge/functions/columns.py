"""Column references and schema classes that survive hostile column names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgauge import settings

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ref(name: str) -> Column:
    """Reference one top-level column whatever characters its name holds."""
    return F.col(quoted(name))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_text(f.dataType)]


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns present on both sides under the same exact name, in left order."""
    there = set(right.columns)
    return [c for c in left.columns if c in there]


def reject_nested(df: DataFrame) -> None:
    nested = [f.name for f in df.schema if isinstance(f.dataType, NESTED_TYPES)]
    if nested:
        raise ValueError(f"nested columns cannot be profiled; select or flatten them first: {nested}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Treat NaN as missing, once, where a table enters the library."""
    floats = [f for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not floats:
        return df
    names = {f.name for f in floats}
    return df.select(*[
        F.when(~F.isnan(ref(f.name)), ref(f.name)).alias(f.name) if f.name in names else ref(f.name)
        for f in df.schema
    ])


def as_text(name: str, dtype: T.DataType) -> Column:
    """Value as text: codes read as doubles lose their '.0', NaN becomes null."""
    c = ref(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        whole = (c == F.floor(c)) & (F.abs(c) < F.lit(1e15))
        text = F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
        return F.when(~F.isnan(c), text)
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    return c.cast("string")


def normalise_name(name: str) -> str:
    """Words of a column name: camelCase, snake_case and kebab-case split by spaces."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    return re.sub(r"[_-]+", " ", spaced).strip()


def first_term(terms: list[str], name: str) -> str | None:
    words = normalise_name(name)
    for term in terms:
        if re.search(r"\b" + term.replace(" ", r"\s?") + r"\b", words, re.IGNORECASE):
            return term
    return None


def is_code_like(name: str) -> bool:
    return first_term(settings.CODE_TERMS, name) is not None
