"""Latest row per key and newest-first lists, as aggregations rather than sorted groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgauge.functions.columns import quoted, ref


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` values per key.

    ``max_by`` combines map-side, so a key with most of the rows stays cheap.
    """
    row = F.struct(*[ref(c) for c in df.columns])
    newest = df.groupBy(*[ref(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(
        F.max_by(row, F.struct(*[ref(c) for c in order])).alias("r"))
    return newest.select(*[F.col("r")[c].alias(c) for c in df.columns])


def newest(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    return df.orderBy(*[F.desc(quoted(c)) for c in order]).limit(limit)
