"""The first rows of every key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best(df: DataFrame, keys: list[str], order: list[Column], top: int) -> DataFrame:
    """First ``top`` rows per key; Spark cuts every task's rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= top)


def packed(df: DataFrame, keys: list[str], order: list[Column], top: int, item: Column, name: str) -> DataFrame:
    """One row per key holding its first ``top`` items in order.

    The rows arrive sorted from the ranking, so a short frame collects them
    without another sort or shuffle.
    """
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, top - 1)
    return best(df, keys, order, top).withColumn(name, F.collect_list(item).over(frame)).where(F.col("__rank") == 1)
