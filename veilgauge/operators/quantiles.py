"""Exact quantiles of many columns in a fixed number of passes.

``percentile`` and ``median`` keep every distinct value of a column in one task. Here
values are counted per (column, value), which splits the most frequent ones no further
than one row each, and the counts are dealt out by ranges and sorted. Counts per range
tell which range holds a rank, and only those ranges are looked at once more. So the
source is read once, and all columns, probabilities and both neighbours of a rank share
the same four small jobs, whatever the number of distinct values.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgauge import settings
from veilgauge.functions.columns import is_text, ref
from veilgauge.session import materialise


def as_number(df: DataFrame, column: str):
    """Numeric view of a column; text that is not a number, and NaN, become null."""
    dtype = df.schema[column].dataType
    c = ref(column).try_cast("double") if is_text(dtype) else ref(column).cast("double")
    return F.when(~F.isnan(c), c)


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column; ``None`` for a column without values."""
    if not columns:
        return {}
    numbers = df.select(*[as_number(df, c).alias(str(i)) for i, c in enumerate(columns)])
    tall = numbers.unpivot([], [ref(c) for c in numbers.columns], "i", "v").where("v is not null")
    counts, _ = materialise(tall.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")))
    ranged, _ = materialise(counts.repartitionByRange("i", "v").withColumn("part", F.spark_partition_id()))
    # One row per range and column: as many as there are partitions, whatever the data.
    held = sorted(((r["i"], r["part"], r["n"]) for r in ranged.groupBy("i", "part").agg(F.sum("n").alias("n")).collect()))
    wanted = [place for i in range(len(columns)) for place in _places(str(i), [h for h in held if h[0] == str(i)], probabilities)]
    found = {}
    if wanted:
        looked = df.sparkSession.createDataFrame(wanted, "i string, rank long, part int, inside long")
        upto = F.sum("n").over(Window.partitionBy("i", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        inside = ranged.where(F.col("part").isin(sorted({w[2] for w in wanted}))).withColumn("upto", upto)
        found = {(r["i"], r["rank"]): r["v"] for r in inside.join(F.broadcast(looked), ["i", "part"])
                 .where("upto - n <= inside and inside < upto").select("i", "rank", "v").collect()}
    totals = {str(i): sum(n for j, _, n in held if j == str(i)) for i in range(len(columns))}
    return {c: [_interpolated(found, str(i), totals[str(i)], p) for p in probabilities] for i, c in enumerate(columns)}


def _ranks(total: int, probability: float) -> tuple[int, float]:
    """0-based rank below a quantile, and how far the quantile lies above it."""
    position = probability * (total - 1)
    return math.floor(position), position - math.floor(position)


def _places(column: str, held: list[tuple], probabilities: list[float]) -> list[tuple[str, int, int, int]]:
    """(column, rank, range, rank within the range) for the neighbours of every quantile."""
    total = sum(n for _, _, n in held)
    ranks = sorted({r for p in probabilities for low, above in [_ranks(total, p)] for r in (low, low + (above > 0))} if total else [])
    found, before, parts = [], 0, iter(held)
    _, part, n = next(parts, (column, 0, 0))
    for rank in ranks:
        while rank >= before + n:
            before += n
            _, part, n = next(parts)
        found.append((column, rank, part, rank - before))
    return found


def _interpolated(found: dict, column: str, total: int, probability: float) -> float | None:
    if not total:
        return None
    low, above = _ranks(total, probability)
    lower = found[column, low]
    return lower + (found[column, low + 1] - lower) * above if above else lower


def iqr_fences(df: DataFrame, columns: list[str], multiple: float = settings.IQR_MULTIPLE) -> dict:
    """``column -> (q1, q3, lower, upper)``; columns without values are left out."""
    fences = {}
    for column, (q1, q3) in exact_quantiles(df, columns, [0.25, 0.75]).items():
        if q1 is not None:
            spread = q3 - q1
            fences[column] = (q1, q3, q1 - multiple * spread, q3 + multiple * spread)
    return fences
