"""An approximate profile that merges: opt-in, for tables that only ever grow.

One pass leaves one row per column with exact counts, a HyperLogLog sketch of its values
and, for numbers, a KLL sketch. Rows of two profiles of the same columns merge to the
profile of both tables, so a new version needs a pass over its new rows only. Sketches
have a fixed size whatever the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgauge.functions.columns import as_text, is_numeric, ref, reject_nested
from veilgauge.operators.quantiles import as_number

#: Logarithm of the number of registers, and the standard error that follows from it (1.04 / sqrt(registers)).
REGISTERS = 14
DISTINCT_ERROR = 1.04 / (1 << REGISTERS) ** 0.5
#: Size of the quantile sketch; ranks are off by about 2.3 / K ** 0.9 at most, with 99 % confidence.
K = 400
RANK_ERROR = 2.3 / K ** 0.9


def column_sketches(df: DataFrame) -> DataFrame:
    """(ordinal, column, row_count, missing_count, distinct, numbers): the state of every column, in one pass."""
    reject_nested(df)
    aggregates, rows = [F.count(F.lit(1)).alias("rows")], []
    for i, f in enumerate(df.schema):
        value = as_text(f.name, f.dataType)
        aggregates += [F.count(value).alias(f"n{i}"), F.hll_sketch_agg(value, REGISTERS).alias(f"d{i}")]
        numbers = F.lit(None).cast("binary")
        if is_numeric(f.dataType):
            aggregates.append(F.kll_sketch_agg_double(as_number(df, f.name), F.lit(K)).alias(f"q{i}"))
            numbers = F.col(f"q{i}")
        rows.append(F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("column"), F.col("rows").alias("row_count"),
                             (F.col("rows") - F.col(f"n{i}")).alias("missing_count"), F.col(f"d{i}").alias("distinct"),
                             numbers.alias("numbers")))
    return df.agg(*aggregates).select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def merged(*profiles: DataFrame) -> DataFrame:
    """The state of all tables together from the states of each; columns go by name."""
    both = profiles[0]
    for p in profiles[1:]:
        both = both.unionByName(p)
    return both.groupBy("column").agg(
        F.min("ordinal").alias("ordinal"), F.sum("row_count").alias("row_count"), F.sum("missing_count").alias("missing_count"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("numbers", F.lit(K)).alias("numbers")).select(*both.columns)


def estimates(profile: DataFrame, shares: list[float] = [0.25, 0.5, 0.75]) -> DataFrame:  # noqa: B006
    """Readable figures of a state: approximate distinct values, and quantiles of numeric columns (null elsewhere)."""
    # A sketch that was never merged also knows in which order values came; a union leaves its registers alone to decide.
    has = F.col("numbers").isNotNull() & (F.kll_sketch_get_n_double("numbers") > 0)
    return profile.select(
        "ordinal", "column", "row_count", "missing_count", F.hll_sketch_estimate(F.hll_union("distinct", "distinct")).alias("approx_distinct"),
        F.array(*[F.when(has, F.kll_sketch_get_quantile_double(F.col("numbers"), F.lit(s))) for s in shares]).alias("quantiles"))
