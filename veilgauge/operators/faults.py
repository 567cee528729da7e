"""Deterministic fault injection and noisy auxiliary tables, for measuring detectors and attacks.

Every choice is a rule on a hash of the row key, so a rerun or a retried task
makes the same choice, and the truth is known without storing it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgauge.functions.columns import is_numeric, is_text, ref
from veilgauge.operators.frequencies import column_statistics
from veilgauge.operators.mitigate import _replace, moment_of
from veilgauge.session import pin

DATE_STYLES = ["dd/MM/yyyy", "MM-dd-yyyy", "yyyy.MM.dd", "dd MMM yyyy"]
BROKEN_DATE = "not-a-date"
ORDER_BUCKETS = 4096
NOISE_KEY_OFFSET = 1_000_000_000_000


def draw(key: Column, label: str, buckets: int, digits: int = 8) -> Column:
    """A number below ``buckets`` fixed by the key and the label, from so many hexadecimal digits of a hash."""
    digest = F.md5(F.concat(F.lit(label + ":"), key.cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint"), F.lit(buckets))


def chosen(key: Column, label: str, percent: float) -> Column:
    return draw(key, label, 10000) < F.lit(int(percent * 100))


def fault_columns(df: DataFrame, key: str) -> dict[str, str | None]:
    """Which column receives which fault, from the schema and one statistics pass."""
    numbers = [f.name for f in df.schema if is_numeric(f.dataType) and f.name != key]
    texts = [f.name for f in df.schema if is_text(f.dataType) and f.name != key]
    few = {r["column"] for r in column_statistics(df.select(*[ref(c) for c in texts]))
           .where("unique_count <= 10").collect()} if texts else set()
    case = next((c for c in texts if c in few), None)
    return {
        "missing_number": numbers[0] if numbers else None,
        "missing_text": texts[1] if len(texts) > 1 else None,
        "case": case,
        "padding": next((c for c in texts if c != case), texts[0] if texts else None),
        "date": next((c for c in df.columns if "date" in c.lower()), None),
    }


def inject_quality_faults(df: DataFrame, key: str, columns: dict[str, str | None] | None = None,
                          duplicates: float = 6.67, missing_number: float = 12.0, missing_text: float = 8.0,
                          case: float = 30.0, padding: float = 15.0, date_style: float = 20.0,
                          date_broken: float = 2.0) -> DataFrame:
    """Corrupt the given percentages of rows; appended copies stay exact copies."""
    at = columns or fault_columns(df, key)
    k = ref(key)
    out = df
    if at.get("missing_number"):
        c = at["missing_number"]
        out = _replace(out, c, F.when(~chosen(k, "missing_number", missing_number), ref(c)))
    if at.get("missing_text"):
        c = at["missing_text"]
        out = _replace(out, c, F.when(~chosen(k, "missing_text", missing_text), ref(c)))
    if at.get("case"):
        c = at["case"]
        style = draw(k, "case_style", 3)
        recased = F.when(style == 0, F.upper(ref(c))).when(style == 1, F.lower(ref(c))).otherwise(F.initcap(ref(c)))
        out = _replace(out, c, F.when(chosen(k, "case", case), recased).otherwise(ref(c)))
    if at.get("padding"):
        c = at["padding"]
        out = _replace(out, c, F.when(chosen(k, "padding", padding),
                                      F.concat(F.lit("  "), ref(c), F.lit("  "))).otherwise(ref(c)))
    if at.get("date"):
        c = at["date"]
        moment, style = moment_of(out, c), draw(k, "date_style", len(DATE_STYLES))
        restyled = F.lit(None).cast("string")
        for i, pattern in enumerate(DATE_STYLES):
            restyled = F.when(style == i, F.date_format(moment, pattern)).otherwise(restyled)
        out = _replace(out, c, F.when(chosen(k, "date_broken", date_broken), BROKEN_DATE)
                       .when(chosen(k, "date", date_style), F.coalesce(restyled, ref(c).cast("string")))
                       .otherwise(ref(c).cast("string")))
    out = out.withColumn("data_source", F.lit("generated"))
    return out.unionByName(out.where(chosen(k, "duplicate", duplicates)))


def derive_auxiliary(df: DataFrame, key: str, exact: list[str], jitter: str, coverage: float = 70.0,
                     noise: float = 20.0) -> DataFrame:
    """What an attacker may hold: ``coverage`` percent of rows, one number off by at most one, plus strangers.

    Strangers draw every attribute from all its values, as often as they occur, each
    from another row, so they look real but belong to nobody.
    """
    k = ref(key)
    off = F.element_at(F.array(F.lit(-1), F.lit(0), F.lit(0), F.lit(1)), (draw(k, "jitter", 4) + 1).cast("int"))
    known = df.where(chosen(k, "coverage", coverage)).select(
        k.cast("bigint").alias(key), (ref(jitter) + off).cast("int").alias(jitter), *[ref(c) for c in exact])
    spread = df.agg(F.min(ref(jitter)), F.max(ref(jitter))).first()
    low, width = int(spread[0] or 0), int((spread[1] or 0) - (spread[0] or 0)) + 1
    strangers = df.where(chosen(k, "noise", noise)).select(
        k.cast("bigint").alias("__key"), (F.lit(low) + draw(k, "noise_value", width)).cast("int").alias(jitter))
    for c in exact:
        strangers = _with_drawn(strangers, df, key, c)
    return known.unionByName(strangers.select((F.col("__key") + F.lit(NOISE_KEY_OFFSET)).alias(key), ref(jitter), *[ref(c) for c in exact]))


def _with_drawn(strangers: DataFrame, df: DataFrame, key: str, column: str) -> DataFrame:
    """Each stranger with the value of `column` of a row drawn evenly among those that have one.

    Rows are numbered in an order their keys fix: a number of rows before each of
    `ORDER_BUCKETS` buckets, and a place within the bucket. The number drawn is
    looked up by a join in which no key is met by more than one row.
    """
    held = df.where(ref(column).isNotNull()).select(
        draw(ref(key), "order", ORDER_BUCKETS).alias("bucket"), ref(key).alias("__row"), ref(column).alias(column))
    # One row per bucket, so this window stays small whatever the table.
    counts = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = pin(counts.select("bucket", "n", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before")))
    rows = before.agg(F.sum("n")).first()[0] or 0
    if not rows:
        return strangers.withColumn(column, F.lit(None).cast(df.schema[column].dataType))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("__row")) - 1
    numbered = held.withColumn("place", place).join(F.broadcast(before), "bucket").select(
        (F.col("before") + F.col("place")).alias("__drawn"), ref(column))
    return strangers.withColumn("__drawn", draw(F.col("__key"), column, rows, digits=15)).join(numbered, "__drawn").drop("__drawn")
