"""The column-value frequency table: how often each value occurs in each column.

One unpivot and one map-side-combined aggregation feed missing and distinct
counts, modes, top values, class balance, case and whitespace checks. Values
longer than ``LONG_TEXT`` travel as digests of their whole text, so free-text
columns shuffle a few dozen bytes per row instead of the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgauge.functions import dates, text
from veilgauge.functions.columns import as_text, is_numeric, is_temporal, is_text, ref, reject_nested

LONG_TEXT = 128


def _digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def _short_or_digest(c: Column) -> Column:
    """A normalised text itself, or its digest if it is long after normalising."""
    return F.when(F.length(c) > LONG_TEXT, _digest(c)).otherwise(c)


def value_frequencies(df: DataFrame) -> DataFrame:
    """``(ordinal, value, digest, stripped_digest, folded_digest, chars, padded, date_like, n)``.

    ``value`` is null for missing cells and for long texts; a long text is
    known by its ``digest`` and the facts about it computed before hashing.
    """
    reject_nested(df)
    fields = list(df.schema)
    texts = [i for i, f in enumerate(fields) if is_text(f.dataType)]
    narrow = df.select(*[as_text(f.name, f.dataType).alias(str(i)) for i, f in enumerate(fields)])
    tall = narrow.unpivot([], [ref(c) for c in narrow.columns], "ordinal", "value")
    long = F.length("value") > LONG_TEXT
    v = F.col("value")
    if texts:
        tall = tall.select(
            F.col("ordinal").cast("int").alias("ordinal"),
            F.when(~long, v).alias("value"),
            F.when(long, _digest(v)).alias("digest"),
            F.when(long, _short_or_digest(text.strip(v))).alias("stripped_digest"),
            F.when(long, _short_or_digest(text.fold(v))).alias("folded_digest"),
            F.when(long, F.length(v)).alias("chars"),
            F.when(long, v != text.strip(v)).alias("padded"),
            F.when(long, dates.date_like(v)).alias("date_like"),
        )
    else:
        tall = tall.select(
            F.col("ordinal").cast("int").alias("ordinal"), "value",
            *[F.lit(None).cast("string").alias(c) for c in ("digest", "stripped_digest", "folded_digest")],
            F.lit(None).cast("int").alias("chars"),
            F.lit(None).cast("boolean").alias("padded"),
            F.lit(None).cast("boolean").alias("date_like"),
        )
    return tall.groupBy(*tall.columns).agg(F.count(F.lit(1)).alias("n"))


def _lookup(ordinal: Column, values: list) -> Column:
    """A per-column constant, by column position."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), ordinal + 1)


def column_statistics(df: DataFrame) -> DataFrame:
    """One row per column with every count the profile and the detectors need.

    Distinct values, distinct trimmed values and distinct trimmed lower-case
    values come from re-aggregating the frequency table three times, each on a
    coarser key, instead of one aggregate with several distinct counts.
    """
    fields = list(df.schema)
    freq = value_frequencies(df)
    present = F.col("value").isNotNull() | F.col("digest").isNotNull()
    textual = _lookup(F.col("ordinal"), [is_text(f.dataType) for f in fields])
    short = F.col("value")
    # A padded date may be long as it stands; what is left without the padding is short.
    undressed = F.coalesce(short, "stripped_digest")
    parsed = F.when(textual, dates.parse_mixed(undressed)).isNotNull()

    facts = freq.select(
        "ordinal", "n",
        present.alias("present"),
        F.coalesce("stripped_digest", F.when(textual, text.strip(short)).otherwise(short)).alias("stripped"),
        F.coalesce("folded_digest", F.when(textual, _short_or_digest(text.fold(short))).otherwise(short)).alias("folded"),
        F.coalesce("chars", F.length(short)).alias("chars"),
        F.coalesce("padded", textual & (short != text.strip(short)), F.lit(False)).alias("padded"),
        F.coalesce("date_like", textual & dates.date_like(short), F.lit(False)).alias("date_like"),
        parsed.alias("parsed"),
        F.when(parsed, text.digit_mask(undressed)).alias("pattern"),
    )
    n = F.col("n")

    def rows_where(flag: str) -> Column:
        return F.sum(F.when(F.col(flag), n).otherwise(0))

    by_stripped = facts.groupBy("ordinal", "present", "stripped", "folded").agg(
        F.count(F.lit(1)).alias("values"), F.sum(n).alias("n"),
        F.sum(n * F.col("chars")).alias("chars"),
        rows_where("padded").alias("padded_rows"),
        rows_where("date_like").alias("date_like_rows"),
        rows_where("parsed").alias("parsed_rows"),
        F.max(n).alias("top_rows"),
    )
    sums = ["values", "n", "chars", "padded_rows", "date_like_rows", "parsed_rows"]
    by_folded = by_stripped.groupBy("ordinal", "present", "folded").agg(
        F.count(F.lit(1)).alias("stripped_values"),
        *[F.sum(c).alias(c) for c in sums], F.max("top_rows").alias("top_rows"))

    def over_present(expr: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("present"), expr)), F.lit(0))

    per_column = by_folded.groupBy("ordinal").agg(
        F.sum(n).alias("row_count"),
        F.coalesce(F.sum(F.when(~F.col("present"), n)), F.lit(0)).alias("missing_count"),
        over_present(F.col("values")).alias("unique_count"),
        over_present(F.col("stripped_values")).alias("stripped_unique"),
        over_present(F.lit(1)).alias("folded_unique"),
        over_present(F.col("chars")).alias("chars"),
        over_present(F.col("padded_rows")).alias("padded_rows"),
        over_present(F.col("date_like_rows")).alias("date_like_rows"),
        over_present(F.col("parsed_rows")).alias("parsed_rows"),
        F.coalesce(F.max(F.when(F.col("present"), F.col("top_rows"))), F.lit(0)).alias("top_rows"),
    )
    patterns = (facts.where(F.col("pattern").isNotNull()).groupBy("ordinal", "pattern").agg(F.sum(n).alias("n"))
                .groupBy("ordinal").agg(F.count(F.lit(1)).alias("pattern_count")))
    o = F.col("ordinal")
    return per_column.join(patterns, "ordinal", "left").select(
        "ordinal",
        _lookup(o, [f.name for f in fields]).alias("column"),
        _lookup(o, [f.dataType.simpleString() for f in fields]).alias("dtype"),
        _lookup(o, [is_numeric(f.dataType) for f in fields]).alias("numeric"),
        _lookup(o, [is_temporal(f.dataType) for f in fields]).alias("temporal"),
        _lookup(o, [is_text(f.dataType) for f in fields]).alias("textual"),
        "row_count", "missing_count", "unique_count", "stripped_unique", "folded_unique",
        F.coalesce(F.try_divide(F.col("chars").cast("double"), F.col("row_count") - F.col("missing_count")),
                   F.lit(0.0)).alias("average_chars"),
        "padded_rows", "date_like_rows", "parsed_rows",
        F.coalesce("pattern_count", F.lit(0)).alias("pattern_count"),
        "top_rows",
    )


def top_values(df: DataFrame, column: str, limit: int = 5) -> DataFrame:
    """The ``limit`` most frequent values; ties go to the smaller value. Nulls are not values."""
    counts = df.where(ref(column).isNotNull()).groupBy(ref(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("value")).limit(limit)


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """One row holding the mode (smallest value on ties); null when there is no value."""
    counts = df.where(ref(column).isNotNull()).groupBy(ref(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))


def class_balance(df: DataFrame, column: str) -> DataFrame:
    """Rows and share of each non-null value of a label column."""
    counts = df.where(ref(column).isNotNull()).groupBy(ref(column).alias("label")).agg(
        F.count(F.lit(1)).alias("records"))
    total = counts.agg(F.sum("records").alias("total"))
    return counts.join(F.broadcast(total)).select(
        "label", "records", F.round(F.col("records") / F.col("total"), 6).alias("share"))


def duplicate_summary(df: DataFrame) -> DataFrame:
    """Rows, surplus copies of exact duplicates and their percentage, in one row."""
    groups = df.groupBy(*row_key(df)).agg(F.count(F.lit(1)).alias("n"))
    totals = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    pct = F.coalesce(F.round(F.try_divide(F.col("duplicate_rows") * F.lit(100.0), F.col("row_count")), 2),
                     F.lit(0.0))
    return totals.withColumn("duplicate_pct", pct)


def row_key(df: DataFrame) -> list[Column]:
    """Columns that decide whether two rows are equal; long texts compare by digest."""
    keys = []
    for i, f in enumerate(df.schema):
        c = ref(f.name)
        if is_text(f.dataType):
            c = F.when(F.length(c) > LONG_TEXT, F.concat(F.lit("\u0000sha256:"), _digest(c))).otherwise(c)
        keys.append(c.alias(f"k{i}"))
    return keys


def duplicate_flags(df: DataFrame, key: str, subset: list[str] | None = None) -> DataFrame:
    """Each row with ``is_duplicate``: true for every copy but the one with the smallest key.

    Copies are recognised on ``subset`` (all columns but the key by default).
    """
    from veilgauge.operators.skew import attach

    columns = subset or [c for c in df.columns if c != key]
    keyed = df.select(ref(key).alias("__key"), *row_key(df.select(*[ref(c) for c in columns])))
    parts = [c for c in keyed.columns if c != "__key"]
    groups = keyed.groupBy(*parts).agg(F.min("__key").alias("__first"), F.count(F.lit(1)).alias("__n"))
    flagged = attach(keyed, groups, parts, "__n", ["__first"], "inner")
    return flagged.select(F.col("__key").alias(key), (F.col("__key") != F.col("__first")).alias("is_duplicate"))
