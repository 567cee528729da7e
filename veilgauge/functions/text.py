"""Text normalisation expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode-aware: Spark's trim() removes plain spaces only.
_EDGES = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def fold(c: Column) -> Column:
    return F.lower(strip(c))


def title_words(c: Column) -> Column:
    """Title-case labels; values holding a digit are codes and stay as they are."""
    return F.when(c.rlike(r"\d"), c).otherwise(F.initcap(strip(c)))


def digit_mask(c: Column) -> Column:
    return F.regexp_replace(c, r"\d", "#")


def keep_prefix(c: Column, keep: int) -> Column:
    """First ``keep`` characters, the rest replaced by asterisks."""
    hidden = F.greatest(F.lit(0), F.length(c) - F.lit(keep))
    return F.concat(F.substring(c, 1, keep), F.repeat(F.lit("*"), hidden))
