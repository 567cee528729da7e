"""Similarity of two attribute values, each in [0, 1] with null scoring 0."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgauge import settings
from veilgauge.functions.text import fold


def exact_similarity(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).otherwise(0.0)


def numeric_similarity(a: Column, b: Column, span: float) -> Column:
    """``1 - |a-b|/span`` floored at 0; a zero span counts as 1."""
    gap = F.abs(a.cast("double") - b.cast("double")) / F.lit(float(span) or 1.0)
    return F.coalesce(F.greatest(F.lit(0.0), F.lit(1.0) - gap), F.lit(0.0))


def date_similarity(a: Column, b: Column, horizon: int = settings.DATE_HORIZON_DAYS) -> Column:
    """``1 - days/horizon`` floored at 0, on calendar days."""
    days = F.abs(F.datediff(a, b)).cast("double")
    return F.coalesce(F.greatest(F.lit(0.0), F.lit(1.0) - days / F.lit(float(horizon))), F.lit(0.0))


def edit_similarity(a: Column, b: Column) -> Column:
    """``1 - levenshtein/longest`` on folded text; two empty strings are equal."""
    left, right = fold(a), fold(b)
    longest = F.greatest(F.length(left), F.length(right))
    ratio = F.when(longest == 0, 1.0).otherwise(
        F.lit(1.0) - F.levenshtein(left, right) / F.greatest(longest, F.lit(1)))
    return F.coalesce(ratio, F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def _matching_blocks_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([
        difflib.SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else 0.0
        for x, y in zip(a, b)
    ])


def ratcliff_similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio on folded text, in Arrow batches (no native form exists)."""
    return _matching_blocks_ratio(fold(a), fold(b))


TEXT_METHODS = {"ratcliff": ratcliff_similarity, "levenshtein": edit_similarity}
