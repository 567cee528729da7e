"""Threshold ladders: a value mapped to the label of its band."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilgauge import settings


def step_up(value: Column, steps: list[tuple[float, str]], below: str) -> Column:
    """Label of the highest step reached (``>=``); steps are ascending."""
    chain = None
    for bound, label in reversed(steps):
        chain = F.when(value >= F.lit(float(bound)), label) if chain is None \
            else chain.when(value >= F.lit(float(bound)), label)
    return chain.otherwise(below)


def above(value: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """Label of the highest step exceeded (``>``); steps are ascending."""
    chain = None
    for bound, label in reversed(steps):
        chain = F.when(value > F.lit(float(bound)), label) if chain is None \
            else chain.when(value > F.lit(float(bound)), label)
    return chain.otherwise(otherwise)


def risk_band(score: Column) -> Column:
    return step_up(score, settings.RISK_BANDS, settings.RISK_BANDS[0][1])


def linkage_level(score: Column) -> Column:
    return step_up(score, settings.LINKAGE_LEVELS, "LOW")
