"""Weights and scores as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbline.fixed_values import (
    CRASH_POINTS,
    CRASH_SATURATION,
    EXPOSURE_WEIGHTS,
    HAZARD_POINTS,
    HAZARD_SATURATION,
    MIN_LENGTH_KM,
    RECENCY_HALF_LIFE_MONTHS,
    SCORE_WEIGHTS,
    SECONDS_PER_MONTH,
)


def _by_code(severity: Column, table) -> Column:
    weights, other = table
    (first, weight), *rest = weights.items()
    chain = F.when(severity == first, F.lit(weight))
    for code, weight in rest:
        chain = chain.when(severity == code, F.lit(weight))
    return chain.otherwise(F.lit(other))


def exposure_severity_weight(severity: Column, scale: str = "literal") -> Column:
    return _by_code(severity, EXPOSURE_WEIGHTS[scale])


def score_severity_weight(severity: Column, scale: str = "literal") -> Column:
    return _by_code(severity, SCORE_WEIGHTS[scale])


def age_months(occurred_at: Column, now: Column) -> Column:
    """Age in months of 30 days."""
    micros = F.timestamp_diff("MICROSECOND", occurred_at, now)
    return micros / F.lit(1e6) / F.lit(float(SECONDS_PER_MONTH))


def recency_weight(age: Column) -> Column:
    """1 now, one half after each half-life."""
    return F.exp(F.lit(-math.log(2.0)) * age / F.lit(RECENCY_HALF_LIFE_MONTHS))


def length_km(metres: Column) -> Column:
    """Kilometres with a floor, so that densities stay finite; null gives the floor."""
    return F.greatest(metres / F.lit(1000.0), F.lit(MIN_LENGTH_KM))


def crash_points(weight_per_km: Column) -> Column:
    return (F.lit(1.0) - F.exp(-(weight_per_km / F.lit(CRASH_SATURATION)))) * F.lit(CRASH_POINTS)


def hazard_points(hazards_per_km: Column) -> Column:
    return (F.lit(1.0) - F.exp(-(hazards_per_km / F.lit(HAZARD_SATURATION)))) * F.lit(HAZARD_POINTS)


def risk_score(crash: Column, hazard: Column) -> Column:
    """Whole points, 0 to 100."""
    return F.ceil(F.least(crash + hazard, F.lit(100.0))).cast("int")


def log_score(hits: Column, busiest_tile: Column) -> Column:
    """Hits against the busiest tile on a logarithmic scale, 0 to 100."""
    ratio = F.log10(F.lit(1.0) + hits) / F.log10(F.lit(1.0) + busiest_tile)
    return F.least(F.lit(100.0), F.round(F.lit(100.0) * ratio, 2))


def kilometres(metres: Column) -> Column:
    return F.round(metres / F.lit(1000.0), 3)


def relative_difference(value: Column, base: Column) -> Column:
    return F.abs(value - base) / F.greatest(base, F.lit(1.0))
