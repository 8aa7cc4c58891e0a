"""Scalar factors of scoring as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factors by route of a match and by kind of evidence, bands, weights of the ten dimensions.
MATCH = {"exact": 1.0, "alias": 1.0, "child": 0.90, "fuzzy": 0.85, "parent": 0.70, "transferable": 0.50}
PROFICIENCY = {"applied_long": 1.00, "applied_short": 0.85, "narrated": 0.80, "listed": 0.55, "mentioned": 0.40}
BANDS = (("exceptional", 85.0), ("strong", 70.0), ("moderate", 55.0), ("weak", 40.0))
WEIGHTS = {"S1": 30.0, "S2": 8.0, "S3": 18.0, "S4": 15.0, "S5": 8.0, "S6": 5.0, "S7": 7.0, "S8": 5.0, "S9": 2.0, "S10": 2.0}
HALF_LIFE, HALF_LIFE_TIMELESS, RECENCY_FLOOR = 4.0, 12.0, 0.50


def months_of(date: Column) -> Column:
    """Months since year 0 of a date."""
    return F.year(date) * 12 + F.month(date) - 1


def years_since(last: Column, now: Column) -> Column:
    """Years in whole months, 0 in the future; a missing date counts as now."""
    return F.coalesce(F.greatest(months_of(now) - months_of(last), F.lit(0)) / 12.0, F.lit(0.0))


def years_by_days(last: Column, now: Column) -> Column:
    return F.datediff(now, last) / 365.2425


def recency(years: Column, half_life: float | Column, floor: float) -> Column:
    """2^(-years / half-life) between floor and 1; 1 without a positive half-life."""
    half = F.lit(half_life) if not isinstance(half_life, Column) else half_life
    decay = F.exp(years * F.lit(-math.log(2)) / half)
    return F.when(half <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(floor), F.least(F.lit(1.0), decay)))


def lookup(column: Column, table: dict[str, float], default: float = 0.0) -> Column:
    out = F.lit(default)
    for k, v in reversed(table.items()):
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def embedding_match(cosine: Column) -> Column:
    """Factor of a match by vectors: 0.60 at a cosine of 0.82, rising to 0.85."""
    return F.when(cosine >= 0.82, F.least(F.lit(0.85), F.lit(0.60) + F.lit(0.75) * (cosine - F.lit(0.82)))).otherwise(F.lit(0.0))


def band(score: Column) -> Column:
    out = F.lit("not_a_match")
    for name, least in reversed(BANDS):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out


def years_score(n: Column, least: Column, target: Column, cap: float = 0.0, per_year: float = 0.0) -> Column:
    """Piecewise score of relevant years against a minimum and a target; 70 without a minimum. A cap above 0 takes
    ``per_year`` points a year above the target off, ``cap`` at most."""
    b = F.when(target == 0, least).otherwise(target)
    half = least * 0.5
    beyond = F.lit(100.0) if not cap else F.greatest(F.lit(0.0), F.lit(100.0) - F.least(F.lit(cap), F.lit(per_year) * (n - b)))
    return (
        F.when(least == 0, F.lit(70.0))
        .when(n < half, F.lit(40.0) * (n / half))
        .when(n < least, F.lit(40.0) + F.lit(30.0) * (n - half) / half)
        .when(n <= b, F.when(b == least, F.lit(100.0)).otherwise(F.lit(70.0) + F.lit(30.0) * (n - least) / (b - least)))
        .otherwise(beyond)
    )


def seniority_factor(gap: Column) -> Column:
    return F.when(gap <= -3, 0.45).when(gap == -2, 0.70).when(gap.isin(-1, 0), 1.0).when(gap == 1, 0.95).otherwise(0.85)


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
