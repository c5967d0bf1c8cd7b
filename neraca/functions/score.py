"""Date and amount scores of the matching rules, and their confidence bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_gap(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def linear_date_score(gap: Column, days: int = 7) -> Column:
    """1 at no gap, falling to 0 at ``days``; 0 beyond."""
    return F.when(gap <= days, F.lit(1.0) - gap / F.lit(float(days))).otherwise(0.0)


def percent_of_base(base: Column, other: Column) -> Column:
    """Distance of ``other`` in percent of ``|base|``."""
    b, o = base.cast("double"), other.cast("double")
    return F.abs(b - o) / F.abs(b) * 100


def linear_amount_score(percent: Column, limit: float = 5.0) -> Column:
    return F.when(percent <= limit, F.lit(1.0) - percent / F.lit(limit)).otherwise(0.0)


def weighted_confidence(date_score: Column, amount_score: Column) -> Column:
    """60 % date, 40 % amount."""
    return date_score * 0.6 + amount_score * 0.4


def match_band(confidence: Column) -> Column:
    """``auto`` from 0.70, ``suggested`` from 0.50, else null."""
    return F.when(confidence >= 0.70, "auto").when(confidence >= 0.50, "suggested")


def gated_date_score(gap: Column, days: int = 7) -> Column:
    """1 at no gap, falling to 0.7 at ``days``; null (no match) beyond."""
    return F.when(gap <= days, F.lit(1.0) - gap / F.lit(float(days)) * 0.3)


def gated_amount_score(a: Column, b: Column, limit: float = 2.0) -> Column:
    """Same curve over the distance in percent of the larger amount; null when gated out."""
    x, y = a.cast("double"), b.cast("double")
    percent = F.abs(F.try_divide(x - y, F.greatest(x, y))) * 100
    usable = (x != 0) & (y != 0) & (percent <= limit)
    return F.when(usable, F.lit(1.0) - percent / F.lit(limit) * 0.3)


def pair_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.95, "exact").otherwise("fuzzy")


def engine_date_score(gap: Column, days: int = 3) -> Column:
    """1 at no gap, falling to 0.5 at ``days``; null beyond."""
    return F.when(gap <= days, F.greatest(F.lit(1.0) - gap / F.lit(float(days * 2)), F.lit(0.5)))


def engine_amount_score(a: Column, b: Column, limit: float = 0.01) -> Column:
    """1 when equal, falling to 0.7 at ``limit`` of the mean; null beyond."""
    x, y = a.cast("double"), b.cast("double")
    mean = (x + y) / 2
    share = F.when(mean > 0, F.abs(x - y) / F.nullif(mean, F.lit(0.0))).otherwise(1.0)
    return F.when((x == 0) | (y == 0), F.lit(None).cast("double")).when(x == y, 1.0).when(
        share <= limit, F.greatest(F.lit(1.0) - share / F.lit(limit) * 0.3, F.lit(0.7))
    )


def engine_confidence(date_score: Column, amount_score: Column, vendor: Column) -> Column:
    """30 % date, 50 % amount, 20 % name; null when date or amount is gated out."""
    return date_score * 0.30 + amount_score * 0.50 + vendor * 0.20


def engine_band(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.95, "exact")
        .when(confidence >= 0.85, "high")
        .when(confidence >= 0.70, "partial")
        .otherwise("low")
    )
