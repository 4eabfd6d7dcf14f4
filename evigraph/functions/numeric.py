"""Small arithmetic shared by scores and measurements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def half_up(value: Column, digits: int = 0) -> Column:
    return F.round(value, digits)


def half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def posterior(positive: Column, negative: Column) -> Column:
    """Mean of a Beta(2, 2) prior after weighted outcomes."""
    return (positive + F.lit(2)) / (positive + negative + F.lit(4))


def group_adjustment(positive: Column, negative: Column, baseline: Column) -> Column:
    """Shrunken, bounded push of a group away from the baseline; groups below weight 4 say nothing."""
    weight = positive + negative
    raw = (posterior(positive, negative) - baseline) * 16 * weight / (weight + 8)
    return F.when(weight.isNull() | (weight < 4), F.lit(0.0)).otherwise(clamp(raw, -4.0, 4.0))


def laplace_rate(safe: Column, samples: Column) -> Column:
    return (safe + 1) / (samples + 2)


def decade_width(year: Column) -> Column:
    return F.when(year < 1900, 140).when(year < 1920, 260).when(year < 1950, 500).otherwise(640)


def layout_priority(node_type: Column, starter: Column, degree: Column) -> Column:
    base = F.when(node_type == "genre", F.lit(1.0)).when(starter, F.lit(0.92)).otherwise(F.lit(0.42))
    return half_up(F.least(F.lit(1.0), base + F.least(F.lit(0.45), degree * 0.045)), 3)


def node_radius(node_type: Column) -> Column:
    return F.when(node_type == "genre", 104).when(node_type.isin("band", "guitar", "guitar_brand"), 82).otherwise(68)


def label_width(label: Column) -> Column:
    return clamp(F.length(label) * 16 + 32, 120, 540)
