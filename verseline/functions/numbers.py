"""Number and flag cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(value: Column, default: Column) -> Column:
    """value as a double, or the default where it is no finite number."""
    number = F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(bad, default).otherwise(number)


def observed_confidence(value: Column, default: Column) -> Column:
    """Confidence of an observation: above 1 and up to 100 it is a percentage; then clamped to 0 to 1."""
    number = finite(value, default)
    number = F.when((number > 1) & (number <= 100), number / 100).otherwise(number)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), number))


def recognised_confidence(value: Column) -> Column:
    """Confidence of a recognised box: 0 where it is no finite number, not clamped."""
    return finite(value, F.lit(0.0))


def clean(value: Column) -> Column:
    """Rounded to 6 places; tiny values are 0, null stays."""
    return F.when(F.abs(value) < 0.0000005, 0.0).otherwise(F.round(value, 6))


def flags(value: Column) -> Column:
    """A flag list without repeats, in order; null is empty."""
    return F.array_distinct(F.coalesce(value, F.array().cast("array<string>")))


def with_flag(value: Column, flag: str, when: Column) -> Column:
    return F.when(when & ~F.array_contains(value, flag), F.array_append(value, flag)).otherwise(value)
