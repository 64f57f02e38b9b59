"""Small numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide_or_zero(numerator: Column, denominator: Column) -> Column:
    """Zero where the denominator is not positive."""
    return F.when(denominator > 0, numerator / F.nullif(denominator, F.lit(0.0))).otherwise(0.0)


def is_finite(value: Column) -> Column:
    """Neither NULL, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def coerce_number(value: Column) -> Column:
    """A4: numeric text as a double; anything else (also true/false) becomes 0."""
    text = value.cast("string")
    plain = text.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$")
    number = F.when(plain, text.try_cast("double"))
    return F.when(is_finite(number), number).otherwise(0.0)


def finite_or_zero(value: Column) -> Column:
    """NULL, NaN and infinities become 0."""
    return F.when(is_finite(value), value).otherwise(0.0)


def finite_or_null(value: Column) -> Column:
    """NaN becomes NULL (missing is always NULL inside the engine)."""
    return F.when(~F.isnan(value), value)
