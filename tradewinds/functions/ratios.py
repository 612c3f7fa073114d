"""Flags and exact decimal ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COUNT_TYPE = "decimal(20,0)"
RATE_TYPE = "decimal(18,6)"
MONEY_TYPE = "decimal(18,2)"
PERCENT_TYPE = "decimal(6,2)"


def to_flag(condition: Column) -> Column:
    """1 when the condition is TRUE, otherwise 0 (also for an unknown condition)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def safe_ratio(
    numerator: Column,
    denominator: Column,
    result_type: str = RATE_TYPE,
    numerator_type: str = COUNT_TYPE,
) -> Column:
    """numerator / denominator in decimal arithmetic, rounded half up; NULL for a 0 or NULL denominator."""
    den = F.nullif(denominator.cast(COUNT_TYPE), F.lit(0).cast(COUNT_TYPE))
    return (numerator.cast(numerator_type) / den).cast(result_type)


def percent(part: Column, whole: Column, result_type: str = PERCENT_TYPE) -> Column:
    """100 * part / whole with the digits of ``result_type``."""
    return safe_ratio(part.cast(COUNT_TYPE) * F.lit(100), whole, result_type, numerator_type="decimal(23,0)")
