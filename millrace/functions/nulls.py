"""Predicates whose result is never NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_safe_not_equal(column: Column, value) -> Column:
    """True for NULL too, unlike ``column != value`` (FLT-02)."""
    return ~column.eqNullSafe(F.lit(value))


def flag_excluded(*conditions: Column) -> Column:
    """Keeps rows for which no condition is TRUE; an UNKNOWN excludes nothing (FLT-03)."""
    flag = F.lit(0)
    for c in conditions:
        flag = F.greatest(flag, F.when(c, 1).otherwise(0))
    return flag == 0


def optional_filter(column: Column, parameter: str | None) -> Column:
    """A comma-separated list of wanted values; an empty string or None doesn't filter (FLT-07)."""
    if not parameter:
        return F.lit(True)
    return F.coalesce(F.array_contains(F.split(F.lit(parameter), ","), column.cast("string")), F.lit(False))
