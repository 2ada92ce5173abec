"""Aggregations (AGG) beyond plain groupBy.  All are partial before the one shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, and what is beyond one row for each (AGG-11)."""
    key = F.struct(*(F.col(k) for k in keys))
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.countDistinct(key).alias("distinct_keys"), (F.count(F.lit(1)) - F.countDistinct(key)).alias("duplicates"))


def share(condition: Column, among: Column | None = None) -> Column:
    """Rows that meet a condition per row, or per row that meets ``among``; NULL if there are none (AGG-09)."""
    whole = F.count(F.lit(1)) if among is None else F.count_if(among)
    return F.try_divide(F.count_if(condition if among is None else condition & among), whole)


def null_rates(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of NULLs in each column, in one pass (AGG-13)."""
    rates = [F.avg(F.col(c).isNull().cast("int")).alias(f"{c}_null_rate") for c in columns]
    return df.groupBy(*by).agg(*rates) if by else df.agg(*rates)


def durations(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Seconds from the first start to the last end of each key (AGG-16)."""
    seconds = F.unix_timestamp(F.max(F.col(end).cast("timestamp"))) - F.unix_timestamp(F.min(F.col(start).cast("timestamp")))
    return df.groupBy(*keys).agg(seconds.alias("seconds"))


def percent_of_total(df: DataFrame, keys: Sequence[str], value: str, digits: int = 6) -> DataFrame:
    """Each key's share of the total of all keys (AGG-17); the window runs over groups, not rows."""
    groups = df.groupBy(*keys).agg(F.sum(value).alias("value"))
    total = groups.agg(F.sum("value").alias("__total"))
    return groups.crossJoin(F.broadcast(total)).select(*keys, "value", F.round(F.try_divide(F.col("value").cast("double"), F.col("__total").cast("double")), digits).alias("share"))


def gaps(df: DataFrame, missing: str, keys: Sequence[str], value: str) -> DataFrame:
    """What isn't attributed, largest first (AGG-14)."""
    return df.where(F.col(missing).isNull()).groupBy(*keys).agg(F.sum(value).alias("value"), F.count(F.lit(1)).alias("records")).orderBy(F.desc("value"), *keys)


def ranked_groups(df: DataFrame, keys: Sequence[str], within: Sequence[str], value: Column, into: str = "value") -> DataFrame:
    """Aggregates, then ranks the groups within ``within`` (WIN-14)."""
    groups = df.groupBy(*keys).agg(value.alias(into))
    w = Window.partitionBy(*within).orderBy(F.desc(into), *(k for k in keys if k not in within))
    return groups.withColumn("rank", F.row_number().over(w))
