"""Window operators (WIN) and measures over time.

Every order is total: ties are broken by given columns, so that results don't depend on how rows
are dealt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidSpec


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order (WIN-01); plans as WindowGroupLimit below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], into: str = "rank") -> DataFrame:
    if not keys:
        raise InvalidSpec("a rank without partition keys sorts all rows in one task (WIN-11)")
    return df.withColumn(into, F.rank().over(Window.partitionBy(*keys).orderBy(*order)))


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, ties: bool = False) -> DataFrame:
    """Exactly n rows of each key, or with ``ties`` all rows of its n best values (WIN-03, WIN-04)."""
    number = (F.dense_rank() if ties else F.row_number()).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", number).where(F.col("rank") <= n)


def filter_after_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], condition: Column) -> DataFrame:
    """The latest version of each key if it meets the condition.

    Filtering first would bring back an older version of a key whose latest version fails (FLT-06).
    """
    return latest_per_key(df, keys, order).where(condition)


def intervals(df: DataFrame, keys: Sequence[str], start: str, end: str = "effective_to") -> DataFrame:
    """Contiguous half-open intervals: each ends where the next of its key begins (WIN-05)."""
    return df.withColumn(end, F.lead(start).over(Window.partitionBy(*keys).orderBy(start)))


def collapse_unchanged(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, current: str | None = None) -> DataFrame:
    """Drops rows whose value equals the row before, or for a key's first row the ``current`` column (WIN-06)."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    before = F.coalesce(before, F.col(current)) if current else before
    return df.withColumn("__before", before).where(~F.col(value).eqNullSafe(F.col("__before"))).drop("__before")


def sessionize(df: DataFrame, keys: Sequence[str], at: str, gap_seconds: int, tie_break: Sequence[str] = ()) -> DataFrame:
    """``session``: 1, 2, ... within each key; a pause longer than the gap begins a new one (WIN-07)."""
    w = Window.partitionBy(*keys).orderBy(at, *tie_break)
    pause = F.unix_micros(F.col(at).cast("timestamp")) - F.lag(F.unix_micros(F.col(at).cast("timestamp"))).over(w)
    starts = F.when(pause.isNull() | (pause > gap_seconds * 1_000_000), 1).otherwise(0)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__starts", starts).withColumn("session", F.sum("__starts").over(running)).drop("__starts")


def streaks(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Runs of consecutive days of each key (WIN-08): the day less its rank is constant within a run."""
    days = df.select(*keys, F.col(day).alias("__day")).distinct()
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("__day"))
    return (days.withColumn("__island", F.date_sub("__day", number)).groupBy(*keys, "__island")
            .agg(F.min("__day").alias("first_day"), F.max("__day").alias("last_day"), F.count(F.lit(1)).alias("days")).drop("__island"))


def semi_additive(df: DataFrame, entity: Sequence[str], period: Column, day: str, value: str, into: str = "value") -> DataFrame:
    """A balance by period: each entity's value on its last day of the period, then the sum (AGG-15).

    ``max_by`` keeps one value for each entity and period while it aggregates; nothing is sorted.
    """
    closing = df.groupBy(*entity, period.alias("period")).agg(F.max_by(value, day).alias("__closing"))
    return closing.groupBy("period").agg(F.sum("__closing").alias(into))


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, into: str = "running") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(into, F.sum(value).over(w))


def trailing_days(df: DataFrame, keys: Sequence[str], day: str, value: str, days: int, into: str) -> DataFrame:
    """The sum over the row's day and the ``days - 1`` before, by calendar, not by rows (WIN-16)."""
    number = F.datediff(F.col(day), F.lit("1970-01-01"))
    w = Window.partitionBy(*keys).orderBy("__number").rangeBetween(-(days - 1), 0)
    return df.withColumn("__number", number).withColumn(into, F.sum(value).over(w)).drop("__number")


def year_to_date(df: DataFrame, keys: Sequence[str], day: str, value: str, into: str = "ytd") -> DataFrame:
    w = Window.partitionBy(*keys, F.year(day)).orderBy(day).rangeBetween(Window.unboundedPreceding, 0)
    return df.withColumn(into, F.sum(value).over(w))


def previous_period(df: DataFrame, keys: Sequence[str], period: str, value: str, into: str = "previous") -> DataFrame:
    return df.withColumn(into, F.lag(value).over(Window.partitionBy(*keys).orderBy(period)))


def top_with_population(df: DataFrame, order: Sequence[Column], n: int, into: str = "population") -> DataFrame:
    """The n first rows with the number of all rows (WIN-12).

    Two aggregations in place of a window over all rows, which would gather them in one task.
    """
    return df.orderBy(*order).limit(n).crossJoin(df.agg(F.count(F.lit(1)).alias(into)))


def uptime(events: DataFrame, keys: Sequence[str], at: str, state: str, since: str, until: str, up: str) -> DataFrame:
    """Seconds in state ``up`` within [since, until) (WIN-13).

    The state at the beginning is carried in from each key's last event before it.
    """
    since_, until_ = F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")
    when = F.col(at).cast("timestamp")
    carried = events.where(when <= since_).groupBy(*keys).agg(F.max_by(state, at).alias("state")).select(*keys, since_.alias("at"), "state")
    inside = events.where((when > since_) & (when < until_)).select(*keys, when.alias("at"), F.col(state).alias("state"))
    follow = F.coalesce(F.lead("at").over(Window.partitionBy(*keys).orderBy("at")), until_)
    spans = carried.unionByName(inside).withColumn("__next", follow)
    seconds = F.when(F.col("state") == up, F.unix_timestamp("__next") - F.unix_timestamp("at")).otherwise(0)
    return spans.groupBy(*keys).agg(F.sum(seconds).alias("up_seconds"))


def broken_intervals(history: DataFrame, keys: Sequence[str], start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Rows whose end isn't the next row's beginning: gaps, overlaps, closed last rows (WIN-15)."""
    follow = F.lead(start).over(Window.partitionBy(*keys).orderBy(start))
    return history.withColumn("__next", follow).where(~F.col(end).eqNullSafe(F.col("__next"))).drop("__next")
