"""Physical plans as text, and what to read out of them (PLN)."""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NondeterministicPlan

STRATEGIES = ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct")


def executed_plan(df: DataFrame) -> str:
    """The physical plan; after an action, the one that adaptive execution settled on (PLN-01)."""
    return df._jdf.queryExecution().executedPlan().toString()


def optimized_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _current(plan: str) -> str:
    """The final plan's part of an adaptive plan's text."""
    return plan.split("+- == Initial Plan ==")[0]


def exchange_count(df: DataFrame) -> int:
    """Shuffles of a plan, without broadcasts and without reuses (PLN-02)."""
    return len(re.findall(r"(?<![A-Za-z])Exchange (?:hashpartitioning|SinglePartition|rangepartitioning|RoundRobinPartitioning)", _current(executed_plan(df))))


def join_strategies(df: DataFrame) -> list[str]:
    """The joins of a plan, from its top (PLN-05)."""
    return re.findall("|".join(STRATEGIES), _current(executed_plan(df)))


def pruning(df: DataFrame) -> dict[str, list[str]]:
    """What reached the scans: PartitionFilters, PushedFilters, ReadSchema (PLN-08)."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {k: re.findall(rf"{k}: (\[.*?\]|struct<.*?>)(?=,|$|\n)", plan) for k in ("PartitionFilters", "PushedFilters", "ReadSchema")}


def require_deterministic(df: DataFrame) -> None:
    """Raises if a plan takes an arbitrary row: first, last or any_value over groups, as ``dropDuplicates`` does (PLN-06, SRT-04)."""
    if found := re.findall(r"\b(first|last|any_value)\(", optimized_plan(df)):
        raise NondeterministicPlan(f"the plan has {sorted(set(found))}; rank by a total order instead")


@contextmanager
def conf(spark: SparkSession, **settings):
    """Settings for a while; names have ``__`` for dots (PLN-03)."""
    keys = {k.replace("__", "."): str(v) for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield spark
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ansi_off(spark: SparkSession):
    """Casts give NULL instead of failing, as before ANSI mode; for contrast (PLN-10)."""
    return conf(spark, spark__sql__ansi__enabled="false")


def partition_sizes(df: DataFrame) -> list[int]:
    """Rows of each task's partition, largest first (PLN-04)."""
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).collect()]


def timed(action: Callable[[], object], repeat: int = 1) -> float:
    """The best of several runs, in seconds (PLN-07)."""
    best = math.inf
    for _ in range(repeat):
        t = time.perf_counter()
        action()
        best = min(best, time.perf_counter() - t)
    return best


def run_noop(df: DataFrame) -> None:
    """Runs a whole plan and keeps nothing (SNK-10)."""
    df.write.format("noop").mode("overwrite").save()


def collision_probability(keys: int, bits: int = 64) -> float:
    """The chance that any two of so many hashed keys are equal (PLN-11)."""
    return -math.expm1(-keys * (keys - 1) / 2 / 2**bits)
