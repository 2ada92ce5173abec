"""Incremental loads: file ledgers, watermark columns, touched partitions, backfills."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..table import VersionedTable


def new_files(table: VersionedTable, files: Sequence[str], name_column: str = "_source_file_name") -> list[str]:
    """Files whose names the table's ledger column lacks, and its state, which has the files without rows (SNK-02).

    Only matching names come to the driver.
    """
    names = [os.path.basename(f) for f in files]
    known = {r[0] for r in table.read().where(F.col(name_column).isin(*names)).select(name_column).distinct().collect()} if names else set()
    known |= set(table.state().get("rowless", []))
    return [f for f, n in zip(files, names, strict=True) if n not in known]


def ingest_files(table: VersionedTable, files: Sequence[str], read: Callable[[SparkSession, list[str]], DataFrame]) -> list[str]:
    """Appends the files not loaded before, also those without rows; returns their names, and commits nothing if there are none."""
    fresh = new_files(table, files)
    names = [os.path.basename(f) for f in fresh]
    if fresh:
        table.append(read(table.spark, fresh), sources=("_source_file_name", names), operation="INGEST")
    return names


def since_watermark(source: DataFrame, column: str, watermark, lookback_seconds: int = 0) -> DataFrame:
    """Rows at or after the watermark less a lookback (INC-03).

    A strict comparison without lookback misses ties and late commits; what overlaps is read again
    and must meet an idempotent merge.
    """
    if watermark is None:
        return source
    return source.where(F.col(column) >= F.lit(watermark).cast("timestamp") - F.make_dt_interval(secs=F.lit(lookback_seconds)))


def run_incremental(source: DataFrame, target: VersionedTable, state: VersionedTable, name: str, keys: Sequence[str], column: str, lookback_seconds: int) -> int:
    """One incremental run: read from the stored watermark, merge, then store the largest value that was read (INC-03, INC-04).

    The watermark is stored after the merge; if a run dies between both, the next reads the same
    rows again and the sequenced merge changes nothing.  Returns the number of rows read.
    """
    found = state.read().where(F.col("name") == name).agg(F.max("watermark")).first()[0]
    batch = since_watermark(source, column, found, lookback_seconds)
    seen = batch.agg(F.count(F.lit(1)).alias("n"), F.max(column).alias("top")).first()
    if seen["n"]:
        target.upsert_sequenced(batch, keys, column)
        state.upsert_sequenced(state.spark.createDataFrame([(name, seen["top"])], state.schema()), ["name"], "watermark")
    return seen["n"]


def recompute_touched(facts: DataFrame, fresh: DataFrame, target: VersionedTable, partition: str, aggregate: Callable[[DataFrame], DataFrame]) -> list:
    """Recomputes the partitions that new rows fall into, and replaces only these (SNK-07).

    Distinct partition values come to the driver, as many as the batch touches.
    """
    values = [r[0] for r in fresh.select(partition).distinct().collect()]
    if not values:
        return []
    text = ", ".join(f"'{v}'" for v in sorted(map(str, values)))
    target.replace_where(aggregate(facts.where(F.col(partition).isin(*values))), f"cast({partition} as string) IN ({text})")
    return sorted(map(str, values))


def backfill(table: VersionedTable, df: DataFrame, name: str) -> bool:
    """Appends once in the life of a table (INC-15); False if that was done before."""
    return table.append(df, txn=(f"backfill-{name}", 0), operation="BACKFILL") is not None
