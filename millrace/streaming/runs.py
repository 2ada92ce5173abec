"""Streams (STM).  Stateful operators demand a watermark, so that state has a bound."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import MissingWatermark, UnsupportedOutputMode
from ..table import VersionedTable


@dataclass(frozen=True)
class Progress:
    batches: int
    input_rows: int
    state_rows: int
    dropped_late: list[int]


def progress(query: StreamingQuery) -> Progress:
    """Figures of a query's micro-batches (STM-14)."""
    seen = [p for p in query.recentProgress]
    states = [s for p in seen for s in p["stateOperators"]]
    return Progress(len(seen), sum(p["numInputRows"] for p in seen), states[-1]["numRowsTotal"] if states else 0, [sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"]) for p in seen])


def checkpoint_for(root: str, flow: str) -> str:
    """A flow's checkpoint by its name: renaming the flow starts it anew (STM-13)."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", flow):
        raise ValueError(f"flow name {flow!r}")
    return f"{root.rstrip('/')}/_checkpoints/{flow}"


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Event time as an instant; watermarks don't take times without a zone."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def run_available_now(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> Progress:
    """Processes what is there into Parquet files and stops (STM-01, STM-02).  The file sink takes append mode only (STM-10)."""
    if mode != "append":
        raise UnsupportedOutputMode(f"a file sink takes append, not {mode}; use sink_table with keys")
    query = df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return progress(query)


def run_batches(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> Progress:
    query = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return progress(query)


def sink_table(df: DataFrame, table: VersionedTable, checkpoint: str, flow: str, keys: Sequence[str] = (), mode: str | None = None) -> Progress:
    """Writes a stream to a versioned table exactly once (SNK-08, SNK-09, TBL-11).

    Without keys batches are appended, and the mode must be append (TBL-10); with keys each batch
    is merged.  The batch number is the write token, so that a batch that runs again is skipped.
    """
    mode = mode or ("update" if keys else "append")
    if mode != "append" and not keys:
        raise UnsupportedOutputMode(f"appending {mode} rows would repeat them; give the keys to merge on")

    def each(batch: DataFrame, number: int) -> None:
        if keys:
            table.merge(batch, keys, update="*", insert="*", txn=(flow, number), operation="STREAM MERGE")
        else:
            table.append(batch, txn=(flow, number), operation="STREAM APPEND")

    return run_batches(df, each, checkpoint, mode)


def windowed_sum(events: DataFrame, at: str, value: str, width: str = "10 minutes", watermark: str = "10 minutes", keys: Sequence[str] = ()) -> DataFrame:
    """Tumbling windows; in append mode a window comes out once the watermark has passed its end (STM-03, STM-05)."""
    w = event_time(events, at).withWatermark(at, watermark)
    return w.groupBy(F.window(at, width), *keys).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("events")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "total", "events")


def session_windows(events: DataFrame, at: str, keys: Sequence[str], gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    w = event_time(events, at).withWatermark(at, watermark)
    return w.groupBy(F.session_window(at, gap), *keys).agg(F.count(F.lit(1)).alias("events")).select(*keys, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events")


def latest_per_key_constant_watermark(events: DataFrame, key: str, at: str) -> DataFrame:
    """A watermark on a constant never moves, so that append mode emits nothing (STM-04).  For contrast."""
    fixed = events.withColumn("__fixed", F.lit("2000-01-01 00:00:00").cast("timestamp")).withWatermark("__fixed", "1 minute")
    return fixed.groupBy(key, "__fixed").agg(F.max_by(F.struct(*events.columns), at).alias("r")).select("r.*")


def dedupe_within_watermark(events: DataFrame, keys: Sequence[str], at: str, delay: str) -> DataFrame:
    """The first of equal keys within the delay (STM-09)."""
    return event_time(events, at).withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, watermark: str | None, how: str = "inner") -> DataFrame:
    """Stream-stream join of events at most ``within`` apart (STM-11).

    Without a watermark an outer join can't be emitted (STM-07) and an inner one keeps all rows for
    ever (STM-08); both raise.
    """
    if not watermark:
        raise MissingWatermark("a join of two streams needs watermarks to bound its state")
    a = event_time(left, left_time).withWatermark(left_time, watermark).alias("a")
    b = event_time(right, right_time).withWatermark(right_time, watermark).alias("b")
    gap = F.expr(f"INTERVAL {within}")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"b.{right_time}") >= F.col(f"a.{left_time}")) & (F.col(f"b.{right_time}") <= F.col(f"a.{left_time}") + gap), how)


def enrich_per_batch(stream: DataFrame, dimension: Callable[[], DataFrame], keys: Sequence[str], sink: VersionedTable, checkpoint: str, flow: str) -> Progress:
    """Joins each micro-batch with the dimension as it is then; rows written earlier aren't corrected (STM-06)."""

    def each(batch: DataFrame, number: int) -> None:
        sink.append(batch.join(dimension(), list(keys), "left"), txn=(flow, number))

    return run_batches(stream, each, checkpoint, "append")


def fan_in(streams: Mapping[str, DataFrame], table: VersionedTable, root: str) -> dict[str, Progress]:
    """Several sources to one table, each flow with a checkpoint of its own (STM-12)."""
    return {name: sink_table(df, table, checkpoint_for(root, name), name) for name, df in streams.items()}
