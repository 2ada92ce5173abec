"""Structured Streaming with bounded state and explicit output modes."""

from .runs import (
    checkpoint_for, dedupe_within_watermark, enrich_per_batch, event_time, fan_in, latest_per_key_constant_watermark, progress, run_available_now,
    session_windows, sink_table, stream_join, windowed_sum,
)

__all__ = [n for n in dir() if not n.startswith("_") and n != "runs"]
