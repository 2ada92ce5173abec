"""Plan inspection, scoped settings, declarative specifications."""

from .inspect import (
    ansi_off, collision_probability, conf, executed_plan, exchange_count, join_strategies, optimized_plan, partition_sizes, pruning, require_deterministic, timed,
)

__all__ = [n for n in dir() if not n.startswith("_") and n not in ("inspect", "metrics", "spec")]
