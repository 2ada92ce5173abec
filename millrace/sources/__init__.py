"""Readers with declared schemas, incremental discovery, and generated tables."""

from .files import discover, read_batch, read_csv, read_inferred, read_json_lines, reconcile_rescued
from .generate import generate

__all__ = ["discover", "generate", "read_batch", "read_csv", "read_inferred", "read_json_lines", "reconcile_rescued"]
