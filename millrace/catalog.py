"""All queries of the core library by name, with their SQL where SQL can express them."""

from __future__ import annotations

from .queries import changes, expressions, ingest, joins, outcomes, quality, relational, streams, windows  # noqa: F401  registering
from .queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
