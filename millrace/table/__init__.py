"""A versioned table over Parquet files."""

from .versioned import VersionedTable

__all__ = ["VersionedTable"]
