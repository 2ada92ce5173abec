"""Column functions: parsing, keys and hashes, NULL-safe predicates, time zones."""

from .nulls import flag_excluded, null_safe_not_equal, optional_filter
from .strings import (
    canonical_uuid, map_vocabulary, normalize_customer_id, parse_amount, parse_failed, parse_timestamp, query_fingerprint,
    region_from_sku, row_hash, slug, surrogate_key, would_round,
)
from .timezones import day_hours, fixed_offset_time, local_date, local_time, to_utc

__all__ = [n for n in dir() if not n.startswith("_") and n not in ("nulls", "strings", "timezones")]
