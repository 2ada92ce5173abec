"""Parsers that give NULL instead of failing, canonical keys, and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_timestamp(column: Column) -> Column:
    """ISO 8601 with offset, ``yyyy-MM-dd HH:mm:ss``, ``MM/dd/yyyy HH:mm`` or 13-digit epoch milliseconds; else NULL (STR-01)."""
    text = F.trim(column)
    formats = ("yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm")
    millis = F.when(text.rlike("^[0-9]{13}$"), F.timestamp_millis(text.try_cast("bigint")))
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats), millis)


def parse_amount(column: Column, kind: str = "decimal(18,2)") -> Column:
    """Strips currency signs, thousands commas and blanks, then casts; NULL if that fails (STR-02)."""
    return F.regexp_replace(column, r"[$,\s]", "").try_cast(kind)


def map_vocabulary(column: Column, synonyms: dict[str, str]) -> Column:
    """Trimmed lower-case text with synonyms replaced (STR-03)."""
    text = F.lower(F.trim(column))
    out = text
    for given, meant in synonyms.items():
        out = F.when(text == given, F.lit(meant)).otherwise(out)
    return out


def row_hash(*columns: str | Column) -> Column:
    """SHA-256 of the tracked columns, NULLs marked, so that (NULL, 'a') and ('a', NULL) differ (STR-04)."""
    marked = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("<NULL>")) for c in columns]
    return F.sha2(F.concat_ws("||", *marked), 256)


def surrogate_key(*columns: str) -> Column:
    return F.xxhash64(*columns)


def would_round(column: Column, narrow: str = "decimal(12,2)", wide: str = "decimal(38,10)") -> Column:
    """True where a cast to ``narrow`` loses digits silently (STR-05)."""
    return column.try_cast(narrow) != column.try_cast(wide)


def normalize_customer_id(column: Column) -> Column:
    """``C`` and five digits from any spelling with one to five digits; else NULL (STR-06)."""
    bare = F.regexp_replace(F.upper(F.trim(column)), "[^A-Z0-9]", "")
    digits = F.regexp_extract(bare, "^C?([0-9]{1,5})$", 1)
    return F.when(digits != "", F.concat(F.lit("C"), F.lpad(digits, 5, "0")))


def canonical_uuid(column: Column) -> Column:
    """8-4-4-4-12 lower-case hex from any spelling with 32 hex digits; else NULL (STR-07)."""
    bare = F.regexp_replace(F.lower(column), "[^0-9a-f]", "")
    return F.when(F.length(bare) == 32, F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def parse_failed(raw: Column, parsed: Column) -> Column:
    """Present before parsing, NULL after (STR-08)."""
    return raw.isNotNull() & parsed.isNull()


def region_from_sku(sku: Column) -> Column:
    """The region that ends a SKU name such as ``PREMIUM_JOBS_US_EAST``; NULL without one (STR-09)."""
    found = F.regexp_extract(F.upper(sku), r"_((?:US|EU|AP|SA|CA)_[A-Z0-9_]+)$", 1)
    return F.nullif(found, F.lit(""))


def query_fingerprint(text: Column) -> Column:
    """Hash of a query's shape: literals, case and spacing don't count (AGG-17/18)."""
    shape = F.regexp_replace(F.lower(text), "'[^']*'", "?")
    shape = F.regexp_replace(shape, r"\b[0-9]+(\.[0-9]+)?\b", "?")
    return F.sha2(F.trim(F.regexp_replace(shape, r"\s+", " ")), 256)


def slug(column: Column) -> Column:
    """Anchor of a heading: lower case, punctuation dropped, blanks to hyphens (DOC-01)."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(column)), r"[^a-z0-9_ \-]", ""), " ", "-")
