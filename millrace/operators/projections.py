"""Projections (PRJ) and policies on columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidSpec, UnknownColumn


def with_columns(df: DataFrame, columns: Mapping[str, Column | str]) -> DataFrame:
    """Many columns in one projection: the plan is analysed once, not once a column (PRJ-03).

    Columns given as SQL are sent to the JVM in one call, which for hundreds takes less time than building them.
    """
    if columns and all(isinstance(c, str) for c in columns.values()):
        given = {n: f"{sql} AS `{n}`" for n, sql in columns.items()}
        return df.selectExpr(*(given.pop(c, f"`{c}`") for c in df.columns), *given.values())
    return df.withColumns({n: F.expr(c) if isinstance(c, str) else c for n, c in columns.items()})


def rename(df: DataFrame, mapping: Mapping[str, str], *, keep_others: bool = True) -> DataFrame:
    """Renames by an explicit map only; a name that isn't there raises, nothing is guessed (PRJ-04)."""
    if missing := [c for c in mapping if c not in df.columns]:
        raise UnknownColumn(f"no columns {missing}; there are {df.columns}", missing=missing)
    out = [F.col(f"`{c}`").alias(mapping.get(c, c)) for c in df.columns if keep_others or c in mapping]
    if len({o for o in (mapping.get(c, c) for c in df.columns if keep_others or c in mapping)}) < len(out):
        raise InvalidSpec("two columns would share a name")
    return df.select(*out)


def standardise(df: DataFrame, columns: Mapping[str, Column], keep_raw: tuple[str, ...] = ()) -> DataFrame:
    """One projection of standardised columns, with the raw values of some kept as ``raw_<name>`` (PRJ-01)."""
    return df.select(*(expr.alias(name) for name, expr in columns.items()), *(F.col(c).alias(f"raw_{c}") for c in keep_raw))


def label_nulls(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Fills NULL and empty labels (PRJ-05)."""
    return df.withColumns({c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(v)) for c, v in labels.items()})


def resolve_column(df: DataFrame, name: str) -> str:
    """The column of that name; similar names are never substituted (STR-10)."""
    if name not in df.columns:
        raise UnknownColumn(f"no column {name}; there are {df.columns}")
    return name


def positional_similarity(a: Column, b: Column) -> Column:
    """Share of positions with equal characters, of the longer text's; for reports on near misses, not for substitution (STR-10)."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x) / F.greatest(F.length(a), F.length(b), F.lit(1))


def apply_policies(df: DataFrame, tags: Mapping[str, str], masks: Mapping[str, Column], row_filter: Column | None = None) -> DataFrame:
    """Column masks by tag and a row filter (FLT-08).  ``tags``: column -> tag; ``masks``: tag -> masked value."""
    if unknown := {t for t in tags.values() if t not in masks}:
        raise InvalidSpec(f"no mask for tags {sorted(unknown)}")
    if missing := [c for c in tags if c not in df.columns]:
        raise UnknownColumn(f"no columns {missing}")
    df = df if row_filter is None else df.where(F.coalesce(row_filter, F.lit(False)))
    return df.select(*(masks[tags[c]].cast(df.schema[c].dataType).alias(c) if c in tags else F.col(c) for c in df.columns))
