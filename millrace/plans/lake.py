"""Layered tables fed by files, described as data (INC-01, INC-02).

A ``Feed`` says how raw lines look, which SQL makes typed columns of them, which rules a row must meet,
and by which key and sequence rows follow each other.  A ``Lake`` keeps three tables for it:

* ``landed``: every line of every file once, as text, with its file and the time of reading;
* ``current``: the newest valid row of each key;
* ``refused``: rows that fail a rule, with the rules' names and the raw columns.

Loading is incremental by file name and idempotent.  A key whose newest row is invalid keeps its older
valid one; a row with the sequence of the stored one changes nothing.  Marts are nodes of a pipeline
specification (``plans.spec``) or metric views over the current rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import incremental, quality, windows
from ..sources.files import read_json_lines
from ..table import VersionedTable

LINEAGE = "_corrupt_record STRING, _source_file STRING, _source_file_name STRING, _ingested_at TIMESTAMP"


@dataclass(frozen=True)
class Feed:
    raw: Sequence[str]
    typed: Mapping[str, tuple[str, str]]  # name -> type, SQL over the raw columns
    rules: Mapping[str, str]
    key: str
    sequence: str
    keep: Sequence[str] = field(default=())  # raw columns that refused rows show as raw_<name>

    @property
    def raw_schema(self) -> str:
        return ", ".join(f"{c} STRING" for c in self.raw)

    @property
    def schema(self) -> str:
        return ", ".join(f"{c} {kind}" for c, (kind, _) in self.typed.items())

    def apply(self, landed: DataFrame) -> DataFrame:
        """Typed columns, the kept raw ones, lineage, and the names of failed rules."""
        names = [*(F.expr(sql).cast(kind).alias(c) for c, (kind, sql) in self.typed.items()), *(F.col(c).alias(f"raw_{c}") for c in self.keep)]
        return quality.with_failures(landed.select(*names, "_source_file_name", "_ingested_at"), self.rules)


#: Orders as text: money with signs and commas, days in several spellings, states in words.
ORDERS = Feed(
    raw=("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "changed"),
    typed={
        "o_orderkey": ("BIGINT", "try_cast(trim(o_orderkey) AS BIGINT)"),
        "o_custkey": ("BIGINT", "try_cast(trim(o_custkey) AS BIGINT)"),
        "o_orderstatus": ("STRING", "coalesce(element_at(map('OPEN', 'O', 'FINISHED', 'F', 'PENDING', 'P'), upper(trim(o_orderstatus))), upper(trim(o_orderstatus)))"),
        "o_totalprice": ("DECIMAL(18,2)", "try_cast(translate(o_totalprice, '$, ', '') AS DECIMAL(18,2))"),
        "o_orderdate": ("DATE", "coalesce(try_to_date(o_orderdate, 'yyyy-MM-dd'), try_to_date(o_orderdate, 'dd.MM.yyyy'))"),
        "changed": ("BIGINT", "try_cast(changed AS BIGINT)"),
    },
    rules={
        "keyed": "o_orderkey > 0",
        "has_customer": "o_custkey >= 0",
        "state_is_known": "o_orderstatus IN ('O', 'F', 'P')",
        "worth_something": "o_totalprice > 0",
        "dated": "o_orderdate >= DATE'1990-01-01'",
        "sequenced": "changed IS NOT NULL",
    },
    key="o_orderkey", sequence="changed", keep=("o_totalprice", "o_orderdate"))


@dataclass(frozen=True)
class Loaded:
    files: list[str]
    valid: int = 0
    refused: int = 0


class Lake:
    """The tables of a feed below a folder; opened if they exist."""

    def __init__(self, spark: SparkSession, base: str, feed: Feed):
        self.spark, self.feed = spark, feed
        extra = [f"raw_{c} STRING" for c in feed.keep]
        layers = {
            "landed": (f"{feed.raw_schema}, {LINEAGE}", {}),
            "current": (feed.schema, {"not_null": [feed.key], "key": [feed.key]}),
            "refused": (", ".join([feed.schema, *extra, "_source_file_name STRING, _ingested_at TIMESTAMP, dq_failures ARRAY<STRING>"]), {}),
        }
        for name, (schema, options) in layers.items():
            path = f"{base}/{name}"
            setattr(self, name, VersionedTable(spark, path) if VersionedTable.exists(spark, path) else VersionedTable.create(spark, path, schema, **options))

    def load(self, files: Sequence[str]) -> Loaded:
        """Lands the files that aren't landed yet, and sorts their rows into current and refused ones."""
        names = incremental.ingest_files(self.landed, files, lambda spark, paths: read_json_lines(spark, paths, self.feed.raw_schema))
        if not names:
            return Loaded([])
        rows = self.feed.apply(self.landed.read().where(F.col("_source_file_name").isin(*names))).persist()
        try:
            good, bad = rows.where(F.size("dq_failures") == 0), rows.where(F.size("dq_failures") > 0)
            self.refused.append(bad)
            newest = windows.latest_per_key(good, [self.feed.key], [F.desc(self.feed.sequence), F.desc("_ingested_at"), F.desc("_source_file_name")])
            self.current.upsert_sequenced(newest.select(*T.StructType.fromDDL(self.feed.schema).names), [self.feed.key], self.feed.sequence)
            return Loaded(names, good.count(), bad.count())
        finally:
            rows.unpersist()
