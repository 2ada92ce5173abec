"""File sources (SRC).  Schemas are declared; inference exists to show what it does."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidSpec

FORMATS = ("csv", "json", "parquet", "text", "xml", "orc")


def with_lineage(df: DataFrame) -> DataFrame:
    """Path and name of each row's file, and the time of reading (SRC-03)."""
    return df.select("*", F.col("_metadata.file_path").alias("_source_file"), F.col("_metadata.file_name").alias("_source_file_name"), F.current_timestamp().alias("_ingested_at"))


def read_json_lines(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """JSON lines; a malformed line keeps its text in ``_corrupt_record`` and is NULL elsewhere (SRC-01, SRC-03)."""
    reader = spark.read.schema(f"{schema}, _corrupt_record STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return with_lineage(reader.json(list(paths) if not isinstance(paths, str) else paths))


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str, **options) -> DataFrame:
    """CSV with a header and a declared schema (SRC-02)."""
    return spark.read.schema(schema).options(header=True, enforceSchema=False, **options).csv(path if isinstance(path, str) else list(path))


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """JSON with an inferred schema: one odd value makes a column STRING (SRC-09).  For contrast."""
    return spark.read.json(path)


def read_batch(spark: SparkSession, kind: str, path: str | Sequence[str], schema: str | None = None, **options) -> DataFrame:
    """csv, json, parquet, text, xml or orc files (SRC-13)."""
    if kind not in FORMATS:
        raise InvalidSpec(f"unknown format {kind!r}; there are {FORMATS}")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path if isinstance(path, str) else list(path))


def discover(spark: SparkSession, folder: str, schema: str, kind: str = "json", max_files: int = 1000, rescue: bool = True) -> DataFrame:
    """A stream over files as they arrive (SRC-11).  What the schema doesn't name is kept as JSON in ``_rescued_data``.

    The checkpoint is the ledger of files seen.  Only JSON lines can be rescued; other kinds need
    ``rescue=False``.
    """
    if not rescue:
        return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", max_files).load(folder)
    if kind != "json":
        raise InvalidSpec("only JSON lines can be rescued")
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(folder)
    return parse_rescued(lines, "value", schema)


def parse_rescued(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """Parses JSON text by a schema; keys that it lacks go to ``_rescued_data`` as a JSON object, or NULL if there are none."""
    known = F.array(*(F.lit(n) for n in T.StructType.fromDDL(schema).names))
    whole = F.from_json(F.col(column), "map<string,string>")
    extra = F.map_filter(whole, lambda k, v: ~F.array_contains(known, k))
    return lines.select(F.from_json(F.col(column), schema).alias("r"), extra.alias("x")).select("r.*", F.when(F.size("x") > 0, F.to_json("x")).alias("_rescued_data"))


def reconcile_rescued(df: DataFrame, schema: str, rescued: str = "_rescued_data") -> DataFrame:
    """Columns that came to the schema later: their values, or else those among the rescued (SRC-15)."""
    found = df.withColumn("__r", F.from_json(F.col(rescued), schema))
    columns = {}
    for f in T.StructType.fromDDL(schema):
        late = F.col(f"__r.{f.name}")
        columns[f.name] = F.coalesce(F.col(f.name), late) if f.name in df.columns else late
    return found.withColumns(columns).drop("__r")
