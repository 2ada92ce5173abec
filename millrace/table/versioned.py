"""Versioned tables: snapshots, merges, constraints and change feeds over immutable Parquet files.

A table is a folder with ``data/<commit>/...parquet`` and ``_log/<version>.json``.  A commit first
writes its files, then creates the next log entry exclusively and whole; a writer that finds the entry taken
has lost the race, deletes its files and raises.  An entry lists files added and removed, and the whole state is
repeated in every ``CHECKPOINT_EVERY``-th, so that a reader folds few entries.  The log goes
through Hadoop's file systems, so tables live wherever Spark can write.

A frame that ``read`` returns is pinned: it names immutable files, and commits that follow don't
change it.  ``read_latest`` is a function that resolves the table anew each time it is called.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors as E

CHECKPOINT_EVERY = 20


class _Store:
    """The few file operations that a log needs, through Hadoop's FileSystem."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.root = spark.sparkContext._jvm, spark.sparkContext._gateway, root
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """A file that appears whole, in one step: written aside, then renamed where no file is.  False if there is one already."""
        folder, _, leaf = name.rpartition("/")
        where, aside = self.fs.makeQualified(self.path(name)), self.fs.makeQualified(self.path(f"{folder}/.{leaf}.{uuid.uuid4().hex}"))
        stream = self.fs.create(aside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        no_options = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self.conf).rename(aside, where, no_options)
        except Exception as error:
            self.fs.delete(aside, False)
            if "FileAlreadyExists" in str(error) or "already exists" in str(error):
                return False
            raise
        return True

    def parts(self, folder: str) -> list[tuple[str, int]]:
        """Parquet files below a folder, relative to the root, with sizes."""
        base, out = self.fs.makeQualified(self.path("")).toString(), []
        files = self.fs.listFiles(self.path(folder), True)
        while files.hasNext():
            f = files.next()
            name = f.getPath().toString()
            if name.endswith(".parquet"):
                out.append((name[len(base) :].lstrip("/"), f.getLen()))
        return sorted(out)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def _rows_of(root: str, schema: T.StructType):
    """Names of Parquet files below ``root`` -> their rows, in the columns of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        system, base = fs.FileSystem.from_uri(root if "://" in root else root.replace("file:", "file://", 1))
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_file(f"{base}/{name}") as source:
                    for part in pq.ParquetFile(source).iter_batches(10_000):
                        have = part.schema.names
                        columns = [part.column(f.name).cast(f.type) if f.name in have else pa.nulls(part.num_rows, f.type) for f in kind]
                        yield pa.RecordBatch.from_arrays(columns, schema=kind)

    return run


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.store = spark, path.rstrip("/"), _Store(spark, path.rstrip("/"))

    # ---- the log ----

    @classmethod
    def exists(cls, spark: SparkSession, path: str) -> bool:
        """SRC-10."""
        return bool(_Store(spark, path.rstrip("/")).names("_log"))

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType | str, *, not_null: Sequence[str] = (), checks: Mapping[str, str] | None = None, partition_by: Sequence[str] = (), key: Sequence[str] = ()) -> VersionedTable:
        """An empty table.  ``checks``: name -> SQL condition; ``key``: columns that identify a row (for change feeds)."""
        table = cls(spark, path)
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if len(set(schema.names)) < len(schema.names):
            raise E.DuplicateColumns(f"columns {schema.names}")
        state = {"files": {}, "schema": schema.jsonValue(), "not_null": list(not_null), "checks": dict(checks or {}), "partition_by": list(partition_by), "key": list(key), "txn": {}, "append_only": True}
        table._commit(-1, "CREATE", state, [], {}, {})
        return table

    @classmethod
    def create_from(cls, df: DataFrame, path: str, **options) -> VersionedTable:
        table = cls.create(df.sparkSession, path, T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]), **options)
        table.append(df)
        return table

    def versions(self) -> list[int]:
        out = [int(n.split(".")[0]) for n in self.store.names("_log") if n.endswith(".json") and n.split(".")[0].isdigit()]
        if not out:
            raise E.TableNotFound(f"no table at {self.path}")
        return out

    def version(self) -> int:
        return self.versions()[-1]

    def _entry(self, version: int) -> dict:
        return json.loads(self.store.read(f"_log/{version:020d}.json"))

    def state(self, version: int | None = None) -> dict:
        versions = self.versions()
        version = versions[-1] if version is None else version
        if version not in versions:
            raise E.VersionNotFound(f"{self.path} has no version {version}")
        at, entries = version, []
        while True:
            entry = self._entry(at)
            entries.append(entry)
            if "state" in entry:
                break
            at -= 1
        state = entries[-1]["state"]
        for entry in reversed(entries[:-1]):
            for name in entry["remove"]:
                state["files"].pop(name, None)
            state["files"] |= entry["add"]
            state |= entry["set"]
        return state

    def _commit(self, base: int, operation: str, state: dict, remove: Iterable[str], add: Mapping[str, dict], set_: dict, metrics: dict | None = None) -> int:
        version = base + 1
        entry = {"version": version, "operation": operation, "time": time.time(), "add": dict(add), "remove": list(remove), "set": set_, "metrics": metrics or {}}
        if version % CHECKPOINT_EVERY == 0:
            files = {k: v for k, v in state["files"].items() if k not in set(entry["remove"])} | entry["add"]
            entry["state"] = state | set_ | {"files": files}
        if not self.store.create(f"_log/{version:020d}.json", json.dumps(entry)):
            for folder in {"/".join(name.split("/")[:2]) for name in entry["add"]}:
                self.store.delete(folder)
            raise E.ConcurrentWrite(f"version {version} of {self.path} was committed by another writer")
        return version

    def history(self, limit: int | None = None) -> DataFrame:
        """Versions, newest first (TBL-01)."""
        entries = [self._entry(v) for v in self.versions()[::-1][:limit]]
        rows = [(e["version"], e["operation"], e["time"], len(e["add"]), len(e["remove"]), json.dumps(e["metrics"])) for e in entries]
        return self.spark.createDataFrame(rows, "version bigint, operation string, committed double, added int, removed int, metrics string")

    # ---- reading ----

    def schema(self, version: int | None = None) -> T.StructType:
        return T.StructType.fromJson(self.state(version)["schema"])

    def _frame(self, state: dict, files: Iterable[str]) -> DataFrame:
        schema = T.StructType.fromJson(state["schema"])
        files = [f"{self.path}/{name}" for name in files]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None, partitions: Mapping[str, Sequence] | None = None) -> DataFrame:
        """A snapshot, pinned when this returns (SRC-04, SRC-05, TBL-02).

        ``partitions``: column -> wanted values; other files aren't even listed in the scan.
        """
        state = self.state(version)
        files = [n for n, f in sorted(state["files"].items()) if all(f["partition"].get(c) in {None if v is None else str(v) for v in vs} for c, vs in (partitions or {}).items())]
        df = self._frame(state, files)
        for c, vs in (partitions or {}).items():
            df = df.where(F.col(c).isin(*vs))
        return df

    def read_latest(self):
        """A function that gives the newest snapshot each time; for joins that must see later commits (TBL-03, STM-06)."""
        return lambda: self.read()

    def read_stream(self) -> DataFrame:
        """New rows as a stream, while the table is appended to and nothing else (SRC-06).

        What streams is the log: each entry names the files that its commit added, and workers read
        these, one task for some entries.  Files that no commit names never become rows; an entry that
        removes files fails the stream.
        """
        state = self.state()
        if not state["append_only"]:
            raise E.NotAppendOnly(f"{self.path} has rewritten files, which a stream would read as new rows")
        schema = T.StructType.fromJson(state["schema"])
        log = self.spark.readStream.format("text").schema("value STRING").option("wholetext", "true").option("pathGlobFilter", "*.json").load(f"{self.path}/_log")
        entry = F.from_json("value", "add MAP<STRING, STRING>, remove ARRAY<STRING>").alias("e")
        added = F.when(F.size("e.remove") > 0, F.raise_error(F.lit(f"[{E.NotAppendOnly.condition}] a commit removed files of {self.path}"))).otherwise(F.map_keys("e.add"))
        root = self.store.fs.makeQualified(self.store.path("")).toString()
        return log.select(entry).select(F.explode(added).alias("file")).mapInArrow(_rows_of(root, schema), schema)

    # ---- writing ----

    def _checked(self, df: DataFrame, state: dict, merge_schema: bool) -> tuple[DataFrame, dict]:
        """The frame in the table's columns, and what the commit changes in the schema."""
        if len(set(df.columns)) < len(df.columns):
            raise E.DuplicateColumns(f"columns {df.columns}")
        schema = T.StructType.fromJson(state["schema"])
        have = {f.name: f.dataType for f in schema}
        if missing := [c for c in state["not_null"] if c not in df.columns]:
            raise E.MissingNotNullColumn(f"columns {missing} are declared NOT NULL and missing", columns=missing)
        more = [f for f in df.schema if f.name not in have]
        if more and not merge_schema:
            raise E.SchemaMismatch(f"columns {[f.name for f in more]} are not in the table; pass merge_schema to add them", added=[f.name for f in more])
        for f in df.schema:
            if f.name in have and f.dataType.simpleString() != have[f.name].simpleString() and not (isinstance(f.dataType, T.NumericType) and isinstance(have[f.name], T.NumericType)):
                raise E.SchemaMismatch(f"column {f.name} is {f.dataType.simpleString()}, the table has {have[f.name].simpleString()}", column=f.name)
        whole = T.StructType([*schema.fields, *(T.StructField(f.name, f.dataType) for f in more)])
        given = set(df.columns)
        df = df.select(*((F.col(f"`{f.name}`") if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in whole))
        return df, ({"schema": whole.jsonValue()} if more else {})

    def _validate(self, df: DataFrame, state: dict) -> None:
        """NOT NULL and CHECK in one aggregation; a CHECK that is NULL is violated (TBL-05)."""
        nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{k}") for k, c in enumerate(state["not_null"])]
        false = [F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(f"c{k}") for k, c in enumerate(state["checks"].values())]
        if not nulls and not false:
            return
        row = df.agg(*nulls, *false).first()
        for k, c in enumerate(state["not_null"]):
            if row[f"n{k}"]:
                raise E.NotNullViolated(f"{row[f'n{k}']} rows have NULL in {c}", column=c, rows=row[f"n{k}"])
        for k, name in enumerate(state["checks"]):
            if row[f"c{k}"]:
                raise E.CheckViolated(f"{row[f'c{k}']} rows violate {name}: {state['checks'][name]}", check=name, rows=row[f"c{k}"])

    def _write(self, df: DataFrame, state: dict) -> dict[str, dict]:
        """Writes new files; returns them with their partition values.  Validates what was written, so that the input runs once."""
        folder = f"data/{uuid.uuid4().hex}"
        by = state["partition_by"]
        out = df.select("*", *(F.col(c).cast("string").alias(f"__{c}") for c in by))
        writer = out.write.partitionBy(*(f"__{c}" for c in by)) if by else out.write
        writer.parquet(f"{self.path}/{folder}")
        files = {}
        for name, size in self.store.parts(folder):
            values = dict(p.split("=", 1) for p in name.split("/")[2:-1])
            decode = self.store.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
            files[name] = {"size": size, "partition": {c: None if values[f"__{c}"] == "__HIVE_DEFAULT_PARTITION__" else decode(values[f"__{c}"]) for c in by}}
        try:
            self._validate(self._frame(state | {"schema": df.schema.jsonValue()}, files), state)
        except E.MillraceError:
            self.store.delete(folder)
            raise
        return files

    def _token(self, state: dict, txn: tuple[str, int] | None) -> dict | None:
        """What to record of a write token; None if it was seen (SNK-08)."""
        if txn is None:
            return {}
        if state["txn"].get(txn[0], -1) >= txn[1]:
            return None
        return {"txn": state["txn"] | {txn[0]: txn[1]}}

    def append(self, df: DataFrame, *, merge_schema: bool = False, txn: tuple[str, int] | None = None, sources: tuple[str, Sequence[str]] | None = None, operation: str = "APPEND") -> int | None:
        """Adds rows (SNK-01).  With a token (app, number) that was seen before, does nothing and returns None.

        ``sources``: a column, and the names of which rows were read; the same commit keeps those that no row holds in the state's ``rowless``.
        """
        base = self.version()
        state = self.state(base)
        token = self._token(state, txn)
        if token is None:
            return None
        df, change = self._checked(df, state, merge_schema)
        files = self._write(df, state)
        if sources:
            column, names = sources
            held = {r[0] for r in self._frame(state | change, files).where(F.col(column).isin(*names)).select(column).distinct().collect()}
            if rowless := [n for n in names if n not in held]:
                change |= {"rowless": [*state.get("rowless", []), *rowless]}
        return self._commit(base, operation, state, [], files, change | token)

    def overwrite(self, df: DataFrame, *, merge_schema: bool = False, operation: str = "OVERWRITE") -> int:
        """Replaces all rows; the frame may read the table itself, for its files stay (TBL-04)."""
        base = self.version()
        state = self.state(base)
        df, change = self._checked(df, state, merge_schema)
        return self._commit(base, operation, state, state["files"], self._write(df, state), change | {"append_only": False})

    def replace_where(self, df: DataFrame, condition: str) -> int:
        """Replaces the rows for which ``condition`` is true by those of ``df``, for which it must be true (SNK-07).

        Only files that hold such rows are rewritten.
        """
        base = self.version()
        state = self.state(base)
        df, change = self._checked(df, state, False)
        outside = df.where(~F.coalesce(F.expr(condition), F.lit(False))).limit(1).count()
        if outside:
            raise E.CheckViolated(f"rows to write don't meet {condition}")
        touched = self._touched(state, self._frame(state, state["files"]).where(F.expr(condition)))
        kept = self._frame(state, touched).where(~F.coalesce(F.expr(condition), F.lit(False)))
        return self._commit(base, "REPLACE WHERE", state, touched, self._write(kept.unionByName(df), state), change | {"append_only": False})

    def delete(self, condition: str) -> int:
        base = self.version()
        state = self.state(base)
        touched = self._touched(state, self._frame(state, state["files"]).where(F.expr(condition)))
        kept = self._frame(state, touched).where(~F.coalesce(F.expr(condition), F.lit(False)))
        return self._commit(base, "DELETE", state, touched, self._write(kept, state), {"append_only": False})

    def _touched(self, state: dict, rows: DataFrame) -> list[str]:
        """The files that hold given rows of the table; as many names at most as the table has files."""
        if not state["files"]:
            return []
        root = self.store.fs.makeQualified(self.store.path("")).toString()
        found = {self._plain(r[0], root) for r in rows.select("_metadata.file_path").distinct().collect()}
        return [n for n in state["files"] if n in found]

    @staticmethod
    def _plain(uri: str, root: str) -> str:
        from urllib.parse import unquote

        strip = lambda u: u.split(":", 1)[-1].lstrip("/") if u.startswith("file:") else u
        name = strip(uri)[len(strip(root)) :].lstrip("/")
        return name if "%" not in name else unquote(name)

    def merge(self, source: DataFrame, on: Sequence[str], *, update: Mapping[str, str | Column] | str | None = None, update_if: str | None = None, delete_if: str | None = None,
              insert: Mapping[str, str | Column] | str | None = None, insert_if: str | None = None, target_if: str | None = None, txn: tuple[str, int] | None = None, operation: str = "MERGE") -> int | None:
        """MERGE on equal keys (NULL keys never match).

        ``update`` and ``insert``: ``"*"``, or column -> SQL with ``s`` for the source row and ``t``
        for the target row; ``*_if`` are conditions on them; ``target_if`` limits which target rows
        can match.  With an update or delete, two source rows for one target row raise (SNK-05).
        Only files that hold a matched row are rewritten.
        """
        base = self.version()
        state = self.state(base)
        token = self._token(state, txn)
        if token is None:
            return None
        if len(set(source.columns)) < len(source.columns):
            raise E.DuplicateColumns(f"columns {source.columns}")
        source = source.persist()  # read up to three times
        try:
            return self._merge(base, state, token, source, on, update, update_if, delete_if, insert, insert_if, target_if, operation)
        finally:
            source.unpersist()

    def _merge(self, base, state, token, source, on, update, update_if, delete_if, insert, insert_if, target_if, operation) -> int:
        target = self._frame(state, state["files"])
        columns = [f.name for f in T.StructType.fromJson(state["schema"])]
        keys = source.select(*on).where(" AND ".join(f"`{k}` IS NOT NULL" for k in on))
        matchable = target.where(F.expr(target_if)) if target_if else target
        if update is None and delete_if is None:
            new = source.join(matchable.select(*on), list(on), "left_anti")
            new = new.where(F.expr(insert_if)) if insert_if else new
            new = self._inserts(new, insert or "*", columns)
            df, _ = self._checked(new, state, False)
            return self._commit(base, operation, state, [], self._write(df, state), token)
        if keys.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").join(matchable.select(*on), list(on), "left_semi").limit(1).count():
            raise E.MultipleSourceRowsMatched(f"rows of the source share a key {list(on)} of the target")
        touched = self._touched(state, matchable.select(*on, "_metadata").join(keys, list(on), "left_semi")) if state["files"] else []
        t = self._frame(state, touched)
        t = t.select(F.struct(*columns).alias("t"), *(F.when(F.expr(target_if) if target_if else F.lit(True), F.col(k)).alias(f"__t{i}") for i, k in enumerate(on)))
        s = source.select(F.struct("*").alias("s"), *(F.col(k).alias(f"__s{i}") for i, k in enumerate(on)))
        joined = t.join(s, [t[f"__t{i}"] == s[f"__s{i}"] for i in range(len(on))], "full")
        both = F.col("t").isNotNull() & F.col("s").isNotNull()
        change = both & F.coalesce(F.expr(update_if) if update_if else F.lit(True), F.lit(False)) if update is not None else F.lit(False)
        gone = both & F.coalesce(F.expr(delete_if), F.lit(False)) if delete_if else F.lit(False)
        fresh = F.col("t").isNull() & F.coalesce(F.expr(insert_if) if insert_if else F.lit(True), F.lit(False)) if insert is not None else F.lit(False)
        values = lambda spec, old: {c: (F.col(f"s.`{c}`") if c in source.columns else old(c)) if spec == "*" else self._sql(spec[c]) if spec and c in spec else old(c) for c in columns}
        ups, ins = values(update, lambda c: F.col(f"t.`{c}`")), values(insert, lambda c: F.lit(None))
        out = joined.where(~gone & (F.col("t").isNotNull() | fresh)).select(*(F.when(change, ups[c]).when(F.col("t").isNotNull(), F.col(f"t.`{c}`")).otherwise(ins[c]).alias(c) for c in columns))
        df, _ = self._checked(out, state, False)
        return self._commit(base, operation, state, touched, self._write(df, state), token | {"append_only": False})

    @staticmethod
    def _sql(value: str | Column) -> Column:
        return F.expr(value) if isinstance(value, str) else value

    def _inserts(self, new: DataFrame, insert: Mapping | str, columns: list[str]) -> DataFrame:
        if insert == "*":
            return new.select(*(c for c in columns if c in new.columns))
        s = new.select(F.struct("*").alias("s"))
        return s.select(*(self._sql(v).alias(c) for c, v in insert.items()))

    def upsert_sequenced(self, updates: DataFrame, keys: Sequence[str], sequence: str) -> int | None:
        """Inserts new keys; changes known ones only to a strictly later sequence, so that a tie keeps the target (SNK-03)."""
        return self.merge(updates, keys, update="*", update_if=f"s.`{sequence}` > t.`{sequence}`", insert="*", operation="UPSERT")

    # ---- changes and upkeep ----

    def changes(self, since: int, until: int | None = None, keys: Sequence[str] | None = None) -> DataFrame:
        """Rows that differ between two versions, with ``_change_type`` insert, delete, update_preimage or update_postimage (TBL-08, SRC-14)."""
        until = self.version() if until is None else until
        keys = list(keys or self.state(until)["key"])
        if not keys:
            raise E.InvalidSpec("a change feed needs key columns")
        columns = self.schema(until).names
        old_columns = set(self.schema(since).names)
        a = self.read(since)
        a = a.select(F.struct(*((F.col(c) if c in old_columns else F.lit(None).cast(self.schema(until)[c].dataType)).alias(c) for c in columns)).alias("a"))
        b = self.read(until).select(F.struct(*columns).alias("b"))
        joined = a.join(b, [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys], "full").where(~F.col("a").eqNullSafe(F.col("b")))
        kinds = F.when(F.col("a").isNull(), F.array(F.struct(F.lit("insert").alias("_change_type"), F.col("b").alias("r")))).when(
            F.col("b").isNull(), F.array(F.struct(F.lit("delete").alias("_change_type"), F.col("a").alias("r")))).otherwise(
            F.array(F.struct(F.lit("update_preimage").alias("_change_type"), F.col("a").alias("r")), F.struct(F.lit("update_postimage").alias("_change_type"), F.col("b").alias("r"))))
        return joined.select(F.explode(kinds).alias("x")).select("x.r.*", "x._change_type")

    def optimize(self, files: int | None = None, cluster_by: Sequence[str] = (), file_bytes: int = 128 << 20) -> int:
        """Rewrites into ``files`` files, by default as many as make about ``file_bytes`` each; by ranges of ``cluster_by`` and sorted if given (TBL-09)."""
        base = self.version()
        state = self.state(base)
        files = files or max(1, -(-sum(f["size"] for f in state["files"].values()) // file_bytes))
        df = self._frame(state, state["files"])
        df = df.repartitionByRange(files, *cluster_by).sortWithinPartitions(*cluster_by) if cluster_by else df.repartition(files)
        return self._commit(base, "OPTIMIZE", state, state["files"], self._write(df, state), {"append_only": False})

    def vacuum(self, keep_versions: int = 1) -> int:
        """Deletes files that none of the newest versions names; older versions can no longer be read.  Returns their number."""
        kept = {n for v in self.versions()[-keep_versions:] for n in self.state(v)["files"]}
        gone = [n for n, _ in self.store.parts("data") if n not in kept]
        for name in gone:
            self.store.delete(name)
        return len(gone)
