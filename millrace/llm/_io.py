"""Where operators of this subpackage keep intermediate tables and model files.

Everything that more than one process reads goes below the folder that the cluster
names in ``spark.checkpoint.dir``.  Machine-local temporary folders are used only
when that setting is absent *and* the session is a local one, as in tests.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """URI of the folder shared by the driver and all executors."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="millrace-shared-")
        atexit.register(shutil.rmtree, _fallback[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_fallback[app])
    return f"file://{_fallback[app]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh, not yet existing path below the shared folder; removed when the driver ends."""
    path = f"{shared_root(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        if jvm is not None:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone already; nothing is left to undo then
        pass


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that is no longer needed."""
    _remove(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, records: int = 1000) -> None:
    """Fewer rows in an Arrow batch than Spark's default of 10,000, which texts make large; a value set by the user stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(records))


def qualified(spark: SparkSession, path: str) -> str:
    """A path of Spark's as a URI that workers open."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def write_file(folder: str, name: str, parts) -> None:
    """A file below ``folder`` (a URI) that appears whole or not at all, also where a task runs twice.  ``parts``: its bytes."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as out:
        for part in parts:
            out.write(part)
    try:
        fs.move(temporary, f"{path}/{name}")
    except OSError:  # some stores don't move onto a file that an earlier run of the task has left
        if fs.get_file_info(f"{path}/{name}").type == pafs.FileType.NotFound:
            raise
        fs.delete_file(temporary)


def read_file(folder: str, name: str) -> bytes | None:
    """The bytes of a file, or None where there is none."""
    fs, path = pafs.FileSystem.from_uri(folder)
    if fs.get_file_info(f"{path}/{name}").type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(f"{path}/{name}") as source:
        return source.read()


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what is in a folder, in order; none where there is no folder."""
    where, fs = _file_system(spark, folder)
    return sorted(n for s in fs.listStatus(where) if not (n := s.getPath().getName()).startswith(".")) if fs.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    where, fs = _file_system(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """A small file that appears whole, in one step; False if it is there already."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    where, fs = _file_system(spark, path)
    where = fs.makeQualified(where)
    aside = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}.{uuid.uuid4().hex}")
    stream = fs.create(aside, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(
            aside, where, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Exception as error:
        fs.delete(aside, False)
        if "FileAlreadyExists" in str(error) or "already exists" in str(error):
            return False
        raise
    return True
