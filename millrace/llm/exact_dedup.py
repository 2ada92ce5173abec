"""Exact deduplication with a persistent digest index.

The index is a Parquet table of ``(digest, keep_id, rows, batch)``, bucketed and sorted by digest and
partitioned by batch: a batch adds one row for each of its different texts, which holds the text's
``keep_id`` if the batch brought the text, else null.  A new batch is digested, pre-aggregated to one row
for each digest (so that a text with any number of copies is one row before anything is joined),
deduplicated against the index with a sort-merge anti-join that reads the buckets without a shuffle,
and appended.  Everything is DataFrame code; no Python runs on the executors.

``_index`` beside the files says how many buckets there are, so that a reopened index can't be read
with another number.  ``_batches/<n>`` names the n-th batch and appears in one step, after the batch's
files: files of a batch that isn't named there (a writer that crashed, or that lost against another)
are never read.

Defined results
---------------
* Texts are equal when identical after lower-casing A-Z only; a null text counts as empty, and
  all empty texts are copies of each other.
* Of equal texts within a batch, the row with the largest id stays; a text that the index
  already holds keeps the id that the index has.
* ``group_size``: rows with the text in all batches up to this one.
* A row whose id is null can stay only if no equal text has an id (its ``keep_id`` is null).
* Rows that repeat id and text each get a row in the decisions; ``deduplicate`` returns one of them.
* An empty batch appends nothing and gives no decisions.
* Of two writers that append at once, the later raises ``RuntimeError`` and has appended nothing.
* Ids are cast to 64-bit integers; others are an error.
* Other columns, whatever their names, do not matter: only id and text are read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io

#: Digests that a bucket of a fresh index holds on average, at most.
BUCKET_DIGESTS = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Lower-cases A-Z only.  lower() is the faster equal of it for texts of ASCII alone."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


class DigestIndex:
    """All digests seen so far, below ``path`` (a folder that driver and executors share).

    ``buckets`` holds for a new index; one that exists has its own number, and another is an error.
    """

    COLUMNS = "digest BINARY, keep_id BIGINT, rows BIGINT, batch STRING"

    def __init__(self, spark: SparkSession, path: str, name: str, buckets: int | None = None):
        self.spark, self.path, self.name, self._listed = spark, path, name, set()
        stored = _io.read_text(spark, f"{path}/_index")
        if stored is None:
            stored = str(buckets or 64)
            if not _io.create_text(spark, f"{path}/_index", stored):
                stored = _io.read_text(spark, f"{path}/_index")
        self.buckets = int(stored)
        if buckets is not None and buckets != self.buckets:
            raise ValueError(f"the index at {path} has {self.buckets} buckets, not {buckets}")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({self.COLUMNS}) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def batches(self) -> list[str]:
        """The batches that were appended, in order."""
        return [_io.read_text(self.spark, f"{self.path}/_batches/{n}") for n in _io.names(self.spark, f"{self.path}/_batches")]

    def table(self) -> DataFrame:
        """The index as a bucketed table: a sort-merge join on digest reads it without a shuffle."""
        batches = self.batches()
        if not self._listed.issuperset(batches):  # of other writers, or of an index that is opened again
            self.spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")
            self._listed.update(batches)
        return self.spark.table(self.name).where(F.col("batch").isin(batches)).select("digest", "keep_id", "rows")

    def groups(self) -> DataFrame:
        """digest, keep_id, group_size of all texts, from plain files: joins with it are shuffled, so that skewed sides can be split."""
        paths = [f"{self.path}/batch={b}" for b in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], "digest binary, keep_id bigint, group_size bigint")
        rows = self.spark.read.schema("digest binary, keep_id bigint, rows bigint").parquet(*paths)
        if len(paths) == 1:
            return rows.withColumnRenamed("rows", "group_size")
        return rows.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("rows").alias("group_size"))

    def append(self, digests: DataFrame) -> None:
        """Adds a batch.  ``digests``: digest, id; one row for each document."""
        known = self.batches()
        groups = digests.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("rows"))
        held = self.table()
        if known:
            groups = _io.materialise(groups, "groups")
        new = groups.join(held.select("digest").hint("merge"), "digest", "left_anti")
        if known:
            again = groups.join(held.select("digest").hint("merge"), "digest", "left_semi").withColumn("keep_id", F.lit(None).cast("bigint"))
            new = new.unionByName(again)
        batch = uuid.uuid4().hex
        new = _io.materialise(new.withColumn("batch", F.lit(batch)), "new-digests")  # a table can't be read and appended to in one job
        if new.isEmpty():
            return
        (new.repartition(self.buckets, "digest").sortWithinPartitions("digest")
            .write.mode("append").format("parquet").partitionBy("batch").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name))
        self.spark.catalog.refreshTable(self.name)
        if not _io.create_text(self.spark, f"{self.path}/_batches/{len(known):08d}", batch):
            _io.drop(self.spark, f"{self.path}/batch={batch}")
            raise RuntimeError(f"another writer has appended to {self.path} meanwhile")


def digests_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), digest(F.col(text_col)).alias("digest"))


def _appended(docs: DataFrame, index: DigestIndex | None, id_col: str, text_col: str) -> tuple[DataFrame, DigestIndex]:
    digests = _io.materialise(digests_of(docs, id_col, text_col), "digests")
    passing = index is None
    index = index or fresh_index(docs.sparkSession, digests.count())
    index.append(digests)
    if passing:  # its files are read by path from here on; the catalog need not keep it
        index.spark.sql(f"DROP TABLE {index.name}")
    return digests, index


def decide(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds a batch to the index (an empty one by default); returns id, digest, keep_id, group_size, kept, one row for each row of the batch.

    The digests are written once and read by both the index's append and the final join; in that
    join both sides are shuffled, so that a digest with many copies is split by AQE.
    """
    digests, index = _appended(docs, index, id_col, text_col)
    return (digests.join(index.groups(), "digest", "left")
            .select("id", "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept")))


def fresh_index(spark: SparkSession, rows: int = 0) -> DigestIndex:
    """An empty index below the shared folder, with as many buckets as so many rows need."""
    path = _io.scratch(spark, "digest-index")
    return DigestIndex(spark, path, path.rsplit("/", 1)[1].replace("-", "_"), buckets=min(1 << 16, max(16, 1 << (rows // BUCKET_DIGESTS).bit_length())))


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns, one for each different text."""
    digests, index = _appended(docs, index, id_col, text_col)
    rows = digests.where("id IS NOT NULL").groupBy("digest", "id").agg(F.count(F.lit(1)).alias("n"))
    kept = _io.materialise(rows.join(index.groups(), "digest").where("id = keep_id").select("id", "digest", "n"), "kept")
    once, again = (kept.where(c).select("id", "digest") for c in ("n = 1", "n > 1"))
    name = "__digest"
    while name in docs.columns:
        name += "_"
    named = docs.withColumn(name, digest(F.col(text_col)))

    def held(by: DataFrame) -> DataFrame:
        """By id and text: an id may stay for one of its texts and go for another."""
        return named.join(by, (named[id_col].cast("bigint") == by["id"]) & (named[name] == by["digest"]), "left_semi")

    out = held(once).drop(name)
    if not again.isEmpty():
        out = out.unionByName(held(again).dropDuplicates([id_col, name]).drop(name))
    if not digests.where("id IS NULL").isEmpty():
        bare, known = named.where(F.col(id_col).isNull()), index.groups().where("keep_id IS NOT NULL")
        out = out.unionByName(bare.join(known, bare[name] == known["digest"], "left_anti").dropDuplicates([name]).drop(name))
    return out


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decide(docs).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g ON d.text_sha256 = g.text_sha256
"""
