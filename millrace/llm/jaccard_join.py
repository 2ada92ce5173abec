"""N-gram Jaccard self-join of documents with a MinHash LSH forest.

1. Each text becomes the set of its word 5-gram hashes.  Texts with equal sets are one *class*
   (exact copies, or copies up to case and punctuation); its smallest id represents it.
2. A representative gets ``max_depth`` MinHash values in each of ``trees`` trees.  The values of a tree
   are its signature, packed into one 64-bit number whose order is that of the tree's prefix trie: the
   members of a trie node are a run of the sorted signatures.
3. A document starts with its whole signatures as prefixes and meets those that share one in some tree.
   Each step shortens its prefix in one more tree by one value.  It stops at the first step after
   which a partner of the least similarity that *it* can have shares a prefix with it in some tree with
   at least the probability ``recall``.  That similarity follows from the size of the document's set:
   sizes and intersections are whole numbers, so that small sets have partners only well above the
   threshold, and some have none; those stay out of the forest.  A pair meets where either of the two
   looks.  ``recall`` holds for each pair, not on average, so that no link is traded for another.
4. The nodes at the shortest prefixes are the candidates.  A node whose members all meet in a node
   of an earlier tree adds nothing and is left out.  A large node is cut into blocks, and each
   pair of blocks is one unit of work, so that no task holds an unbounded node; no node is capped.
5. Within a unit the lengths of common prefixes say which pairs meet; their exact intersection sizes are
   counted by matrix products over the shingles that two members share.  A pair that met in an earlier
   tree is not counted again.  A unit returns one row per member (its links, and the smallest member of
   its linked set), never pairs.
6. Linked sets are merged into groups by alternating large-star and small-star steps over
   tables in the shared folder.

Defined results
---------------
* Words: maximal runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z.  A text with
  fewer than five words, but not none, has one shingle of all its words.
* A text without words (null, empty, punctuation) has no shingles and is alone in its group.
* ``n_links``: other *different* classes whose Jaccard similarity is at least the threshold;
  copies are not counted, and all members of a class have the same number.
* ``class_id``: the smallest id of all documents linked to each other directly or in a chain.
* Every row of the input gives one row, also where ids repeat; rows without an id are left alone
  (``class_id`` null).  An empty table gives no rows.  Other columns do not matter.
* Rows that share an id but not a text are documents of their own, each with its own links; classes
  whose smallest id is the same are in one group.
* Shingles are compared by 64-bit hashes.  Ids are cast to 64-bit integers; others are an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io
from . import _kernel as K
from ._kernel import U64

WIDTH, THRESHOLD, TREES, MAX_DEPTH, RECALL = 5, 0.8, 16, 8, 0.9995
#: Members and shingles of a block; a unit of work holds two blocks.
BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 400_000
#: Bits of a signature that the shortest prefix takes; the longer ones share the rest.  Sets of SMALL shingles and more may have a partner just at the threshold.  A file has about SHARD_IDS ids at most.
PREFIX_BITS, SMALL, SHARD_IDS = 48, 64, 4_000_000


def least_similarity(size: int, threshold: float = THRESHOLD) -> float | None:
    """The least Jaccard similarity, at or above the threshold, of a set of ``size`` elements with another set; None if there is none below 1."""
    if size >= SMALL:
        return threshold
    found = []
    for other in range(math.ceil(threshold * size - 1e-9), math.floor(size / threshold + 1e-9) + 1):
        inner = math.ceil(threshold * (size + other) / (1 + threshold) - 1e-9)
        if inner <= min(size, other) and not inner == size == other:
            found.append(inner / (size + other - inner))
    return min(found, default=None)


class Forest:
    """Prefix lengths of the trees after each number of steps, and where they lie in a signature."""

    def __init__(self, threshold: float = THRESHOLD, trees: int = TREES, max_depth: int = MAX_DEPTH, recall: float = RECALL):
        self.threshold, self.trees, self.max_depth, self.recall = threshold, trees, max_depth, recall
        self.most = self.steps(threshold)
        floor = min(self.depth(t, self.most) for t in range(trees))
        above = max_depth - floor
        self.bits = [PREFIX_BITS // floor] * floor + [(64 - PREFIX_BITS) // above] * above if above else [64 // floor] * floor
        #: By tree and steps: the largest difference of two signatures that share the prefix.
        self.reach = np.array([[(1 << self.shift(t, n)) - 1 for n in range(self.most + 1)] for t in range(trees)], U64)
        #: By size of a set: steps, or -1 where no partner is possible.
        self.steps_of = np.array([-1 if (s := least_similarity(n, threshold)) is None else self.steps(s) for n in range(SMALL + 1)], np.int32)

    def depth(self, tree: int, steps: int) -> int:
        """Length of a tree's prefix after so many steps, each of which shortens one tree, in turn."""
        return self.max_depth - steps // self.trees - (tree < steps % self.trees)

    def met(self, similarity: float, steps: int) -> float:
        """Probability that a pair shares a prefix in some tree after so many steps."""
        return 1 - math.prod(1 - similarity ** self.depth(t, steps) for t in range(self.trees))

    def steps(self, similarity: float) -> int:
        """The first number of steps after which a pair has met with the target probability; at most down to prefixes of one value."""
        most = self.trees * (self.max_depth - 1)
        return next((n for n in range(most) if self.met(similarity, n) >= self.recall), most)

    def shift(self, tree: int, steps: int) -> int:
        """Bits of a signature behind the tree's prefix."""
        return 64 - sum(self.bits[: self.depth(tree, steps)])


def _sets(batch_text: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, shingles, bounds); shingles are sorted and unique within each text."""
    for lo, hi, data, offsets in K.chunks(batch_text):
        _, _, _, doc, hashes = K.tokens(data, offsets, K.WORD)
        sh, bounds = K.shingles(hashes, doc, hi - lo, width)
        sets = [np.unique(sh[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield lo, hi, np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])))


def _sign(width: int, forest: Forest):
    """id, text -> id, digest of the shingle set, its size, the steps it needs, and its signature in each tree."""
    trees, bits = forest.trees, forest.bits
    odd = (K.series(11, trees * len(bits)) | U64(1)).reshape(trees, len(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, sh, bounds in _sets(batch.column(1), width):
                size = np.diff(bounds)
                steps = np.where(size > 0, forest.steps_of[np.minimum(size, SMALL)], -1)
                full = np.flatnonzero(size)
                keys = np.zeros((hi - lo, trees), U64)
                for t in range(trees if len(full) else 0):
                    at = 64
                    for d, n in enumerate(bits):
                        x = sh * odd[t, d]
                        x ^= x >> U64(29)
                        at -= n
                        keys[full, t] |= K.mix(np.minimum.reduceat(x, bounds[full]) + U64(t + 1)) >> U64(64 - n) << U64(at)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * trees, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(_digests(sh, bounds), pa.binary()), pa.array(size, pa.int64()), pa.array(steps, pa.int32()), flat], ["id", "digest", "size", "steps", "keys"])

    return run


def _digests(shingles: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    return [hashlib.blake2b(shingles[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _store_ids(folder: str):
    """The ids of a shard -> its file."""

    def run(table: pa.Table) -> pa.Table:
        K.write_arrays(folder, f"ids-{table.column('shard')[0].as_py()}", [np.unique(table.column("id").to_numpy())])
        return pa.table({"n": pa.array([table.num_rows], pa.int64())})

    return run


def _shard_ids(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(K.top(K.mix(ids.view(U64)), bits), pa.int32()), batch.column(0)], ["shard", "id"])

    return run


def _shingle_sets(width: int, folder: str, bits: int):
    """id, text -> digest and shingle set, of the ids in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            ids = batch.column(0).to_numpy()
            shard = K.top(K.mix(ids.view(U64)), bits)
            wanted = np.zeros(len(ids), bool)
            for s in np.unique(shard).tolist():
                if (arrays := K.mapped_arrays(folder, f"ids-{s}", ("<i8",))) is not None:
                    wanted[shard == s] = _held(arrays[0], ids[shard == s])
            for _, _, sh, bounds in _sets(batch.filter(pa.array(wanted)).column(1), width):
                yield pa.RecordBatch.from_arrays([pa.array(_digests(sh, bounds), pa.binary()), pa.array([sh[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["digest", "shingles"])

    return run


def _held(stored: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return stored[np.minimum(np.searchsorted(stored, wanted), len(stored) - 1)] == wanted


def meet(keys: np.ndarray, steps: np.ndarray, tree: int, forest: Forest) -> np.ndarray:
    """Which pairs share a prefix of the tree that one of the two looks at."""
    reach = forest.reach[tree][steps]
    return (keys[:, tree][:, None] ^ keys[:, tree][None, :]) <= np.maximum(reach[:, None], reach[None, :])


def _linked(ids: np.ndarray, side: np.ndarray, keys: np.ndarray, steps: np.ndarray, sets: list[np.ndarray], tree: int, forest: Forest, crossed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of each member, and the smallest id of the members linked with it in a chain.

    ``crossed``: only pairs between side 0 and side 1 count, else all pairs.
    """
    n, size = len(ids), np.array([len(s) for s in sets], np.float64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size.astype(np.int64))
    value, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[inverse] > 1
    owner, column = owner[shared], (np.cumsum(count > 1) - 1)[inverse[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, n), np.float32)
    step, width = 4096, int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, width, step):
        a, b = np.searchsorted(column, (lo, lo + step))
        part = np.zeros((n, min(step, width - lo)), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        both += part @ part.T
    links = (both >= forest.threshold * (size[:, None] + size[None, :] - both) - 1e-9) & meet(keys, steps, tree, forest)
    np.fill_diagonal(links, False)
    if crossed:
        links &= side[:, None] != side[None, :]
    new = links.copy()
    for t in range(tree):
        new &= ~meet(keys, steps, t, forest)
    root = ids.copy()
    while True:  # the smallest id spreads along links
        least = np.where(links, root[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        least = np.minimum(root, least)
        if (least == root).all():
            return new.sum(axis=1), root
        root = least


def _verify(forest: Forest):
    """Sorted rows of units -> digest, rep, root, links."""

    def unit(rows: list[tuple]) -> tuple[list, list, list, list]:
        rows = list({(r[4], r[3]): r for r in rows}.values())
        ids = np.array([r[5] for r in rows], np.int64)
        side = np.array([r[3] for r in rows])
        keys = np.array([np.asarray(r[6], np.int64) for r in rows]).reshape(len(rows), forest.trees).view(U64)
        sets = [np.frombuffer(r[8], U64) for r in rows]
        links, root = _linked(ids, side, keys, np.array([r[7] for r in rows]), sets, rows[0][0], forest, rows[0][2] != 0)
        some = np.flatnonzero((links > 0) | (root != ids))
        return [rows[k][4] for k in some], ids[some].tolist(), root[some].tolist(), links[some].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        out: tuple[list, list, list, list] = ([], [], [], [])

        def flush(final: bool) -> pa.RecordBatch | None:
            if out[0] and (final or len(out[0]) >= 20_000):
                made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), *(pa.array(x, pa.int64()) for x in out[1:])], ["digest", "rep", "root", "links"])
                for x in out:
                    x.clear()
                return made
            return None

        def close() -> None:
            if len(rows) > 1:
                for x, y in zip(out, unit(rows), strict=True):
                    x.extend(y)
            rows.clear()

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(9)), strict=True):
                if rows and row[:3] != rows[0][:3]:
                    close()
                rows.append(row)
            if made := flush(False):
                yield made
        close()
        if made := flush(True):
            yield made

    return run


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node of each connected component.  ``edges``: a, b (bigint, both not null).

    Alternating large-star and small-star steps; only counts come to the driver.  The minimum of a
    node's neighbours is pre-aggregated, written and joined back with both sides shuffled, so that
    adaptive execution can split a node with any number of neighbours.
    """
    now = _io.materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    spark, before = edges.sparkSession, None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _io.materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), name)
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = _io.materialise(small, name)
        after = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = new
        if tuple(after) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(after)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, width: int = WIDTH,
                 trees: int = TREES, max_depth: int = MAX_DEPTH, recall: float = RECALL) -> DataFrame:
    """id, copy_id (representative of equal shingle sets), class_id, n_links, one row for each row of ``docs``."""
    forest = Forest(threshold, trees, max_depth, recall)
    _io.bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    signs = _io.materialise(texts.mapInArrow(K.giving_back(_sign(width, forest)), "id bigint, digest binary, size bigint, steps int, keys array<bigint>"), "signatures")
    known = signs.where("size > 0 AND id IS NOT NULL")
    reps = _io.materialise(known.groupBy("digest").agg(F.min(F.struct("id", "size", "steps", "keys")).alias("r")).select("digest", "r.*"), "representatives")

    # Nodes with two members or more, less those inside a node of an earlier tree.
    short = [forest.shift(t, forest.most) for t in range(trees)]
    node = F.expr("shiftrightunsigned(key, element_at(array(" + ",".join(map(str, short)) + "), tree + 1))")
    at = reps.where("steps >= 0").select(F.posexplode("keys").alias("tree", "key"), "digest", "size").withColumn("node", node)
    crowded = at.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("tree", "node")
    at = at.join(crowded, ["tree", "node"]).join(reps.select("digest", F.col("id").alias("rep"), "steps", "keys"), "digest")  # most nodes have one member; keys come back for the rest
    at = _io.materialise(at, "crowded")
    inside = F.lit(False)
    for t in range(trees - 1):
        inside = inside | ((F.col("tree") > t) & (F.col(f"lo{t}") == F.col(f"hi{t}")))
    ends = [f(F.expr(f"shiftrightunsigned(keys[{t}], {short[t]})")).alias(f"{n}{t}") for t in range(trees - 1) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    nodes = at.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("weight"), F.min("steps").alias("least"), *ends).where(~(inside & (F.col("least") == forest.most)))
    nodes = nodes.select("tree", "node", F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int").alias("blocks"))

    # Units: pairs of blocks of a node.  A member goes to the units that hold its block.
    member = at.join(nodes, ["tree", "node"]).withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    unit = member.select("tree", "node", "key", "digest", "rep", "keys", "steps", "block", other).select(
        "tree", F.concat_ws("/", "node", F.concat_ws(":", F.least("block", "other"), F.greatest("block", "other"))).alias("unit"),
        (F.col("block") != F.col("other")).cast("int").alias("crossed"), (F.col("block") > F.col("other")).cast("int").alias("side"), "digest", "rep", "keys", "steps", "key")
    unit = _io.materialise(unit, "units")
    # Their sets: a file of ids says to each task which texts it must read; texts aren't shuffled.
    wanted = unit.select(F.col("rep").alias("id")).distinct()
    bits, folder = int(reps.count() // SHARD_IDS).bit_length(), _io.qualified(docs.sparkSession, _io.scratch(docs.sparkSession, "wanted"))
    wanted.mapInArrow(_shard_ids(bits), "shard int, id bigint").groupBy("shard").applyInArrow(_store_ids(folder), "n bigint").agg(F.sum("n")).collect()
    sets = texts.mapInArrow(K.giving_back(_shingle_sets(width, folder, bits)), "digest binary, shingles binary").dropDuplicates(["digest"])
    rows = unit.join(sets, "digest").select("tree", "unit", "crossed", "side", "digest", "rep", "keys", "steps", "shingles", "key")
    rows = rows.repartition("tree", "unit").sortWithinPartitions("tree", "unit", "key").drop("key")  # in a unit, in the order of the trie
    found = _io.materialise(rows.mapInArrow(K.giving_back(_verify(forest)), "digest binary, rep bigint, root bigint, links bigint"), "links")

    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    classes = (reps.select("digest", F.col("id").alias("copy_id")).join(links, "digest", "left")
               .join(roots, F.col("copy_id") == F.col("node"), "left").select("digest", "copy_id", F.coalesce("root", "copy_id").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    whole = F.col("size") > 0
    return (signs.select("id", "digest", "size").join(classes, "digest", "left")
            .select("id", F.when(whole, F.col("copy_id")).otherwise(F.col("id")).alias("copy_id"), F.when(F.col("id").isNotNull() & whole, F.col("root")).otherwise(F.col("id")).alias("class_id"),
                    F.when(F.col("id").isNotNull() & whole, F.col("links")).otherwise(F.lit(0)).alias("n_links")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay: the smallest id of each group, with all columns of ``docs``; rows without an id stay."""
    groups = jaccard_join(docs, id_col, text_col, **options)
    gone = groups.where("id <> class_id").select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("bigint") == gone["__gone"], "left_anti")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
