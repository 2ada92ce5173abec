"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item is cut into windows of ``width`` consecutive words (a shorter item is one
window).  A window occurs in a document only if all its words do, so one word of it is a
necessary prefix; words are ordered by rarity over *all* documents, and the rarest word of a
window, with its position, is its prefix token.

The benchmark becomes an index in the shared folder, built by tasks and dealt into shards of sorted
arrays that workers memory-map; the driver and the documents' tasks hold none of it, whatever its size:

1. its distinct words;
2. how often each occurs in the documents, counted in one pass over them;
3. its windows with their prefix tokens: by token, the distinct (position, length) of windows that it is
   the prefix of, at most width x (width + 1) / 2 however many windows share a token; and the windows by hash.

A second pass over the documents joins their words with the prefix tokens.  A match must fit the
document's bounds (length and position), then the hash of the item-sized window must be that of a
window, and at last its bytes must agree.

Defined results
---------------
* Words are maximal runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z.
* A null or empty text has no words; an item without words has no windows and never occurs.
* A word inside several windows is hit once; items that repeat a text are each counted.
* Items that share an id are one item in ``n_items``; a null item id is named "".
* Every row of ``docs`` gives one row, also where ids repeat; empty tables give no rows, and an
  empty benchmark leaves all documents clean.
* Other columns, whatever their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io
from . import _kernel as K
from ._kernel import U64

WIDTH, SHARD_WORDS = 10, 1_000_000
_PRIME = U64(0x9FB21C651E98DF25)
#: Sorted words; with their counts; sorted tokens with the ends of their places and sizes; sorted windows with the ends of their texts and item ids.
WORDS, COUNTS, PREFIXES, WINDOWS = ("<u8",), ("<u8", "<u8"), ("<u8", "<u4", "|u1", "|u1"), ("<u8", "<u8", "|u1", "<u8", "|u1")


def _window_hashes(hashes: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of the ``size`` words from each position ``at``; all must lie inside."""
    out = size.astype(U64)
    for k in range(int(size.max()) if len(size) else 0):
        inside = k < size
        out = np.where(inside, out * _PRIME + hashes[np.where(inside, at + k, 0)], out)
    return K.mix(out)


def _found(stored: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted values stand in a sorted array, and which of them do."""
    at = np.minimum(np.searchsorted(stored, wanted), max(len(stored) - 1, 0))
    return at, (stored[at] == wanted) if len(stored) else np.zeros(len(wanted), bool)


# ---- building the index ------------------------------------------------------------------------

def _vocabulary(bits: int):
    """Texts of items -> the distinct words of a batch, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in K.chunks(batch.column(0)):
                words = np.unique(K.tokens(data, offsets, K.WORD)[4])
                yield _sharded(words, bits, ["word"], [pa.array(words.view(np.int64))])

    return run


def _sharded(key: np.ndarray, bits: int, names: list[str], columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(K.top(key, bits), pa.int32()), *columns], ["shard", *names])


def _done(table: pa.Table) -> pa.Table:
    return pa.table({"n": pa.array([table.num_rows], pa.int64())})


def _words_of(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy().view(U64)


def _store_words(folder: str):
    def run(table: pa.Table) -> pa.Table:
        K.write_arrays(folder, f"words-{table.column('shard')[0].as_py()}", [np.unique(_words_of(table, "word"))])
        return _done(table)

    return run


def _count(folder: str, bits: int):
    """Texts -> occurrences of each word of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, U64), np.zeros(0, np.int64)
        for batch in batches:
            for _, _, data, offsets in K.chunks(batch.column(0)):
                own, n = np.unique(K.tokens(data, offsets, K.WORD)[4], return_counts=True)
                known = np.zeros(len(own), bool)
                for shard, a, b in K.by_shard(own, bits):
                    if (arrays := K.mapped_arrays(folder, f"words-{shard}", WORDS)) is not None:
                        known[a:b] = _found(arrays[0], own[a:b])[1]
                words, back = np.unique(np.concatenate((words, own[known])), return_inverse=True)
                counts = np.bincount(back, np.concatenate((counts, n[known])), len(words)).astype(np.int64)
                if len(words) > SHARD_WORDS:
                    yield _sharded(words, bits, ["word", "n"], [pa.array(words.view(np.int64)), pa.array(counts)])
                    words, counts = words[:0], counts[:0]
        yield _sharded(words, bits, ["word", "n"], [pa.array(words.view(np.int64)), pa.array(counts)])

    return run


def _store_counts(folder: str):
    def run(table: pa.Table) -> pa.Table:
        words = _words_of(table, "word")
        by = np.argsort(words)
        K.write_arrays(folder, f"counts-{table.column('shard')[0].as_py()}", [words[by], table.column("n").to_numpy()[by].astype("<u8")])
        return _done(table)

    return run


def _windows(folder: str, bits: int, width: int):
    """Items -> their windows: hash, prefix token with its place, length, the words with a blank between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in K.chunks(batch.column(1)):
                low, starts, ends, item, hashes = K.tokens(data, offsets, K.WORD)
                own, back = np.unique(hashes, return_inverse=True)
                seen = np.zeros(len(own), np.int64)
                for shard, a, b in K.by_shard(own, bits):
                    if (arrays := K.mapped_arrays(folder, f"counts-{shard}", COUNTS)) is not None:
                        at, here = _found(arrays[0], own[a:b])
                        seen[a:b] = np.where(here, arrays[1][at] if len(arrays[1]) else 0, 0)
                seen = seen[back]
                per = np.bincount(item, minlength=hi - lo)
                first = np.cumsum(per) - per
                many = np.where(per >= width, per - width + 1, np.minimum(per, 1))
                at = K.spread(first, many)
                size = np.repeat(np.minimum(per, width), many)
                place, least = np.zeros(len(at), np.int64), np.full(len(at), np.iinfo(np.int64).max)
                for k in range(int(size.max()) if len(size) else 0):  # the rarest word, the first of equals
                    rarer = (k < size) & (seen[at + np.minimum(k, size - 1)] < least)
                    place, least = np.where(rarer, k, place), np.where(rarer, seen[at + np.minimum(k, size - 1)], least)
                whole, token = _window_hashes(hashes, at, size), hashes[at + place]
                texts = [b" ".join([low[starts[w] : ends[w]].tobytes() for w in range(a, a + n)]) for a, n in zip(at.tolist(), size.tolist(), strict=True)]
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(hi - lo), many)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(K.top(token, bits), pa.int32()), pa.array(token.view(np.int64)), pa.array(place, pa.int32()), pa.array(size, pa.int32()), pa.array(K.top(whole, bits), pa.int32()), pa.array(whole.view(np.int64)), pa.array(texts, pa.binary()), ids],
                    ["token_shard", "token", "place", "size", "shard", "whole", "words", "item"])

    return run


def _store_prefixes(folder: str):
    def run(table: pa.Table) -> pa.Table:
        token, place, size = _words_of(table, "token"), table.column("place").to_numpy(), table.column("size").to_numpy()
        by = np.lexsort((size, place, token))
        token, place, size = token[by], place[by], size[by]
        tokens, first = np.unique(token, return_index=True)
        K.write_arrays(folder, f"prefixes-{table.column('token_shard')[0].as_py()}", [tokens, np.append(first[1:], len(token)).astype("<u4"), place.astype("|u1"), size.astype("|u1")])
        return _done(table)

    return run


def _store_windows(folder: str):
    def run(table: pa.Table) -> pa.Table:
        whole = _words_of(table, "whole")
        by = np.argsort(whole, kind="stable")
        words, items = (table.column(c).combine_chunks().take(pa.array(by)).to_pylist() for c in ("words", "item"))
        items = [i.encode() for i in items]
        arrays = [whole[by]]
        for parts in (words, items):
            arrays += [np.cumsum([len(x) for x in parts]).astype("<u8"), np.frombuffer(b"".join(parts), np.uint8)]
        K.write_arrays(folder, f"windows-{table.column('shard')[0].as_py()}", arrays)
        return _done(table)

    return run


@dataclass(frozen=True)
class Index:
    """The windows of a benchmark, in files below ``folder``."""

    folder: str
    bits: int

    def prefixes(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, place, size) of all windows that a word may be the prefix token of."""
        own, back = np.unique(hashes, return_inverse=True)
        many, places, sizes = np.zeros(len(own), np.int64), [], []
        for shard, a, b in K.by_shard(own, self.bits):
            arrays = K.mapped_arrays(self.folder, f"prefixes-{shard}", PREFIXES)
            if arrays is None:
                continue
            tokens, ends, place, size = arrays
            at, here = _found(tokens, own[a:b])
            at = at[here]
            end = ends[at].astype(np.int64)
            start = np.where(at > 0, ends[at - 1].astype(np.int64), 0)
            many[a:b][here] = end - start
            which = K.spread(start, end - start)
            places.append(place[which])
            sizes.append(size[which])
        if not places:
            return (np.zeros(0, np.int64),) * 3
        per = many[back]
        which = K.spread((np.cumsum(many) - many)[back], per)
        return np.repeat(np.arange(len(hashes)), per), np.concatenate(places)[which].astype(np.int64), np.concatenate(sizes)[which].astype(np.int64)

    def match(self, low, starts, ends, doc, hashes, bounds) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Start, length and item of all occurrences of windows.  ``bounds``: of each document's words."""
        word, place, size = self.prefixes(hashes)
        at = word - place
        fits = (at >= bounds[doc[word]]) & (at + size <= bounds[doc[word] + 1])
        at, size = at[fits], size[fits]
        whole = _window_hashes(hashes, at, size)
        by = np.argsort(whole, kind="stable")
        at, size, whole = at[by], size[by], whole[by]
        out: tuple[list, list, list] = ([], [], [])
        for shard, a, b in K.by_shard(whole, self.bits):
            arrays = K.mapped_arrays(self.folder, f"windows-{shard}", WINDOWS)
            if arrays is None:
                continue
            stored, text_end, text, item_end, item = arrays
            left, right = np.searchsorted(stored, whole[a:b]), np.searchsorted(stored, whole[a:b], side="right")
            for k in np.flatnonzero(left < right).tolist():
                s, n = int(at[a + k]), int(size[a + k])
                own = b" ".join([low[starts[w] : ends[w]].tobytes() for w in range(s, s + n)])
                for w in range(int(left[k]), int(right[k])):  # the items that hold this window
                    if text[text_end[w - 1] if w else 0 : text_end[w]].tobytes() == own:
                        out[0].append(s)
                        out[1].append(n)
                        out[2].append(item[item_end[w - 1] if w else 0 : item_end[w]].tobytes().decode())
        return np.array(out[0], np.int64), np.array(out[1], np.int64), out[2]


def build(texts: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH) -> Index:
    """The index of a benchmark, with prefix tokens by how often words occur in all of ``texts`` (one column)."""
    if not 0 < width < 256:
        raise ValueError("width must be from 1 to 255")
    spark = texts.sparkSession
    _io.bounded_batches(spark)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(size // 6 // SHARD_WORDS).bit_length()
    folder = _io.qualified(spark, _io.scratch(spark, "benchmark"))
    run = lambda df, by, store: df.groupBy(by).applyInArrow(store(folder), "n bigint").agg(F.sum("n")).collect()
    run(items.select("text").mapInArrow(_vocabulary(bits), "shard int, word bigint").distinct(), "shard", _store_words)
    run(texts.mapInArrow(K.giving_back(_count(folder, bits)), "shard int, word bigint, n bigint").groupBy("shard", "word").agg(F.sum("n").alias("n")), "shard", _store_counts)
    windows = _io.materialise(items.mapInArrow(_windows(folder, bits, width), "token_shard int, token bigint, place int, size int, shard int, whole bigint, words binary, item string"), "windows")
    run(windows.select("token_shard", "token", "place", "size").distinct(), "token_shard", _store_prefixes)
    run(windows.select("shard", "whole", "words", "item").distinct(), "shard", _store_windows)
    return Index(folder, bits)


# ---- marking documents -------------------------------------------------------------------------

def _mark(index: Index):
    """id, text -> the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in K.chunks(batch.column(1)):
                low, starts, ends, doc, hashes = K.tokens(data, offsets, K.WORD)
                bounds = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=hi - lo))))
                at, size, found = index.match(low, starts, ends, doc, hashes, bounds)
                # A word is hit where more windows have begun than ended.
                change = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + size, -1)
                n_hit = np.bincount(doc[np.cumsum(change[:-1]) > 0], minlength=hi - lo)
                items: list[set[str]] = [set() for _ in range(hi - lo)]
                for d, i in zip(doc[at].tolist(), found, strict=True):
                    items[d].add(i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(n_hit > 0)],
                    ["id", "n_words", "n_hit", "n_items", "items", "contaminated"])

    return run


def _clean(index: Index, column: int):
    """Whole rows in, those of texts without a window out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for lo, hi, data, offsets in K.chunks(batch.column(column)):
                low, starts, ends, doc, hashes = K.tokens(data, offsets, K.WORD)
                bounds = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=hi - lo))))
                keep[lo + doc[index.match(low, starts, ends, doc, hashes, bounds)[0]]] = False
            yield batch.filter(pa.array(keep))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id, n_words, n_hit, n_items, items (sorted), contaminated: one row for each document."""
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    index = build(out.select("text"), benchmark, item_col, item_text_col, width)
    return out.mapInArrow(K.giving_back(_mark(index)), f"id {out.schema['id'].dataType.simpleString()}, n_words bigint, n_hit bigint, n_items bigint, items array<string>, contaminated boolean")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The clean rows of ``docs`` with all their columns; each row by its own text, without a shuffle."""
    index = build(docs.select(F.col(text_col).cast("string").alias("text")), benchmark, **options)
    return docs.mapInArrow(K.giving_back(_clean(index, docs.columns.index(text_col))), docs.schema)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, items).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")
