"""Byte-level BPE encoding and decoding by corpus-level merge replay.

1. Texts are cut into segments, over the whole corpus; a task passes on each segment that it hasn't met
   before.  With the pattern ``CUTTABLE`` a segment ends before a blank that no other white space
   touches: there the pattern always ends one piece and begins the next.  With other patterns the
   segments are the pattern's pieces.
2. The corpus's distinct segments are dealt into shards by their hash.  A slice of a shard lays out its
   distinct pieces as one sequence of byte tokens with links to the neighbours.  An inverted index maps each
   possible merge (its rank) to the positions of its left part.  Merges are replayed in rank order from
   a heap; a merge touches only the neighbours of its positions, whose new pairs enter the index.  As
   pieces never touch, one replay encodes all of them as if each were encoded alone.  The ids are
   written into the shared folder, behind the sorted hashes of the segments.
3. Texts are cut again, and their segments' ids are looked up and put together.  The ids are decoded
   at once; a text whose segments don't come back byte for byte (two segments with one hash, or a text
   that read otherwise the second time) is encoded by itself.

A shard's segments come sorted and are replayed in slices, so that it may be of any size; workers
memory-map shards, or keep up to ``_kernel.CACHE_BYTES`` of them where the folder can't be mapped.

Defined results
---------------
* A null text counts as empty; an empty text has no tokens.
* Text is encoded as UTF-8; texts that Spark holds are valid Unicode, so that decoding the ids
  gives back the very bytes (of what the pattern matches, if a pattern leaves something out).
* A piece that is a token is that token; else, of equal ranks the leftmost is merged first.  Every
  single byte must have a rank.
* Every row gives one row, also where ids repeat; an empty table gives no rows; other columns
  do not matter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io
from . import _kernel as K
from ._kernel import U64

#: Bytes of text for each shard; shards at most; segments that a task remembers; those that it encodes, and bytes that it replays, at once.
SHARD_BYTES, MOST_SHARDS, SEEN, ENCODED, REPLAY_BYTES = 16 << 20, 4096, 2_000_000, 200_000, 2_000_000
#: Fixed value: the pattern whose pieces never cross a lone blank.
CUTTABLE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
STORED = ("<u8", "<u8", "<u4")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Replay:
    """Encodes sets of distinct pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        #: Rank of the token that two bytes make, or -1.
        self.first = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int64)
        #: By token: its neighbours on the right, on the left -> rank of what both make, or -1; filled as they meet.
        self.right: dict[int, dict[int, int]] = {}
        self.left: dict[int, dict[int, int]] = {}
        self.met = 0

    def look(self, a: int, b: int) -> int:
        return self.ranks.get(self.token[a] + self.token[b], -1)

    @staticmethod
    def wall(ids: list[int], after: list[int], i: int) -> int:
        """Where the piece ends that position ``i`` is in."""
        while ids[i] != -1:
            i = after[i]
        return i

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each piece."""
        if self.met > 200_000:
            self.right, self.left, self.met = {}, {}, 0
        size = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data) + len(pieces)
        # Each piece is followed by a wall, -1, that no pair crosses.
        at = np.arange(len(data)) + np.repeat(np.arange(len(pieces)), size)
        layout = np.full(n, -1, np.int64)
        layout[at] = self.single[data]
        pair = np.full(n, -1, np.int64)
        inner = np.flatnonzero(np.diff(at) == 1)
        pair[at[inner]] = self.first[data[inner], data[inner + 1]]
        # The index: rank of a possible merge -> positions of its left parts, ascending.
        found = np.flatnonzero(pair >= 0)
        found = found[np.argsort(pair[found], kind="stable")]
        ranks, start = np.unique(pair[found], return_index=True)
        places_of, edge = found.tolist(), [*start.tolist(), len(found)]
        index = {r: places_of[edge[k] : edge[k + 1]] for k, r in enumerate(ranks.tolist())}
        heap = list(index)
        ids, now = layout.tolist(), pair.tolist()  # now: rank of the pair that begins at a position
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        look, rights, lefts = self.look, self.right, self.left
        while heap:
            rank = heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            wait = -1  # places up to here wait for a lower rank that came up in their piece
            on_right, on_left = rights.setdefault(rank, {}), lefts.setdefault(rank, {})
            to_right, to_left = on_right.get, on_left.get
            for i in places:
                if now[i] != rank:  # merged otherwise meanwhile
                    continue
                if i < wait:
                    if rank not in index:
                        index[rank] = []
                        heappush(heap, rank)
                    index[rank].append(i)
                    continue
                j = after[i]
                k = after[j]
                ids[i], ids[j], now[j] = rank, -2, -1
                after[i], before[k] = k, i
                c = ids[k]
                if c >= 0:
                    r = to_right(c)
                    if r is None:
                        r = on_right[c] = look(rank, c)
                        self.met += 1
                    now[i] = r
                    if r >= 0:
                        if r < rank:
                            wait = max(wait, self.wall(ids, after, i))
                        if r in index:
                            index[r].append(i)
                        else:
                            index[r] = [i]
                            heappush(heap, r)
                else:
                    now[i] = -1
                h = before[i]
                if h >= 0:
                    c = ids[h]
                    if c >= 0:
                        r = to_left(c)
                        if r is None:
                            r = on_left[c] = look(c, rank)
                            self.met += 1
                        now[h] = r
                        if r >= 0:
                            if r < rank:
                                wait = max(wait, self.wall(ids, after, i))
                            if r in index:
                                index[r].append(h)
                            else:
                                index[r] = [h]
                                heappush(heap, r)
        done = np.array(ids, np.int64)
        bounds = np.concatenate(([0], np.cumsum(done >= 0)[done == -1])) * 4
        packed = done[done >= 0].astype("<u4").tobytes()
        return [packed[s:e] for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


class Codec:
    """Encodes and decodes with the ranks in ``path`` and a pre-tokenising ``pattern``."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.replay = Replay(load_ranks(path))
        self.cuttable, self.pattern = pattern == CUTTABLE, regex.compile(pattern)
        tokens = [self.replay.token.get(i, b"") for i in range(max(self.replay.token) + 1)]
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the segments of texts."""
        if self.cuttable:
            return cut(data, offsets)
        spans = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            text = data[a:b].tobytes().decode()
            place = a + np.concatenate(([0], np.cumsum([len(c.encode()) for c in text]))) if not text.isascii() else np.arange(a, b + 1)
            spans += [(place[m.start()], place[m.end()]) for m in self.pattern.finditer(text) if m.end() > m.start()]
        found = np.array(spans, np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]

    def encode_segments(self, segments: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of distinct segments; their distinct pieces are replayed together."""
        parts = [self.pattern.findall(x.decode()) for x in segments] if self.cuttable else [[x.decode()] for x in segments]
        pieces = list({p for x in parts for p in x})
        known: dict[str, bytes] = {}
        lo = size = 0
        for hi, p in enumerate(pieces):
            size += len(p)
            if size >= REPLAY_BYTES or hi == len(pieces) - 1:
                some = pieces[lo : hi + 1]
                raw = [x.encode() for x in some]
                whole = [self.replay.ranks.get(x) for x in raw]
                open_ = iter(self.replay.encode([x for x, rank in zip(raw, whole, strict=True) if rank is None]))
                known.update((x, next(open_) if rank is None else rank.to_bytes(4, "little")) for x, rank in zip(some, whole, strict=True))
                lo, size = hi + 1, 0
        return [b"".join([known[p] for p in x]) for x in parts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without the corpus's shards."""
        data, offsets = K.text_bytes(pa.array(texts, pa.large_string()))
        starts, ends = self.segments(data, offsets)
        each = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        new = list(set(each))
        known = dict(zip(new, self.encode_segments(new), strict=True))
        edge = np.searchsorted(starts, offsets)
        return [b"".join([known[x] for x in each[a:b]]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]

    def decode_all(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, one token behind the other."""
        return self.bytes[K.spread(self.start[ids], self.size[ids])]

    def decode(self, ids: bytes) -> bytes:
        return self.decode_all(np.frombuffer(ids, "<u4")).tobytes()


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of segments: texts, cut before each blank that stands between two characters which are no white space."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = data <= 0x20  # a white-space (or control) character begins, or ends, at this byte
    ends = begins.copy()
    lead = np.flatnonzero((data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))
    if len(lead):
        a, b, c = data[lead], data[np.minimum(lead + 1, n - 1)], data[np.minimum(lead + 2, n - 1)]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        three = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        three |= (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        begins[lead[two | three]] = True
        ends[lead[two] + 1] = True
        ends[lead[three] + 2] = True
    inside = np.zeros(n, bool)
    inside[1:-1] = (data[1:-1] == 0x20) & ~ends[:-2] & ~begins[2:]
    first = offsets[:-1][np.diff(offsets) > 0]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    inside[last] = False
    inside[first] = True
    starts = np.flatnonzero(inside)
    return starts, np.append(starts[1:], n)


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> Codec:
    return Codec(_locate(path), pattern)


def _locate(path: str) -> str:
    """An absolute path, or the name of a file of the installed public tokenizers."""
    if "/" in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def _distinct(path: str, pattern: str, bits: int):
    """Texts -> segments that the task hasn't passed on yet, with shards and hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, seen = _codec(path, pattern), np.zeros(0, U64)
        for batch in batches:
            for _, _, data, offsets in K.chunks(batch.column(0)):
                starts, ends = codec.segments(data, offsets)
                hashes, at = np.unique(K.hashes(data, starts, ends), return_index=True)
                new = ~np.isin(hashes, seen, assume_unique=True)
                hashes, at = hashes[new], at[new]
                if not len(at):
                    continue
                seen = np.concatenate((seen, hashes)) if len(seen) < SEEN else hashes
                size = ends[at] - starts[at]
                flat = np.ascontiguousarray(data[K.spread(starts[at], size)])
                where = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                segments = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(where), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([pa.array(K.top(hashes, bits), pa.int32()), pa.array(hashes.view(np.int64)), segments], ["shard", "hash", "segment"])

    return run


def _store(path: str, pattern: str, folder: str):
    """Shards, hashes and segments, in order -> the file of each shard: sorted hashes, ends of their ids, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, shard = _codec(path, pattern), -1
        waiting: list[tuple[np.ndarray, pa.Array]] = []  # hashes and segments not encoded yet
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # hashes, numbers of ids, ids

        def encode() -> None:
            if not waiting:
                return
            hashes, at = np.unique(np.concatenate([h for h, _ in waiting]), return_index=True)
            if done and len(hashes) and hashes[0] == done[-1][0][-1]:
                hashes, at = hashes[1:], at[1:]
            ids = codec.encode_segments(pa.concat_arrays([x for _, x in waiting]).take(pa.array(at)).to_pylist())
            if len(hashes):
                done.append((hashes, np.array([len(x) // 4 for x in ids]), np.frombuffer(b"".join(ids), "<u4")))
            waiting.clear()

        def close() -> pa.RecordBatch:
            encode()
            hashes, size, ids = map(np.concatenate, zip(*done, strict=True))
            K.write_arrays(folder, f"segments-{shard}", [hashes, np.cumsum(size).astype("<u8"), ids])
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(hashes)], pa.int64())], ["shard", "segments"])

        for batch in batches:
            shards = batch.column(0).to_numpy()
            edge = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if a == b:
                    continue
                if shards[a] != shard and (waiting or done):
                    yield close()
                shard = int(shards[a])
                waiting.append((batch.column(1).slice(a, b - a).to_numpy().view(U64), batch.column(2).slice(a, b - a)))
            if sum(len(h) for h, _ in waiting) >= ENCODED:
                encode()
        if waiting or done:
            yield close()

    return run


def _looked_up(folder: str, bits: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of ids of sorted distinct hashes (none where a hash is missing), and all ids."""
    size, parts = np.zeros(len(hashes), np.int64), []
    for shard, a, b in K.by_shard(hashes, bits):
        arrays = K.mapped_arrays(folder, f"segments-{shard}", STORED)
        if arrays is None:
            continue
        stored, ends, ids = arrays
        at = np.minimum(np.searchsorted(stored, hashes[a:b]), len(stored) - 1)
        here = stored[at] == hashes[a:b]
        at = at[here]
        end = ends[at].astype(np.int64)
        start = np.where(at > 0, ends[at - 1].astype(np.int64), 0)
        size[a:b][here] = end - start
        parts.append(ids[K.spread(start, end - start)])
    return size, np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _run(path: str, pattern: str, folder: str, bits: int, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            for lo, hi, data, offsets in K.chunks(batch.column(1)):
                starts, ends = codec.segments(data, offsets)
                hashes, back = np.unique(K.hashes(data, starts, ends), return_inverse=True)
                size, flat = _looked_up(folder, bits, hashes)
                ids = flat[K.spread((np.cumsum(size) - size)[back], size[back])].astype("<u4")
                edge = np.searchsorted(starts, offsets)
                bound = np.concatenate(([0], np.cumsum(size[back])))[edge]
                want, decoded = data[K.spread(starts, ends - starts)], codec.decode_all(ids)
                parts, raw = [ids[a:b] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)], []
                if len(want) == len(decoded) and np.array_equal(want, decoded):
                    cuts = np.concatenate(([0], np.cumsum(ends - starts)))[edge].tolist()
                    raw = [decoded[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                else:
                    for d in range(hi - lo):
                        whole = b"".join(data[a:b].tobytes() for a, b in zip(starts[edge[d] : edge[d + 1]].tolist(), ends[edge[d] : edge[d + 1]].tolist(), strict=True))
                        if codec.decode_all(parts[d]).tobytes() != whole:
                            parts[d] = np.frombuffer(codec.encode([data[offsets[d] : offsets[d + 1]].tobytes().decode()])[0], "<u4")
                        raw.append(codec.decode_all(parts[d]).tobytes())
                keys, n = batch.column(0).slice(lo, hi - lo), pa.array([len(x) for x in parts], pa.int64())
                if digests:
                    yield pa.RecordBatch.from_arrays(
                        [keys, n, pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    where = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in parts]))), pa.int32())
                    yield pa.RecordBatch.from_arrays([keys, n, pa.ListArray.from_arrays(where, pa.array(np.concatenate([*parts, np.zeros(0, "<u4")]).astype(np.int32))), pa.array(raw, pa.binary())], ["id", "n_tokens", "ids", "decoded"])

    return run


def _encoded(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    spark = docs.sparkSession
    _io.bounded_batches(spark)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(min(MOST_SHARDS, max(16, size // SHARD_BYTES)) - 1).bit_length()
    folder = _io.qualified(spark, _io.scratch(spark, "bpe"))
    found = docs.select("text").mapInArrow(K.giving_back(_distinct(path, pattern, bits)), "shard int, hash bigint, segment binary")
    dealt = found.repartition(1 << bits, "shard").sortWithinPartitions("shard", "hash")
    dealt.mapInArrow(K.giving_back(_store(path, pattern, folder), _codec), "shard int, segments bigint").agg(F.sum("segments")).collect()
    schema = f"id {docs.schema['id'].dataType.simpleString()}, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary")
    return docs.mapInArrow(K.giving_back(_run(path, pattern, folder, bits, digests)), schema)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids (array of int), decoded (binary: the ids decoded again)."""
    return _encoded(docs, path, pattern, id_col, text_col, False)


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like encode(), with digests of ids and decoded bytes in place of both, made where the texts are."""
    return _encoded(docs, path, pattern, id_col, text_col, True)


def production(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return encode_digests(docs, "byte_bpe_multi_50k.tiktoken", public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return production(spark.read.parquet(f"{sf_dir}/documents.parquet"))
