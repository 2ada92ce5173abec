"""Language-model scores from an interpolated modified Kneser-Ney n-gram model.

Counting runs in Spark.  Words come first: each is hashed to 64 bits and counted, and gets a number, the
smaller the more often it occurs (by powers of two of its count, so that no global sort is needed).
Then tasks reduce their n-grams of the highest order, as columns of word numbers, to distinct ones with
counts; sorted, with small numbers for frequent words, these compress to a few bytes.  They are dealt by
a hash of their context into shards whose number follows the size of the corpus.  A context that may be
frequent (its rarest word's count bounds it) is dealt over several shards by its last word too, so that
no shard holds a hot context whole; what the parts know of it is summed in one small row a part.  A shard
sums its n-grams, writes them as sorted hash arrays into the model's folder (shared by all executors),
and passes on the continuation counts of the next lower order, down to words.  All orders are one job:
what a lost executor held is counted again.

Workers memory-map the arrays; where the folder is in a store that can't be mapped, they read a shard
whole and keep as many as ``_kernel.CACHE_BYTES`` allow.

Probabilities: of the highest order from counts, of lower orders from continuation counts; at each
order discounted by D1, D2, D3+ from the counts of counts, and interpolated with the next lower;
words at last with 1 / (V + 1).

Defined results
---------------
* Tokens: maximal runs of other characters than blanks (space, tab to carriage return) after
  lower-casing A-Z, then one end token for each text.  A null text counts as empty: an end alone.
* Contexts before the first token are filled with a begin mark, which is never predicted.
* An unknown token has the probability that the unigram level leaves for it; an unknown context
  falls back to the next shorter one.
* Words are told apart by 64 bits of a hash.  An n-gram that wasn't seen passes for one that was with a
  chance of about 2 in 10^9, whatever the corpus's size: of a shard's sorted hashes a directory holds
  the leading bits, and 32 bits more are stored, which a wanted one must equal.
* Without training texts the model gives each token probability 1 (its vocabulary is the unknown
  token alone), and the base score's N and V are 0.
* A row whose id is null is learnt from.  Every row gives one row, also where ids repeat (a
  repeated row is counted each time); an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io
from . import _kernel as K
from ._kernel import U64

ORDER = 3
#: n-grams that a shard gets on average, tokens that a task counts at once, and those that it scores at once.
SHARD_NGRAMS, TASK_TOKENS, SCORE_TOKENS = 1_400_000, 1_400_000, 700_000
END = U64(0x5851F42D4C957F2D)
_C = U64(0x9E3779B97F4A7C15)
SCHEMA = "kind int, shard int, block binary, stats array<bigint>"
#: Kinds of rows: n-grams have their order, totals of contexts dealt over several shards HOT more, statistics the order with a minus.
HOT = 100
BUCKETS = 48


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 7 == 2


# ---- tokens ------------------------------------------------------------------------------------

def token_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes of tokens with ends, bounds) for runs of rows."""
    for lo, hi, data, offsets in K.chunks(column):
        _, _, _, doc, hashes = K.tokens(data, offsets, K.NONBLANK)
        per = np.bincount(doc, minlength=hi - lo)
        bounds = np.concatenate(([0], np.cumsum(per + 1)))
        out = np.full(bounds[-1], END, U64)
        out[np.arange(len(hashes)) + doc] = hashes
        yield lo, hi, out, bounds


def before(ids: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """The number of the k-th word before each token; 0, the begin mark, before a text."""
    if not k:
        return ids
    out = np.zeros(len(ids), np.int64)
    out[k:] = ids[:-k]
    for j in range(k):
        at = bounds[:-1] + j
        out[at[at < bounds[1:]]] = 0
    return out


def fold(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams, word by word."""
    out = K.mix(columns[0].astype(U64) + U64(1))
    for c in columns[1:]:
        out = K.mix(out * _C + c.astype(U64) + U64(1))
    return out


def _runs(ordered: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(ordered[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(ordered[0]), bool)
    new[0] = True
    for c in ordered:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _ranks(values: np.ndarray) -> np.ndarray:
    """The place of each value among the distinct ones."""
    by = np.argsort(values)
    ordered = values[by]
    out = np.empty(len(by), U64)
    out[by] = np.cumsum(np.concatenate(([False], ordered[1:] != ordered[:-1])))
    return out


def _in_order(columns: list[np.ndarray]) -> np.ndarray:
    """Where rows stand in lexicographic order; columns are packed into one 64-bit key, as ranks where they don't fit (sorting single keys is fast)."""
    key = columns[0].astype(U64)
    room = 64 - int(key.max(initial=0)).bit_length()
    for c in columns[1:]:
        bits = int(c.max(initial=0)).bit_length()
        if bits > room:
            key = _ranks(key)
            room = 64 - int(key.max(initial=0)).bit_length()
        if bits > room:
            c = _ranks(c)
            bits = int(c.max(initial=0)).bit_length()
        key = key << U64(bits) | c.astype(U64)
        room -= bits
    return np.argsort(key)


def summed(columns: list[np.ndarray], count: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order, with the sums of their counts."""
    by = _in_order(columns) if len(count) else np.zeros(0, np.int64)
    columns = [c[by] for c in columns]
    at = _runs(columns)
    return [c[at] for c in columns], np.add.reduceat(count[by], at) if len(at) else count


def counted(columns: list[np.ndarray], bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order, with how often they occur; no value has more than ``bits`` bits."""
    if bits * len(columns) > 64:
        return summed(columns, np.ones(len(columns[0]), np.int64))
    key = columns[0].astype(U64)
    for c in columns[1:]:
        key = key << U64(bits) | c.astype(U64)
    key.sort()
    at = _runs([key])
    n, key = np.diff(at, append=len(key)), key[at]
    return [(key >> U64(bits * k) & U64((1 << bits) - 1)).astype(np.int64) for k in range(len(columns) - 1, -1, -1)], n


# ---- blocks that are shuffled ------------------------------------------------------------------

def pack(columns: list[np.ndarray], count: np.ndarray) -> bytes:
    """Rows that are sorted by the first column: its differences, the others, and the counts, byte by byte (as many as the largest has) and compressed."""
    import zstandard

    columns = [c.astype("<u8") for c in (np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:], count)]
    size = [(int(c.max(initial=0)).bit_length() + 7) // 8 for c in columns]
    parts = [np.array([len(count)], "<i8").tobytes(), bytes(size)]
    parts += [np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes() for c, n in zip(columns, size, strict=True)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(block: bytes, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    n, at = int(raw[:8].view("<i8")[0]), 9 + width
    out = []
    for size in raw[8:at].tolist():
        wide = np.zeros((n, 8), np.uint8)
        for k in range(size):
            wide[:, k] = raw[at : at + n]
            at += n
        out.append(wide.view("<u8").reshape(-1))
    out[0] = np.cumsum(out[0], dtype=U64)
    return out[:-1], out[-1].astype(np.int64)


def _deal(kind: int, shard: np.ndarray, columns: list[np.ndarray], count: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Blocks of rows by shard; within a shard they keep their order."""
    by = np.argsort(shard.astype(np.uint16) if shard.max(initial=0) < 1 << 16 else shard, kind="stable")  # 16 bits are sorted by radix
    shard, columns, count = shard[by], [c[by] for c in columns], count[by]
    edge = np.append(_runs([shard]), len(shard))
    return [(kind, int(shard[a]), pack([c[a:b] for c in columns], count[a:b])) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def _rows(parts: list[tuple[int, int, bytes]], stats: list[list[int]] | None = None) -> pa.RecordBatch:
    kinds, shards, blocks = zip(*parts, strict=True) if parts else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(shards, pa.int32()), pa.array(blocks, pa.binary()), pa.array(stats or [[]] * len(parts), pa.list_(pa.int64()))], ["kind", "shard", "block", "stats"])


def _table(parts: list[tuple[int, int, bytes]], stats: list[list[int]] | None = None) -> pa.Table:
    return pa.Table.from_batches([_rows(parts, stats)])


def _blocks(table: pa.Table, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The rows of a shard's blocks, summed."""
    parts = [unpack(b.as_py(), width) for b in table.column("block")]
    return summed([np.concatenate(c) for c in zip(*(p[0] for p in parts), strict=True)], np.concatenate([p[1] for p in parts]))


def _collected(batches: Iterator[pa.RecordBatch], flush, most: int = TASK_TOKENS) -> Iterator[pa.RecordBatch]:
    """``flush`` of the tokens of about ``most`` at a time, and their numbers in each text."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        for _, _, tokens, bounds in token_hashes(batch.column(0)):
            held.append((tokens, np.diff(bounds)))
            size += len(tokens)
            if size >= most:
                yield flush(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield flush(*map(np.concatenate, zip(*held, strict=True)))


# ---- the model's files -------------------------------------------------------------------------

#: Sorted hashes of words with their places in the shard; by place: counts, MANY for the few that 32 bits don't hold; these.  By place: continuation counts, likewise.
WORD, CONTINUED, MANY = ("<u8", "<u4", "<u4", "<u8"), ("<u4", "<u8"), 2**32 - 1
#: Directory by leading bits; the next 32 bits and codes; the values of codes, column by column; where a code isn't enough: places, and their values.
CODED = ("<u4", "<u4", "|u1", "<u8", "<u4", "<u8")
#: Sorted hashes of contexts that are dealt over several shards, and their four values, column by column.
HOT_CONTEXT = ("<u8", "<u8")


def _narrow(count: np.ndarray) -> list[np.ndarray]:
    return [np.minimum(count, MANY).astype("<u4"), count[count >= MANY].astype("<u8")]


def _wide(narrow: np.ndarray, rest: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = narrow[at].astype(np.int64)
    if len(rest):
        places = np.flatnonzero(narrow == MANY)
        many = np.flatnonzero(out == MANY)
        out[many] = rest[np.searchsorted(places, at[many])]
    return out


def _key(hashes: np.ndarray) -> np.ndarray:
    """What n-grams and contexts are sorted by: independent of what they are dealt by."""
    return K.mix(hashes + U64(0x51ED270B27E5A3C1))


def _coded(key: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """Rows by 64-bit keys: sorted, their values as codes for the 255 most frequent rows of values."""
    by = np.argsort(key)
    key, values = key[by], [v[by].astype(np.int64) for v in values]
    lead = max(0, len(key).bit_length() - 3)  # four to eight keys share their leading bits
    directory = np.searchsorted(K.top(key, lead), np.arange((1 << lead) + 1))
    order = _in_order(values) if len(key) else by
    at = _runs([v[order] for v in values])
    size = np.diff(np.append(at, len(order)))
    common = np.argsort(-size, kind="stable")[:255]
    code_of_run = np.full(len(at), 255, np.uint8)
    code_of_run[common] = np.arange(len(common))
    code = np.empty(len(key), np.uint8)
    code[order] = np.repeat(code_of_run, size)
    rest = np.flatnonzero(code == 255)
    table = np.concatenate([v[order[at[common]]] for v in values])
    return [directory.astype("<u4"), (key >> U64(32 - lead)).astype("<u4"), code, table.astype("<u8"), rest.astype("<u4"), np.concatenate([v[rest] for v in values]).astype("<u8")]


def _found(arrays: list[np.ndarray], key: np.ndarray, width: int) -> list[np.ndarray]:
    """Values of keys, 0 where there are none."""
    directory, stored, code, table, rest, more = arrays
    out = [np.zeros(len(key), np.int64) for _ in range(width)]
    if not len(stored):
        return out
    lead = (len(directory) - 1).bit_length() - 1
    first, want = K.top(key, lead), (key >> U64(32 - lead)).astype(np.uint32)
    at, end = directory[first].astype(np.int64), directory[first + 1].astype(np.int64)
    half = 1 << int((end - at).max(initial=0)).bit_length() >> 1
    while half:  # bisection of all keys' runs at once: how many stored ones are less
        step = at + half
        less = step <= end
        less &= stored[np.minimum(step, end, out=step) - 1] < want
        at += half * less
        half >>= 1
    hit = np.flatnonzero((at < end) & (stored[np.minimum(at, len(stored) - 1)] == want))
    at = at[hit]
    c = code[at]
    spare = np.flatnonzero(c == 255)
    place = np.searchsorted(rest, at[spare])
    c[spare] = 0
    for k in range(width):
        value = table[k * (len(table) // width) :][c]
        value[spare] = more[place + k * len(rest)]
        out[k][hit] = value
    return out


# ---- counting ----------------------------------------------------------------------------------

def _count_words(bits: int):
    """Texts -> the distinct words of some tokens, with counts."""

    def flush(tokens: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        words, n = np.unique(tokens, return_counts=True)
        return _rows(_deal(1, K.top(words, bits), [words], n))

    return lambda batches: _collected(batches, flush, 4 * TASK_TOKENS)


def _store_words(folder: str):
    """The blocks of a shard of words -> its file, and the number of words by power of two of their counts."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        (words,), count = _blocks(table, 1)
        power = np.log2(count).astype(np.int64)
        by = np.argsort(-power, kind="stable")
        place = np.empty(len(words), np.int64)
        place[by] = np.arange(len(words))
        K.write_arrays(folder, f"words-{shard}", [words, place.astype("<u4"), *_narrow(count[by])])
        return _table([(-1, shard, b"")], [[int(count.sum()), *np.bincount(BUCKETS - 1 - power, minlength=BUCKETS).tolist()]])

    return run


def _count(model: Broadcast):
    """Texts -> the distinct n-grams of the highest order of the task, with counts."""

    def flush(tokens: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        lm: Model = model.value
        ids, _, _, back = lm.words(tokens)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        by = np.argsort(ids)
        place = np.empty(len(ids), np.int64)
        place[by] = np.arange(1, len(ids) + 1)
        own = place[back]  # the batch's words by number, so that n-grams are sorted as single keys
        columns, n = counted([before(own, bounds, k) for k in range(lm.order - 1, -1, -1)], len(ids).bit_length())
        number = np.concatenate(([0], ids[by]))
        columns = [number[c] for c in columns]
        return _rows(_deal(lm.order, lm.shard(columns)[0], columns, n))

    return lambda batches: _collected(batches, flush)


def _counts_of_counts(count: np.ndarray) -> list[int]:
    """How many are 1, 2, 3, 4."""
    return [int((count == k).sum()) for k in (1, 2, 3, 4)]


def _reduce(model: Broadcast, order: int):
    """The blocks of a shard of n-grams of an order -> its file, and blocks of the next lower one.  Other rows pass, or are stored."""

    def run(table: pa.Table) -> pa.Table:
        lm: Model = model.value
        kind, shard = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
        if kind < 0:
            return table
        if kind > HOT:
            return lm.store_hot(kind - HOT, shard, table)
        if kind == 1:
            return lm.store_continued(shard, table)
        columns, count = _blocks(table, order)
        _, pieces = lm.shard(columns)
        first = _runs(columns[:-1])
        context = [c[first] for c in columns[:-1]]
        values = [np.add.reduceat(x.astype(np.int64), first) for x in (count, count == 1, count == 2, count >= 3)]
        alone = pieces[first] == 1
        K.write_arrays(lm.folder, f"{order}-{shard}", [*_coded(_key(fold(columns)), [count]), *_coded(_key(fold([c[alone] for c in context])), [v[alone] for v in values])])
        hot = ~alone
        parts = []
        if hot.any():  # one row for each of the four values
            c, home = [x[hot] for x in context], K.top(fold([x[hot] for x in context]), lm.bits)
            which = [np.full(int(hot.sum()), k) for k in range(4)]
            parts += _deal(HOT + order, np.tile(home, 4), [np.tile(fold(c), 4), np.concatenate(which)], np.concatenate([v[hot] for v in values]))
        # Continuations: each distinct n-gram adds one to its tail.
        tails, n = summed(columns[1:], np.ones(len(count), np.int64))
        parts += _deal(order - 1, lm.shard(tails)[0] if order > 2 else lm.home(tails[0])[0], tails, n)
        return _table([*parts, (-order, shard, b"")], [[]] * len(parts) + [_counts_of_counts(count)])

    return run


# ---- the model ---------------------------------------------------------------------------------

def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams that occur 1, 2, 3 and 4 times."""
    if min(n) <= 0:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.05), k + 1 - 0.05) for k in range(3)]


@dataclass
class Model:
    folder: str
    order: int
    bits: int
    #: Occurrences from which a context is dealt over several shards.
    many: int
    texts: int = 0
    train_tokens: int = 0
    #: Words by power of two of their counts (from the largest down) and shard.
    sizes: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 1), np.int64))
    continuations: int = 0
    leave: list[int] = field(default_factory=lambda: [0, 0, 0])
    discount: dict[int, list[float]] = field(default_factory=dict)

    @property
    def vocabulary(self) -> int:
        return int(self.sizes.sum())

    def _starts(self) -> tuple[np.ndarray, np.ndarray]:
        """First numbers by power and shard, and first places within the shard.  Number 0 is the begin mark."""
        return (np.cumsum(self.sizes.reshape(-1)) - self.sizes.reshape(-1) + 1).reshape(self.sizes.shape), np.cumsum(self.sizes, axis=0) - self.sizes

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number (-1: unknown), count and continuation count of each distinct word, and where among them each word is."""
        keys, back = np.unique(hashes, return_inverse=True)
        ids, count, cont = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        start, place = self._starts()
        for s, a, b in K.by_shard(keys, self.bits):
            arrays = K.mapped_arrays(self.folder, f"words-{s}", WORD)
            if arrays is None:
                continue
            stored, places, counts, large = arrays
            at = np.minimum(np.searchsorted(stored, keys[a:b]), len(stored) - 1)
            here = np.flatnonzero(stored[at] == keys[a:b])
            local = places[at[here]].astype(np.int64)
            power = np.searchsorted(place[:, s], local, side="right") - 1
            ids[a + here] = start[power, s] + local - place[power, s]
            count[a + here] = _wide(counts, large, local)
            if self.continuations:
                cont[a + here] = _wide(*K.mapped_arrays(self.folder, f"continued-{s}", CONTINUED), local)
        return ids, count, cont, back

    def home(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard and place of numbered words."""
        start, place = self._starts()
        cell = np.searchsorted(start.reshape(-1), ids.astype(np.int64), side="right") - 1
        power, shard = np.divmod(cell, self.sizes.shape[1])
        return shard, ids.astype(np.int64) - start[power, shard] + place[power, shard]

    def shard(self, columns: list[np.ndarray], h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Shard of each n-gram, and over how many parts its context is dealt: its rarest word's count says how often it occurs at most.  ``h``: the contexts' hashes."""
        context = columns[:-1]
        h = fold(context) if h is None else h
        out, pieces = K.top(h, self.bits), np.ones(len(h), np.int64)
        ends = np.cumsum(self.sizes.sum(axis=1))
        rarest = np.maximum.reduce(context) if len(context) > 1 else context[0]
        # Only contexts of words that occur often enough are looked at closer; the begin mark's 0 is one of them.
        at = np.flatnonzero(rarest <= ends[max(0, BUCKETS - int(self.many).bit_length())])
        context, rarest = [c[at] for c in context], rarest[at].astype(np.int64)
        power = BUCKETS - 1 - np.searchsorted(ends, np.maximum(rarest, 1), side="left")
        most = np.where(rarest == 0, self.texts, 2.0 ** (power + 1))
        if len(context) > 1:
            most = np.where((np.min(context, axis=0) == 0), np.minimum(most, self.texts), most)
        pieces[at] = 2 ** np.ceil(np.log2(np.maximum(most / self.many, 1)))
        at = at[pieces[at] > 1]
        out[at] = K.top(K.mix(h[at] + U64(1) + (fold([columns[-1][at]]) & (pieces[at] - 1).astype(U64))), self.bits)
        return out, pieces

    def store_hot(self, order: int, shard: int, table: pa.Table) -> pa.Table:
        (context, which), value = _blocks(table, 2)
        keys = context[_runs([context])]
        out = np.zeros((4, len(keys)), np.int64)
        out[which.astype(np.int64), np.searchsorted(keys, context)] = value
        K.write_arrays(self.folder, f"hot-{order}-{shard}", [keys, out.reshape(-1).astype("<u8")])
        return _table([])

    def store_continued(self, shard: int, table: pa.Table) -> pa.Table:
        (ids,), n = _blocks(table, 1)
        out = np.zeros(int(self.sizes[:, shard].sum()), np.int64)
        out[self.home(ids)[1]] = n
        K.write_arrays(self.folder, f"continued-{shard}", _narrow(out))
        return _table([(-1, shard, b"")], [[int(n.sum()), int((n == 1).sum()), int((n == 2).sum()), int((n >= 3).sum()), *_counts_of_counts(n)]])

    def find(self, columns: list[np.ndarray], known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of n-grams: their count without its discount; the count of their context, and what its discounts leave.  0 where there are none."""
        order, d = len(columns), np.array([0.0, *self.discount[len(columns)]])
        some = slice(None) if known.all() else np.flatnonzero(known)
        columns = [c[some] for c in columns]
        context = fold(columns[:-1])
        whole = K.mix(context * _C + columns[-1].astype(U64) + U64(1))
        shard, pieces = self.shard(columns, context)
        cold = pieces == 1
        hot = np.flatnonzero(~cold)
        parts = []  # n-grams, and contexts that are in one shard: each is looked for once, shard by shard
        for key, wanted in ((_key(whole), None), (_key(context), np.flatnonzero(cold) if len(hot) else None)):
            own = shard if wanted is None else shard[wanted]
            key = key if wanted is None else key[wanted]
            by = np.argsort((own.astype(U64) << U64(63 - self.bits) | key >> U64(self.bits + 1)))
            key = key[by]
            at = _runs([key])
            by = by if wanted is None else wanted[by]
            parts.append((by, np.diff(at, append=len(by)), key[at], np.searchsorted(shard[by[at]], np.arange((1 << self.bits) + 1))))
        (_, _, grams, g), (_, _, contexts, c) = parts
        seen, stats = np.zeros(len(grams), np.int64), [np.zeros(len(contexts), np.int64) for _ in range(4)]
        for s in np.flatnonzero((np.diff(g) > 0) | (np.diff(c) > 0)).tolist():
            arrays = K.mapped_arrays(self.folder, f"{order}-{s}", CODED + CODED)
            if arrays is not None:
                seen[g[s] : g[s + 1]] = _found(arrays[:6], grams[g[s] : g[s + 1]], 1)[0]
                for x, v in zip(stats, _found(arrays[6:], contexts[c[s] : c[s + 1]], 4), strict=True):
                    x[c[s] : c[s + 1]] = v
        out = np.zeros((3, len(whole)))
        for k, (by, size, x) in enumerate(((*parts[0][:2], seen - d[np.minimum(seen, 3)]), (*parts[1][:2], stats[0]), (*parts[1][:2], d[1] * stats[1] + d[2] * stats[2] + d[3] * stats[3]))):
            out[k][by] = np.repeat(x.astype(float), size)
        home = K.top(context[hot], self.bits)
        for s in np.unique(home).tolist():
            arrays = K.mapped_arrays(self.folder, f"hot-{order}-{s}", HOT_CONTEXT)
            if arrays is None:
                continue
            own = hot[home == s]
            at = np.minimum(np.searchsorted(arrays[0], context[own]), len(arrays[0]) - 1)
            here = arrays[0][at] == context[own]
            total, one, two, more = (np.where(here, arrays[1][at + k * len(arrays[0])], 0).astype(np.int64) for k in range(4))
            out[1, own], out[2, own] = total, d[1] * one + d[2] * two + d[3] * more
        if isinstance(some, slice):
            return tuple(out)
        every = np.zeros((3, len(known)))
        every[:, some] = out
        return tuple(every)

    def probabilities(self, tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token: its count in training, its probability."""
        ids, count, cont, back = self.words(tokens)
        p = np.full(len(ids), 1 / (self.vocabulary + 1))
        if self.continuations:
            d = np.array([0.0, *self.discount[1]])
            left = float(np.dot(d[1:], self.leave)) / self.continuations
            p = (cont - d[np.minimum(cont, 3)]) / self.continuations + left * p
        ids, count, p = ids[back], count[back], p[back]
        columns, context_known = [ids], np.ones(len(ids), bool)
        for k in range(2, self.order + 1 if self.train_tokens else 2):
            earlier = before(ids, bounds, k - 1)
            columns, context_known = [earlier, *columns], context_known & (earlier >= 0)
            # An unknown last word: its number stands for none, the context counts.
            last = np.where(ids >= 0, ids, self.vocabulary + 1)
            seen, total, left = self.find([*columns[:-1], last], context_known)
            whole = np.maximum(total, 1)
            p = np.where(total > 0, seen / whole + left / whole * p, p)
        return count, p


def train(texts: DataFrame, text_col: str = "text", order: int = ORDER, folder: str | None = None) -> Model:
    """Counts the n-grams of all rows and stores the model in ``folder`` (by default below the shared folder)."""
    if order < 2:
        raise ValueError("order must be at least 2")
    spark = texts.sparkSession
    _io.bounded_batches(spark)
    folder = _io.qualified(spark, folder or _io.scratch(spark, "kneser-ney"))
    texts = texts.select(F.col(text_col).cast("string").alias("text"))
    size, rows = texts.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 6), F.count(F.lit(1))).first()
    bits = int(max(16, (size or 0) // 6 // SHARD_NGRAMS) - 1).bit_length()
    model = Model(folder, order, bits, max(1, SHARD_NGRAMS // 2), rows, sizes=np.zeros((BUCKETS, 1 << bits), np.int64))
    words = texts.mapInArrow(_count_words(bits), SCHEMA).groupBy("kind", "shard").applyInArrow(_store_words(folder), SCHEMA)
    for r in words.select("shard", "stats").collect():  # a few numbers for each shard, here and below
        model.train_tokens += r["stats"][0]
        model.sizes[:, r["shard"]] = r["stats"][1:]
    shared = spark.sparkContext.broadcast(model)
    blocks = texts.mapInArrow(_count(shared), SCHEMA)
    for k in range(order, 0, -1):
        blocks = blocks.groupBy("kind", "shard").applyInArrow(_reduce(shared, k), SCHEMA)
    stats = {k: [] for k in range(1, order + 1)}
    for r in blocks.select("kind", "stats").collect():
        stats[-r["kind"]].append(r["stats"])
    total = {k: [sum(x) for x in zip(*v, strict=True)] for k, v in stats.items()}
    for k in range(2, order + 1):
        model.discount[k] = discounts(total[k] or [0] * 4)
    own = total[1] or [0] * 8
    model.continuations, model.leave, model.discount[1] = own[0], own[1:4], discounts(own[4:])
    return model


def _score(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm: Model = model.value
        base = np.log10(lm.train_tokens + lm.vocabulary + 1)

        def flush(held: list) -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            tokens = np.concatenate([h[1] for h in held])
            many = np.concatenate([np.diff(h[2]) for h in held])
            bounds = np.concatenate(([0], np.cumsum(many)))
            count, p = lm.probabilities(tokens, bounds)
            sums = [np.add.reduceat(x, bounds[:-1]) for x in (np.log10(count + 1.0) - base, np.log10(p), (count > 0).astype(np.int64))]
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(many, pa.int64()), pa.array(sums[2], pa.int64()), pa.array(np.full(len(many), lm.train_tokens), pa.int64()), pa.array(sums[0]), pa.array(sums[1]), pa.array(10 ** np.minimum(-sums[1] / many, 300))],
                ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

        held, size = [], 0
        for batch in batches:
            for lo, hi, tokens, bounds in token_hashes(batch.column(1)):
                held.append((batch.column(0).slice(lo, hi - lo), tokens, bounds))
                size += len(tokens)
                if size >= SCORE_TOKENS:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (log10), perplexity."""
    _io.bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), f"id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
