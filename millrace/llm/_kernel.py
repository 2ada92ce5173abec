"""Vectorised byte-level tokenising and hashing, shared by the set-similarity operators.

The kernels work on the UTF-8 buffers of Arrow string columns.  Token classes used here
never split a multi-byte character (every byte >= 0x80 belongs to one class), so that
looking at bytes gives the same tokens as looking at code points.
"""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs

from . import _io

U64 = np.uint64
#: Bytes handled at once; a longer single text is handled alone.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit words."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def series(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit words, the same on every machine."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003)) * U64(0x9E3779B97F4A7C15))


_BASE = int(0xD6E8FEB86659FD93)
_BYTE = series(7, 256)

#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(inside) -> np.ndarray:
    return np.fromiter((bool(inside(b)) for b in range(256)), bool, 256)


#: Letters a-z, digits and everything outside ASCII.
WORD = byte_class(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
#: Everything but blanks.
NONBLANK = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, U64), np.full(n, pow(_BASE, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and n+1 offsets; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if where else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) in runs of about ``most`` bytes; no text is cut."""
    data, offsets = text_bytes(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def tokens(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of a class after lower-casing A-Z.

    Returns the lower-cased bytes and, for each token, start, end, number of its text and a
    64-bit hash of its bytes.  Tokens never cross from one text into the next.
    """
    n = len(data)
    low = LOWER[data]
    if not n:
        none = np.zeros(0, np.int64)
        return low, none, none, none, np.zeros(0, U64)
    mask = inside[low]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    before = np.empty(n, bool)
    before[0], before[1:] = False, mask[:-1]
    before[cut] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, mask[1:]
    after[cut - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    return low, starts, ends, np.searchsorted(offsets, starts, side="right") - 1, hashes(low, starts, ends)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from each start to its end."""
    n = len(data)
    up, down = _powers(max(CHUNK_BYTES, 1 << int(max(n - 1, 1)).bit_length()))
    run = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[data] * up[:n], out=run[1:])
    return mix((run[ends] - run[starts]) * down[np.minimum(starts, len(down) - 1)])


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of runs that begin at ``start``, one run behind the other."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` tokens, and the n_docs+1 bounds of each text's run of them.

    A text with fewer tokens, but not none, has one shingle of all its tokens.
    """
    per = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(per)))
    many = np.where(per >= width, per - width + 1, np.minimum(per, 1))
    bounds = np.concatenate(([0], np.cumsum(many)))
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], many) + np.repeat(first[:-1], many)
    size = np.repeat(np.minimum(per, width), many)
    out = size.astype(U64)
    for k in range(width):
        inside = k < size
        step = hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] if len(hashes) else out
        out = np.where(inside, out * U64(_BASE) + step, out)
    return mix(out), bounds


# ---- memory ------------------------------------------------------------------------------------

@lru_cache(maxsize=1)
def _trim():
    """glibc's malloc_trim, where there is one."""
    import ctypes

    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


def giving_back(run, *caches):
    """``run`` over a partition's batches; at its end ``caches`` are cleared and free memory goes back to the system, as the worker lives on."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for cache in caches:
                cache.cache_clear()
            pa.default_memory_pool().release_unused()
            if trim := _trim():
                trim(0)

    return wrapped


# ---- files of sorted arrays, which workers memory-map ------------------------------------------

#: What a worker keeps of files that can't be mapped.
CACHE_BYTES = 256 << 20
_kept: OrderedDict[tuple[str, str], np.ndarray | None] = OrderedDict()


def write_arrays(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    parts = [np.array([len(a) for a in arrays], "<i8").tobytes()]
    for a in arrays:
        parts += [a.tobytes(), bytes(-a.nbytes % 8)]
    _io.write_file(folder, name, parts)


def _raw(folder: str, name: str) -> np.ndarray | None:
    fs, path = pafs.FileSystem.from_uri(folder)
    if isinstance(fs, pafs.LocalFileSystem):  # the system caches what is mapped
        return np.memmap(f"{path}/{name}", np.uint8, "r").view(np.ndarray) if os.path.exists(f"{path}/{name}") else None
    if (folder, name) not in _kept:
        data = _io.read_file(folder, name)
        _kept[folder, name] = None if data is None else np.frombuffer(data, np.uint8)
        while sum(x.nbytes for x in _kept.values() if x is not None) > CACHE_BYTES and len(_kept) > 1:
            _kept.popitem(last=False)
    _kept.move_to_end((folder, name))
    return _kept[folder, name]


def mapped_arrays(folder: str, name: str, kinds: tuple[str, ...]) -> list[np.ndarray] | None:
    """The arrays of a file; None where there is none."""
    raw = _raw(folder, name)
    if raw is None:
        return None
    sizes = raw[: 8 * len(kinds)].view("<i8")
    out, at = [], 8 * len(kinds)
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        nbytes = n * np.dtype(kind).itemsize
        out.append(raw[at : at + nbytes].view(kind))
        at += nbytes + -nbytes % 8
    return out


def top(values: np.ndarray, bits: int) -> np.ndarray:
    """The shard of each hash: its leading bits."""
    return (values >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)


def by_shard(values: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(shard, start, end) of runs of sorted hashes."""
    shard = top(values, bits)
    edge = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard)).tolist()
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield int(shard[a]), a, b
