"""Vectorised text kernels over Arrow string buffers.

A text batch is one byte array plus document offsets. Words are maximal runs of bytes other than
0x20 and 0x09-0x0D, so no decoding is needed to find them. Hashes are 64-bit polynomial hashes
taken from prefix sums (an odd base is invertible modulo 2**64) and then mixed.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; only a single longer document exceeds it.
BATCH_BYTES = 2 << 20
#: Bytes hashed at once.
HASH_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = _U(base)
    np.multiply.accumulate(out, out=out)
    return out


class _Powers:
    """Powers of the base and of its inverse for pieces of at most HASH_BYTES, made when first asked for."""

    up = down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = min(max(n, 1 << 16, 2 * len(self.up)), max(n, HASH_BYTES + 1))
            self.up, self.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return self.up, self.down


_POWERS = _Powers()
_HELD: list = [None, None]


def release() -> None:
    """Gives memory that a worker doesn't use any more back to the system; an idle worker shares its machine with others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library may have no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """`run` over a task's batches, or over one group of rows, and release() when it is done."""

    def over_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    def over_group(table: pa.Table) -> pa.Table:
        out = run(table)
        del table
        release()
        return out

    return over_batches if inspect.isgeneratorfunction(run) else over_group


def held(key: tuple, make: Callable[[], object]) -> object:
    """The one object (a tokenizer and what it remembers) that a Python worker keeps between tasks; another key replaces it."""
    if _HELD[0] != key:
        _HELD[:] = [None, None]
        release()
        _HELD[:] = [key, make()]
    return _HELD[1]


_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
#: The same values, but A-Z hash as a-z.
_TABLE_LOWER = _TABLE.copy()
_TABLE_LOWER[65:91] = _TABLE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_SHINGLE = np.random.default_rng(7).integers(0, 1 << 64, 16, dtype=np.uint64) | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (fixed values)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls are empty, offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, off, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a piece holds at most about `limit` bytes of the column (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = buffers(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(off, off[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def row_slices(batches: Iterator[pa.RecordBatch], row: str = "_row") -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batches cut likewise by the field `text` of the struct `row`, with that field as strings."""
    for batch in batches:
        text = pa.RecordBatch.from_arrays([batch.column(row).field("text").cast(pa.string())], names=["text"])
        at = 0
        for part in slices([text]):
            yield batch.slice(at, part.num_rows), part.column("text")
            at += part.num_rows


def spans(data: np.ndarray, off: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each document and in all) of the runs of bytes outside `breaks`; runs end with documents."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    np.logical_not(breaks[data], out=inside[1 : n + 1])
    begin = inside[1 : n + 1] & ~inside[:n]
    stop = inside[1 : n + 1] & ~inside[2:]
    cuts = off[:-1][np.diff(off) > 0]
    begin[cuts] = inside[1 : n + 1][cuts]
    last = off[1:][np.diff(off) > 0] - 1
    stop[last] = inside[1 : n + 1][last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, off)


def _prefix_sums(part: np.ndarray, table: np.ndarray, up: np.ndarray) -> np.ndarray:
    sums = np.empty(len(part) + 1, np.uint64)
    sums[0] = 0
    np.multiply(table[part], up[: len(part)], out=sums[1:])
    return np.add.accumulate(sums, out=sums)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span's bytes, A-Z as a-z if `lower`; spans are in order and don't overlap."""
    table, out = _TABLE_LOWER if lower else _TABLE, np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + HASH_BYTES, "right")))
        if ends[j - 1] - base <= HASH_BYTES:
            part = data[base : int(ends[j - 1])]
            up, down = _POWERS.get(len(part) + 1)
            sums = _prefix_sums(part, table, up)
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = (sums[e] - sums[s]) * down[s]
        else:  # one long span, in pieces
            total = 0
            for at in range(base, int(ends[i]), HASH_BYTES):
                part = data[at : min(at + HASH_BYTES, int(ends[i]))]
                total += int(_prefix_sums(part, table, _POWERS.get(len(part))[0])[-1]) * pow(_BASE, at - base, 1 << 64)
            out[i] = total % (1 << 64)
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def hash_grams(data: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n bytes at every place from which they fit."""
    out = np.empty(max(0, len(data) - n + 1), np.uint64)
    for at in range(0, len(out), HASH_BYTES):
        k = min(HASH_BYTES, len(out) - at)
        up, down = _POWERS.get(k + n)
        sums = _prefix_sums(data[at : at + k + n - 1], _TABLE, up)
        out[at : at + k] = mix((sums[n:] - sums[:k]) * down[:k])
    return out


def shingles(words: np.ndarray, before: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, shingles before each document) of the k-word windows; a shorter document has its whole sequence as one."""
    counts = np.diff(before)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(int(at[-1]), np.uint64)
    m = len(words) - k + 1
    if m > 0:
        acc = words[:m] * _SHINGLE[0]
        for j in range(1, k):
            acc += words[j : j + m] * _SHINGLE[j]
        full = np.repeat(counts >= k, n)
        first = np.repeat(before[:-1] - at[:-1], n) + np.arange(len(out))
        out[full] = acc[first[full]]
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        w = words[before[d] : before[d + 1]]
        out[at[d] : at[d] + 1] = (w * _SHINGLE[: len(w)]).sum(dtype=np.uint64, keepdims=True) + _SHINGLE[k + len(w) : k + len(w) + 1]
    return mix(out), at


def per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of the flags in each document's part of an array."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[off[1:]] - sums[off[:-1]]


def repeated(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks (found twice or more in its document, equal to an earlier one there) of the keys."""
    doc = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    own = mix(keys + doc * _U(0x9FB21C651E98DF25))
    order = np.argsort(own, kind="stable")
    s = own[order]
    same = s[1:] == s[:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    later[order[1:][same]] = True
    return twice, later


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start..start+len of each piece, one after another."""
    total = int(lens.sum())
    ends = np.cumsum(lens)
    return np.arange(total) + np.repeat(starts - (ends - lens), lens)
