"""Vectorised work on the UTF-8 buffers of Arrow string columns.

Rows of a batch lie one after another in one byte buffer, so words, shingles and n-grams of many
documents come out of a few numpy passes.  Batches are cut to ``PIECE`` bytes first: the passes
hold about ten eight-byte arrays, which stays near 100 MB however long the batch is.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
U64 = np.uint64
_MULT = 0xD1342543DE82EF95  # an odd 64-bit multiplier: powers of it are invertible
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), element by element."""
    x = x ^ (x >> U64(30))
    x = x * _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives its unused memory back; reused workers would keep it."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[0] = 1
    if n > 1:
        out[1:] = U64(base)
        np.multiply.accumulate(out, out=out)
    return out


_INVERSE = pow(_MULT, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_cache: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least ``n`` of each."""
    if len(_cache.get("up", ())) < n:
        m = max(n, PIECE + 1024)
        _cache["up"], _cache["down"] = _powers(_MULT, m), _powers(_INVERSE, m)
    return _cache["up"][:n], _cache["down"][:n]


def prefix(buf: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the polynomial hash of buf[i:j], scaled by the i-th power."""
    out = np.zeros(len(buf) + 1, U64)
    up, _ = powers(len(buf) + 1)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=out[1:])
    return out


def spans_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings start..end, the same wherever they lie."""
    _, down = powers(len(p))
    return mix((p[end] - p[start]) * down[start] + (end - start).astype(U64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(off, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    if data is None:
        return offsets - offsets[0], np.zeros(0, np.uint8)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], raw


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(buf: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of bytes outside ``gap``, within rows."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~gap[buf]
    head = ink.copy()
    head[1:] &= ~ink[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(buf))]
    head[cuts] = ink[cuts]
    tail = ink.copy()
    tail[:-1] &= ~ink[1:]
    tail[cuts - 1] = ink[cuts - 1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


_LONG = 1024  # bytes of a word; the few longer ones are hashed one by one
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words start..end, by eight bytes at a time.

    Every step is a bijective mix of the state and eight bytes, so words of up to eight bytes never
    collide and no structure of a longer word (like that of words that collide in any polynomial
    modulo a power of two) survives.
    """
    data = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", data, strides=(1,))
    size = end - start
    h = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(1))
    h = mix(h ^ (eight[start] & _MASK[np.minimum(size, 8)]))
    rest, at = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(rest):
        h[rest] = mix(h[rest] ^ (eight[start[rest] + at] & _MASK[np.minimum(size[rest] - at, 8)]))
        at += 8
        rest = rest[size[rest] > at]
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def shingle_hashes(words: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row, (hash, row); a shorter row is one shingle."""
    count = np.bincount(row, minlength=n_rows)
    if len(words) >= k:
        h = np.zeros(len(words) - k + 1, U64)
        for i in range(k):
            h = mix(h + words[i : len(words) - k + 1 + i])
        whole = row[: len(h)] == row[k - 1 :]
        h, r = h[whole], row[: len(whole)][whole]
    else:
        h, r = np.zeros(0, U64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.concatenate([[0], np.cumsum(count)])
        extra = np.zeros(len(short), U64) + (count[short].astype(U64) << U64(56))
        for i in range(k - 1):
            has = count[short] > i
            extra[has] = mix(extra[has] + words[first[short[has]] + i])
        h, r = np.concatenate([h, mix(extra ^ U64(0xA5A5))]), np.concatenate([r, short])
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r


def row_shingles(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, cuts): of row i the sorted distinct hashes of its k-word shingles lie at cuts[i]:cuts[i + 1]."""
    low = LOWER[buf]
    start, end, row = word_spans(low, offsets)
    words = word_hashes(low, start, end)
    n = len(offsets) - 1
    h, r = shingle_hashes(words, row, n, k)
    cut = np.searchsorted(r, np.arange(n + 1))
    for i in range(n):
        h[cut[i] : cut[i + 1]].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], np.concatenate([[0], np.cumsum(new)])[cut]


def text_rows(batch: pa.RecordBatch, name: str = "text", limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, offsets, bytes) for pieces of a batch's string column."""
    offsets, raw = buffers(batch.column(batch.schema.get_field_index(name)))
    for i, j in pieces(offsets, limit):
        yield i, j, offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]]
