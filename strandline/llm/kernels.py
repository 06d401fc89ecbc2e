"""Vectorised text kernels shared by the corpus operators.

Everything works on the raw UTF-8 buffers of Arrow string arrays, so no Python
string is made for a document unless an operator needs one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Text bytes that one vectorised call works on; bounds the memory of a Python worker.
SLICE_BYTES = 2_000_000

_MULT = 0x9E3779B97F4A7C15
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Bytes of a chunk of 8 that lie in a span of which so many are left.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a span that are hashed chunk by chunk with all others; what is beyond is hashed span by span.
_LONG = 1_024


def lower_table() -> np.ndarray:
    """Bytes with A-Z mapped to a-z."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_table()


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying the text; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not (pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)):
        col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) else pa.large_string())
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_large_binary(col.type) else "")
    _, offs, data = col.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, np.int64, n + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def slices(batch: pa.RecordBatch, col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch with at most ``limit`` bytes of text each, one row at least."""
    _, offs = text_buffer(batch.column(col))
    i, n = 0, batch.num_rows
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield batch.slice(i, j - i)
        i = j


def runs(member: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the maximal runs of True that do not cross a document's start."""
    if not len(member):
        z = np.zeros(0, np.int64)
        return z, z
    first = member.copy()
    first[1:] &= ~member[:-1]
    last = member.copy()
    last[:-1] &= ~member[1:]
    inner = offs[1:-1]
    at = inner[(inner > 0) & (inner < len(member))]
    first[at] |= member[at]
    last[at - 1] |= member[at - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _chunks(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place, zeros behind the end; a view of one copy of the buffer."""
    held = np.zeros(len(data) + 8, np.uint8)
    held[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", held, strides=(1,))


def span_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the byte spans [first, end); equal spans have equal hashes wherever they stand.

    ``table`` maps bytes before they are hashed (lower-casing). Chunks of eight
    bytes are mixed in one after the other, so that no arithmetic relation
    between two spans makes their hashes equal.
    """
    if not len(first):
        return np.zeros(0, np.uint64)
    if table is not None:
        data = table[data]
    chunk, size, step = _chunks(data), end - first, _U(_MULT)
    h = mix((mix(size.astype(np.uint64) * step) ^ (chunk[first] & _MASK[np.minimum(size, 8)])) + step)
    rest, k = np.flatnonzero(size > 8), 8
    while len(rest) and k < _LONG:
        left = size[rest] - k
        h[rest] = mix((h[rest] ^ (chunk[first[rest] + k] & _MASK[np.minimum(left, 8)])) + step)
        rest, k = rest[left > 8], k + 8
    for i in rest.tolist():
        h[i] ^= _U(xxhash.xxh64_intdigest(data[first[i] + k : end[i]].tobytes(), int(h[i])))
    return h


def same_spans(a: np.ndarray, a_first: np.ndarray, b: np.ndarray, b_first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from each place of ``a`` equal those from the same row's place of ``b``."""
    x, y = _chunks(a), _chunks(b)
    same = ((x[a_first] ^ y[b_first]) & _MASK[np.minimum(size, 8)]) == 0
    rest, k = np.flatnonzero(same & (size > 8)), 8
    while len(rest):
        left = size[rest] - k
        ok = ((x[a_first[rest] + k] ^ y[b_first[rest] + k]) & _MASK[np.minimum(left, 8)]) == 0
        same[rest[~ok]] = False
        rest, k = rest[ok & (left > 8)], k + 8
    return same


def per_document(first: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index range [lo, hi) of each document's runs."""
    lo = np.searchsorted(first, offs[:-1])
    return lo, np.searchsorted(first, offs[1:])


def member_table(pred: Callable[[int], bool]) -> np.ndarray:
    return np.fromiter((pred(b) for b in range(256)), bool, 256)


#: Tables that operators keep in a worker from task to task.
_KEPT: list[dict] = []


def kept() -> dict:
    """A new table that stays in a worker from task to task, until :func:`let_go`."""
    _KEPT.append({})
    return _KEPT[-1]


def let_go() -> None:
    """Free what other operators' tasks have left in this worker: one that has its own work for long needs none of it."""
    if any(_KEPT):
        for table in _KEPT:
            table.clear()
        give_back()


def give_back() -> None:
    """Return freed memory to the system at a task's end: a worker that waits for its next task should be small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass
