"""Words of many texts as 64-bit hashes, without a Python step per word.

Used inside tasks on Arrow batches. A batch is worked off in chunks of bounded bytes; a
text longer than that is a chunk of its own. Hashes are polynomials over the bytes, taken
from one running sum, and then mixed; equal words have equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
U64 = np.uint64

_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# Odd multipliers; the second of each pair is its inverse modulo 2 ** 64.
_BYTE = 0x9E3779B97F4A7C15
_WORD = 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1 if base in (_BYTE, _inverse(_BYTE)) else CHUNK_BYTES // 4)
        have = np.full(size, base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xCA5A826395121157)
    x ^= x >> U64(29)
    return x


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for every pair; nothing may be empty."""
    n = len(values)
    weighted = values * powers(base, n)
    total = np.zeros(n + 1, U64)
    np.cumsum(weighted, out=total[1:])
    return (total[ends] - total[starts]) * powers(_inverse(base), n)[starts]


def chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of pieces of a text column. Nulls are
    empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the number of words before it (one more entry
    than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    ink = ~_GAP[data]
    starts, ends = ink.copy(), ink.copy()
    starts[1:] &= ~ink[:-1]
    ends[:-1] &= ~ink[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    starts[edge] = ink[edge]
    ends[edge - 1] = ink[edge - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    letters = (_LOWER[data] if lower else data).astype(U64) + U64(1)
    hashes = mix(spans(letters, starts, ends, _BYTE) + (ends - starts).astype(U64) * U64(_WORD))
    return hashes, np.searchsorted(starts, offsets)


def window_starts(firsts: np.ndarray, width: int) -> np.ndarray:
    """Indices of the words at which a window of `width` words of one text starts."""
    good = np.ones(firsts[-1], bool)
    for k in range(1, width):
        late = firsts[1:] - k
        good[late[late >= firsts[:-1]]] = False
    return np.flatnonzero(good)


def window_hashes(hashes: np.ndarray, starts: np.ndarray, width: int, base: int = _WORD) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, U64)
    return mix(spans(hashes, starts, starts + width, base))
