"""Vectorised text primitives: words, hashes and n-grams of whole Arrow batches.

All functions work on the UTF-8 bytes of a batch at once.  A word is a maximal
run of bytes other than ``[\\x20\\x09-\\x0D]``; as those bytes are ASCII, byte runs
and code point runs are the same.  Hashes are polynomials modulo 2**64 over a
random byte table, then mixed; they do not depend on how rows were batched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_IP = pow(_P, -1, 2**64)
_Q = 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}
#: Bytes of text that one vectorised step takes; a longer text is a step of its own.
STEP_BYTES = 2 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * STEP_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and len + 1 offsets into them; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.chunked_array(column.chunks or [pa.array([], column.type)]).cast(pa.large_binary()).combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1] or b"\0" * 8, np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes each, and one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE, borders: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes not in space, which also ends where borders has a true value between two bytes, and len + 1 offsets: the words of row i are first[i] to first[i + 1]."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    np.logical_not(space[data], out=inside[1 : n + 1])
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    if borders is not None and n:
        edge[1:n] |= borders
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """For span_hashes: sums[i] holds the bytes before i."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_P, len(data)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes have equal hashes."""
    return mix((sums[ends] - sums[starts]) * powers(_IP, len(sums))[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(prefix_sums(data), starts, ends)


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's n-grams of words, and len + 1 offsets of the rows; a row with fewer words has none."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    out = np.concatenate([[0], np.cumsum(counts)])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    total = len(hashes) - n + 1
    if n <= 8:
        h = hashes[:total].copy()
        for j in range(1, n):
            h *= np.uint64(_Q)
            h += hashes[j : total + j]
    else:
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * powers(_P, len(hashes)), out=sums[1:])
        h = (sums[n:] - sums[:-n]) * powers(_IP, total)
    at = np.arange(out[-1]) + np.repeat(first[:-1] - out[:-1], counts)
    return mix(h[at]), out
