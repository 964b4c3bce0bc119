"""Vectorised scans of text columns inside Arrow batches: words, word hashes and n-gram hashes.

Texts of a batch lie behind one another in one byte buffer, so numpy passes over the buffer replace loops over
documents. Batches are cut into slices of about ``SLICE_BYTES`` bytes, so memory follows the slice and the longest text.
Words are maximal runs without the bytes space and tab to carriage return. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_random = np.random.RandomState(20240607)
_BYTE_CODE = _random.randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_CODE_LOWER = _BYTE_CODE.copy()
_BYTE_CODE_LOWER[65:91] = _BYTE_CODE[97:123]
_BASE = 0x9E3779B97F4A7C15
_GRAM_CODE = _random.randint(1, 2**63 - 1, 16, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        inverse = pow(_BASE, -1, 1 << 64)
        tables = []
        for base in (_BASE, inverse):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        if n > SLICE_BYTES + (1 << 16):
            return tables[0], tables[1]
        _powers = (tables[0], tables[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, bytes, row offsets) of consecutive rows with about ``limit`` bytes; a longer text has its own slice."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row = 0
    for chunk in chunks:
        if len(chunk) == 0:
            continue
        chunk = pc.fill_null(chunk.cast(pa.large_string()), "")
        _, offset_buffer, data_buffer = chunk.buffers()
        offsets = np.frombuffer(offset_buffer, dtype=np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(chunk):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
            yield row + first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last
        row += len(chunk)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start byte, end byte and row of every word."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = _IN_WORD[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


_OUTER = np.zeros(256, dtype=bool)
_OUTER[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def trim_punctuation(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, times: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Words without up to ``times`` ASCII punctuation marks at either end; one byte always stays."""
    if len(starts):
        for _ in range(times):
            starts = starts + (_OUTER[data[starts]] & (ends - starts > 1))
            ends = ends - (_OUTER[data[ends - 1]] & (ends - starts > 1))
    return starts, ends


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte ranges; with ``lower``, A to Z count as a to z."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    powers, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_BYTE_CODE_LOWER if lower else _BYTE_CODE)[data] * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and index of the first word of every ``n`` consecutive words of one row."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = hashes[:count] * _GRAM_CODE[0]
    for k in range(1, n):
        total = total + mix(hashes[k : k + count] * _GRAM_CODE[k])
    whole = np.flatnonzero(rows[:count] == rows[n - 1 :])
    return mix(total[whole] + np.uint64(n)), whole


def row_bounds(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Positions at which each row begins in a sorted array of row numbers, and its end."""
    return np.searchsorted(rows, np.arange(n_rows + 1))
