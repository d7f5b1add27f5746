"""Vectorised word handling on the UTF-8 buffers of Arrow string columns.

The functions work on numpy arrays of bytes and never make one Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_MULT = U(0x9E3779B97F4A7C15)
_SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE_CODES = mix(np.arange(1, 257, dtype=U) * _MULT)
_INVERSE = U(pow(int(_MULT), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
UNCHANGED = np.arange(256, dtype=np.uint8)


def _byte_set(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in spans:
        out[a : b + 1] = True
    return out


#: Words without space or the five ASCII control characters that separate.
NON_SPACE = ~_byte_set((0x20, 0x20), (0x09, 0x0D))
#: ASCII letters and digits, and every byte of a character beyond ASCII.
ALNUM = _byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; a longer row is a run of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def row_slices(batch: pa.RecordBatch, at: int, most_bytes: int = 2 << 20, most_rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, bounded by rows and by the size of one column of texts or lists."""
    column = batch.column(at)
    is_list = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
    sizes = pc.multiply(pc.list_value_length(column), 4) if is_list else pc.binary_length(column)
    offsets = np.concatenate([[0], np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False))])
    for lo, hi in row_chunks(offsets, most_bytes):
        for i in range(lo, hi, most_rows):
            yield batch.slice(i, min(most_rows, hi - i))


def word_spans(raw: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and where each row's words begin (rows + 1 values)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = word_bytes[raw]
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(raw)]
    before[begins] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[begins[begins > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, read_as: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hash of every word, by default with A-Z lower-cased: a rolling polynomial, then scrambled.

    Two given different words share a value with probability about 2**-64.
    """
    out = np.empty(len(starts), U)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + _SEGMENT)))
        base, stop = int(starts[lo]), int(ends[hi - 1])
        power, inverse = _power_tables(stop - base + 1)
        sums = np.zeros(stop - base + 1, U)
        np.cumsum(_BYTE_CODES[read_as[raw[base:stop]]] * power[: stop - base], out=sums[1:])
        a, b = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = (sums[b] - sums[a]) * inverse[a] + (b - a).astype(U)
        lo = hi
    return mix(out)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, _SEGMENT + (1 << 16))
        for i, m in enumerate((_MULT, _INVERSE)):
            steps = np.full(n, m, U)
            steps[0] = U(1)
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def hash_of(word: bytes) -> int:
    raw = np.frombuffer(word, np.uint8)
    return int(word_hashes(raw, np.array([0]), np.array([len(word)]))[0])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, joined."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    firsts = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(firsts, counts) + np.repeat(starts, counts)
