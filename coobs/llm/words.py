"""Words and word n-grams of whole Arrow columns, without a loop over rows or words.

A column of texts is one byte buffer with row offsets.  A table of 256 entries says which
bytes belong to words and lower-cases A-Z; word hashes are differences of one running sum
(a polynomial in a fixed odd base, then mixed), n-gram hashes combine shifted word hashes.
Work goes in blocks of about a megabyte, and a longer text is cut between words, so the
temporary arrays stay small whatever the texts are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def lower_table(separators: bytes) -> np.ndarray:
    """Byte -> 0 for a separator, else 1 + the byte with A-Z lower-cased."""
    table = np.arange(1, 257, dtype=np.uint16)
    table[65:91] += 32
    table[np.frombuffer(separators, np.uint8)] = 0
    return table


def alnum_table() -> np.ndarray:
    """Words of digits, letters and everything beyond ASCII."""
    return lower_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def space_table() -> np.ndarray:
    """Words between ASCII white space."""
    return lower_table(bytes([0x20, *range(0x09, 0x0E)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def text_blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets from 0) of consecutive rows; nulls read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Hasher:
    """Word hashes of a block of texts."""

    def __init__(self, table: np.ndarray):
        self.table, self.up, self.down = table, powers(BASE, 1024), powers(BASE_INVERSE, 1024)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first byte and end byte of each word, and each row's first word (one more at the end)."""
        n = len(data)
        fresh = np.zeros(n + 1, bool)
        fresh[offsets] = True
        hashes, starts, ends, pos = [], [], [], 0
        while pos < n:
            stop = min(n, pos + BLOCK)
            while stop < n and self.table[data[stop]] and not fresh[stop]:
                stop += 1
            value = self.table[data[pos:stop]]
            inside = value > 0
            first, last = inside.copy(), inside.copy()
            joined = inside[1:] & inside[:-1] & ~fresh[pos + 1 : stop]
            first[1:] &= ~joined
            last[:-1] &= ~joined
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            if len(value) > len(self.up):
                self.up, self.down = powers(BASE, 2 * len(value)), powers(BASE_INVERSE, 2 * len(value))
            total = np.zeros(len(value) + 1, np.uint64)
            np.cumsum(value * self.up[: len(value)], out=total[1:])
            hashes.append(mix((total[e] - total[s]) * self.down[s] + (e - s).astype(np.uint64)))
            starts.append(s + pos)
            ends.append(e + pos)
            pos = stop
        if not hashes:
            empty = np.zeros(0, np.int64)
            return empty.astype(np.uint64), empty, empty, np.zeros(len(offsets), np.int64)
        start = np.concatenate(starts)
        return np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, offsets)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on; the last n - 1 words of a block have none."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = words[:m].copy()
    for j in range(1, n):
        total *= np.uint64(BASE)
        total += words[j : j + m]
    return mix(total + np.uint64(n))


def in_one_row(first: np.ndarray, n: int, count: int) -> np.ndarray:
    """For each n-gram of a block: does it stay inside its row?"""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return rows[:count] == rows[n - 1 : n - 1 + count] if count else np.zeros(0, bool)


def list_array(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """Rows of lists from their concatenated values."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
