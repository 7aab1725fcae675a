"""Words, hashes and n-grams of many texts at once, on the bytes of Arrow columns.

All functions work on UTF-8 bytes: every byte of a non-ASCII character is 0x80 or
more, so byte classes give the same words as the character classes they stand for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; only a single longer text goes beyond.
SLICE_BYTES = 1 << 19

#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, np.uint64)
        got[0] = 1
        got = _powers[base] = np.multiply.accumulate(got)
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x = x * _M2
    x ^= x >> np.uint64(31)
    return x


def salt(seed: int) -> np.uint64:
    return mix(np.array([seed], np.uint64) * np.uint64(_BASE) + np.uint64(1))[0]


def slices(batch: pa.RecordBatch, column: str | int, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of at most `limit` bytes of text (one row at least), with the text's bytes and row bounds; null texts are empty."""
    at = batch.schema.get_field_index(column) if isinstance(column, str) else column
    if batch.num_rows == 0:
        return
    text = batch.column(at)
    if text.null_count:
        text = text.fill_null("")
    text = text.cast(pa.large_string())
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None and text.buffers()[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def spans(data: np.ndarray, rows: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the maximal runs of bytes in `table` within each row, and each row's bounds among the runs."""
    word = table[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[rows] = True
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, rows)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, equal for equal bytes anywhere."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=total[1:])
    h = (total[ends] - total[starts]) * powers(_INVERSE, n + 1)[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * _M2))


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of the k consecutive values that start at each position; the last k-1 positions are left out."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, salt(seed + k), np.uint64)
    for j in range(k):
        out *= np.uint64(0xD1342543DE82EF95)
        out += h[j : j + n]
    return mix(out)


def row_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each element, from each row's bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def starts_of_grams(bounds: np.ndarray, k: int) -> np.ndarray:
    """Whether the k elements from each position on are of one row; as long as grams()."""
    row = row_of(bounds)
    n = max(0, len(row) - k + 1)
    return row[:n] == row[k - 1 :]


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of values (or count of true ones) of each row."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def lengths_in_characters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points of each run of bytes."""
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=total[1:])
    return total[ends] - total[starts]
