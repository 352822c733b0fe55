"""Vectorised word hashing over Arrow batches.

The kernels here see one Arrow batch at a time, cut it into runs of rows of
about a megabyte of text, and work on the flat UTF-8 buffer with numpy: no
Python loop per word. Null texts are empty texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step handles; longer single texts are handled alone.
STEP_BYTES = 1 << 20


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return splitmix(splitmix(np.arange(n, dtype=np.uint64) + np.uint64(salt) * np.uint64(1 << 32)))


def alnum_table() -> np.ndarray:
    """Byte table: lower-cased word bytes (digits, letters, non-ASCII), 0 elsewhere."""
    t = np.zeros(256, np.uint8)
    for b in range(256):
        c = b + 32 if 65 <= b <= 90 else b
        t[b] = c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0
    return t


def space_table() -> np.ndarray:
    """Byte table: lower-cased bytes, 0 for space and \\t to \\r. NUL becomes 1, which no other byte maps to."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[[32, 9, 10, 11, 12, 13]] = 0
    values = t.astype(np.uint16)
    values[0] = 256
    return values


ALNUM, SPACE = alnum_table(), space_table()
#: For ``bytes.translate``: what ``ALNUM`` maps, other bytes to a space.
ALNUM_TRANSLATE = bytes(int(c) or 32 for c in ALNUM)
#: For ``bytes.translate``: A to Z lower-cased.
LOWER_TRANSLATE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Longer spans are hashed one by one by a cryptographic function.
LONG_SPAN = 32


class SpanHash:
    """Hashes of many spans of one sequence of symbols, by polynomials modulo 2**64 over random symbol values.

    A polynomial of many terms has equal values for certain different spans,
    whatever its numbers are, so spans of more than ``LONG_SPAN`` symbols go
    through BLAKE2. Who needs equality of spans compares the spans as well.
    """

    def __init__(self, symbols: int, salt: int) -> None:
        self.values = seeds(symbols, salt)
        self.base = int(seeds(1, salt + 1)[0]) | 1
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers 0 to n-1 of the base and of its inverse; kept for the steps of normal size."""
        if len(self.up) >= n:
            return self.up, self.down
        out = []
        for base in (self.base, pow(self.base, -1, 1 << 64)):
            p = np.full(n, np.uint64(base))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if n <= 2 * STEP_BYTES:
            self.up, self.down = out
        return out[0], out[1]

    def sums(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of the polynomial's terms, and the powers that take a term back to place 0."""
        up, down = self.powers(len(symbols) + 1)
        total = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(self.values[symbols] * up[: len(symbols)], out=total[1:])
        return total, down

    def __call__(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total, down = self.sums(symbols)
        out = splitmix((total[ends] - total[starts]) * down[starts])
        for i in np.flatnonzero(ends - starts > LONG_SPAN).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(symbols[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        return out


BYTE_HASH = SpanHash(257, 11)


def runs(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into (rows, text bytes, offsets) of about ``STEP_BYTES`` of text each; null texts are empty."""
    texts = batch.column(column)
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    raw = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = raw[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + STEP_BYTES, "right")) - 1)
        end = min(end, row + 20_000)
        at = offsets[row : end + 1]
        yield batch.slice(row, end - row), data[at[0] : at[-1]], at - at[0]
        row = end


def spans(classes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of one nonzero class; runs do not reach over rows."""
    n = len(classes)
    inside = classes != 0
    starts, ends = inside.copy(), inside.copy()
    change = classes[1:] != classes[:-1]
    starts[1:] &= change
    ends[:-1] &= change
    cut = offsets[:-1][offsets[:-1] < n]
    starts[cut] = inside[cut]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each row's words start (one entry more than rows)."""
    low = table[data]
    starts, ends = spans(low != 0, offsets)
    return BYTE_HASH(low, starts, ends), np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive words, across rows too; the caller drops those."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j, odd in enumerate(seeds(k, 13) | np.uint64(1)):
        total += hashes[j : j + n] * odd
    return splitmix(total)
