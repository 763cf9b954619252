"""Vector helpers on the bytes of a batch of texts, used inside Arrow functions.

A batch of texts is one byte array with the start and end of each text. All hashes are 64 bits
and depend on the bytes alone, so tasks and runs agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_STEP = 0xD1342543DE82EF95
_INVERSE = pow(_STEP, -1, 1 << 64)
#: A random 64-bit value for each byte value; fixed by its seed.
BYTE_VALUES = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=_U)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of texts worked on at a time; one longer text is a slice of its own.
SLICE = 1 << 19

_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash step and of its inverse, at least ``n + 1`` of each."""
    if len(_powers[0]) <= n:
        size = max(n + 1, SLICE + 1024)
        for k, step in enumerate((_STEP, _INVERSE)):
            p = np.full(size, _U(step))
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums S with S[j] - S[i] the hash of values i to j, times the power of i."""
    out = np.empty(len(values) + 1, _U)
    out[0] = 0
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ranges, equal for equal contents of equal length."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(_U))


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each text (one more at the end)."""
    n = len(buf)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~IS_SPACE[buf]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z as a-z, and the number of words before each text."""
    starts, ends, before = words(buf, offsets)
    return range_hash(prefix_sums(BYTE_VALUES[LOWER[buf]]), starts, ends), before


def shingle_sets(hashes: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of ``width`` words of each text as sorted hashes, and their offsets.

    A text of fewer words has its whole sequence as its one element; one without words has none.
    """
    counts = np.diff(before)
    runs = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    sums = prefix_sums(hashes)
    owner = np.repeat(np.arange(len(counts)), runs)
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(runs, out=at[1:])
    starts = before[:-1][owner] + np.arange(at[-1]) - at[:-1][owner]
    found = range_hash(sums, starts, np.minimum(starts + width, before[1:][owner]))
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[new], owner[new]
    return found, np.searchsorted(owner, np.arange(len(counts) + 1))
