"""Words of whole texts in numpy: positions and 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes whose hashes are worked out at once.
PART = 1 << 20
_R = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
_LETTERS = np.array([(i * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) ** 3 % (1 << 64) | 1 for i in range(256)], np.uint64)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = powers(_R, PART + 1), powers(_INVERSE, PART + 1)


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of UTF-8 bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    turns = np.diff(inside)
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes and length. A word longer than PART is hashed in Python."""
    starts, ends = word_bounds(data)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        begin = starts[at]
        to = int(np.searchsorted(ends, begin + PART, side="right"))
        if to <= at:
            out[at] = int.from_bytes(hashlib.blake2b(data[begin : ends[at]].tobytes(), digest_size=8).digest(), "little")
            at += 1
            continue
        part = data[begin : ends[to - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_LETTERS[part] * _UP[: len(part)], out=sums[1:])
        s, e = starts[at:to] - begin, ends[at:to] - begin
        out[at:to] = scramble((sums[e] - sums[s]) * _DOWN[s] + (e - s).astype(np.uint64))
        at = to
    return out


def window_hashes(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A hash of each run of `size` words, by differences of a running sum of powers; seeds give independent ones."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64(pow(0xA0761D6478BD642F, 2 * seed + 1, 1 << 64))
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    out = np.empty(n, np.uint64)
    up, down = powers(base, min(n, PART) + size), powers(inverse, min(n, PART))
    for at in range(0, n, PART):
        m = min(PART, n - at)
        part = scramble(words[at : at + m + size - 1] + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        out[at : at + m] = scramble((sums[size : size + m] - sums[:m]) * down[:m])
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each row's text."""
    data, at = buffers(column)
    for i in range(len(at) - 1):
        yield data[at[i] : at[i + 1]]
