"""Whole Arrow columns of text as numpy bytes, and hashes of their words.

Everything here works on bytes: white space and the letters A-Z are ASCII, so words and
the lower-casing of A-Z come out as they would on characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19  # bytes hashed at once; a piece ends between words
LONG_WORD = 256  # bytes; sums of powers can't tell some longer words apart, so those get a digest
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}

LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if not len(column) or ends is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes in column ``text``; a longer text is a run of its own."""
    _, offsets = column_bytes(batch.column(text))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: (hash, start, end) of each, and how many each text has.

    A hash depends on the word's bytes alone, after A-Z are lower-cased if asked for.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets) - 1, np.int64)
    inner = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins = inner.copy()
    begins[1:] &= ~inner[:-1] | first[1:n]
    ends = inner.copy()
    ends[:-1] &= ~inner[1:] | first[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + PIECE, "right")))
        a, b = int(start[lo]), int(end[hi - 1])
        piece = data[a:b]
        if lower:
            piece = LOWER_AZ[piece]
        up, down = _powers(max(PIECE, b - a) + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: b - a], out=sums[1:])
        s, e = start[lo:hi] - a, end[lo:hi] - a
        hashes[lo:hi] = (sums[e] - sums[s]) * down[s]
        lo = hi
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        word = data[start[i] : end[i]]
        hashes[i] = int.from_bytes(hashlib.blake2b((LOWER_AZ[word] if lower else word).tobytes(), digest_size=8).digest(), "little")
    upto = np.searchsorted(start, offsets)
    return mix(hashes), start, end, np.diff(upto)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in this order."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)
