"""Sets of shingles as sorted 64-bit numbers, made of whole Arrow columns of text."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

_ROWS = 128  # texts hashed at once, so that their words stay in a core's cache
_FACTOR = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def in_pieces(f: Callable[[pa.Array], pa.Array], column: pa.Array, rows: int = 512) -> pa.Array:
    """f of the whole column, of a few rows at a time, so that little memory is taken besides the result."""
    return pa.concat_arrays([f(column.slice(lo, rows)) for lo in range(0, max(len(column), 1), rows)])


def lists(flat: np.ndarray, many: np.ndarray) -> pa.Array:
    """An array of lists that have so many of the values each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(flat))


def _word_hashes(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of words of data, which has eight more bytes than they need; eight bytes of each word at a time."""
    eight = np.ndarray(len(data) - 7, np.dtype("<u8"), data, strides=(1,))
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    hashes = sizes.astype(np.uint64) * np.uint64(_FACTOR)
    rest = np.flatnonzero(sizes > 0)
    at, left = begins[rest], sizes[rest]
    while len(rest):
        hashes[rest] = mix(hashes[rest] ^ (eight[at] & masks[np.minimum(left, 8)]))
        more = left > 8
        rest, at, left = rest[more], at[more] + 8, left[more] - 8
    return hashes


def _piece(texts: pa.Array, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The sets of a few texts, and how large they are."""
    raw = [(s or "").encode() for s in texts.to_pylist()]
    ends = np.cumsum(np.array([len(r) for r in raw], np.int64))
    begins = np.concatenate([[0], ends])[:-1].astype(np.int64)
    data = np.frombuffer(b"".join(raw) + bytes(8), np.uint8)
    some = ends > begins
    cuts = np.flatnonzero(data[:-8] == 32)
    starts, stops = np.sort(np.concatenate([begins[some], cuts + 1])), np.sort(np.concatenate([cuts, ends[some]]))
    words = _word_hashes(data, starts, stops - starts)
    n = np.where(some, 1, 0) + np.searchsorted(cuts, ends) - np.searchsorted(cuts, begins)
    first = np.cumsum(n) - n
    powers = [np.uint64(pow(_FACTOR, j + 1, 1 << 64)) for j in range(k)]
    whole = len(words) - k + 1
    runs = np.zeros(max(whole, 0), np.uint64)
    for j in range(k if whole > 0 else 0):
        runs += words[j : j + whole] * powers[j]
    runs = mix(runs)
    sets = []
    for b, m in zip(first, n):
        if m >= k:
            x = np.sort(runs[b : b + m - k + 1].view(np.int64))
            x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        else:  # one run of all words; the number of words tells it from longer ones
            x = mix(np.array([sum(int(w) * int(p) for w, p in zip(words[b : b + m], powers)) + int(m) & (1 << 64) - 1], np.uint64)).view(np.int64)[: min(m, 1)]
        sets.append(x)
    return sets, np.array([len(x) for x in sets], np.int64)


def hashed_shingles(plain: Column, k: int) -> Column:
    """``overlap.shingles`` as sorted 64-bit hashes: distinct runs of k words of a normalised text."""

    def of_piece(texts: pa.Array) -> pa.Array:
        sets, sizes = _piece(texts, k)
        return lists(np.concatenate([np.zeros(0, np.int64), *sets]), sizes)

    @F.arrow_udf(ArrayType(LongType()))
    def of_texts(texts: pa.Array) -> pa.Array:
        return in_pieces(of_piece, texts, _ROWS)

    return of_texts(plain)
