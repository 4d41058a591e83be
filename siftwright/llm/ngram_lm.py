"""LM scoring: a trigram model in Elias-Fano tries that workers map into memory.

Counting is distributed; what comes of it is files in the shared folder. The vocabulary is
sorted arrays of word hashes, a word's id being its place. The n-grams are dealt to shards
by their first word, those of a frequent one by their second word as well, in sorted packed
runs; a shard is a trie of three levels. Each level is one rising
sequence, context rank times vocabulary plus word id, in Elias-Fano code; the bounds of a
context's words are rising pointers in the same code. Probabilities are quantised to 16
bits of their logarithm. A query finds a word by a successor search within its context.

Smoothing is interpolated absolute discounting: a share of each count goes to the shorter
context, and at last to counts plus one, with one more place for all unknown words. So the
probabilities after any context add up to 1 but for quantisation.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.llm.classify import held_out
from siftwright.llm.hashing import column_bytes, words
from siftwright.llm.workspace import Workspace, unused

DISCOUNT = 0.75
SHARD = 1 << 20  # n-grams, about, in a shard; also words in a vocabulary shard
STEPS = 2048  # codes for each factor of ten
_END = np.int64(0x5EED5EED5EED5EED)
_PAD = -1
_SPAN = 4 << 20  # bytes of text scored at once; a longer text is a span of its own
_AT_ONCE = 1 << 19  # n-grams or words summed in a task before they are dealt out
FAN = 1024  # runs of a shard that are summed at once, about
_MOST_WORDS = 3_037_000_499  # whose square has 63 bits
_PARTS = 16  # a word's n-grams are dealt to as many shards as they would fill times this
_U, _I = np.uint64, np.int64
_ONES, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)  # the lowest and the highest bit of each byte
#: The place of the k-th set bit of a byte, at 8 times the byte plus k.
_IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + 8 * [0])[:8] for byte in range(256)], np.int64).ravel()
_VALUES = 10.0 ** (np.arange(1 << 16) / -STEPS)


class Rising:
    """A non-decreasing sequence of numbers in Elias-Fano code, over arrays of a file."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts, self.n, self.low_bits = parts, int(parts["shape"][0]), int(parts["shape"][1])

    @staticmethod
    def encode(x: np.ndarray) -> dict[str, np.ndarray]:
        n = len(x)
        top = int(x[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits, np.uint8)
        for b in range(bits):
            low[b::bits] = (x >> b) & 1
        upper = np.zeros(-(-(n + (top >> bits) + 2) // 64) * 64, np.uint8)
        upper[(x >> bits) + np.arange(n)] = 1
        packed = np.packbits(upper, bitorder="little").view(np.uint64)
        before = np.zeros(len(packed) + 1, np.int64)
        np.cumsum(np.bitwise_count(packed), out=before[1:])
        low = np.packbits(low, bitorder="little")
        low = np.concatenate([low, np.zeros(8 + -len(low) % 8, np.uint8)])
        return {"shape": np.array([n, bits], np.int64), "low": low.view(np.uint64), "upper": packed, "ones": before, "zeros": 64 * np.arange(len(before)) - before}

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """The place of the k-th bit (from 0) of this kind in the upper half."""
        before = self.parts["ones" if bit else "zeros"]
        word = np.searchsorted(before, k, "right") - 1
        left = (k - before[word]).astype(_U)
        value = self.parts["upper"][word]
        value = value if bit else ~value
        # set bits up to each byte, all bytes of a word at once; then the byte, then the place in it
        upto = value - ((value >> _U(1)) & _U(0x5555555555555555))
        upto = (upto & _U(0x3333333333333333)) + ((upto >> _U(2)) & _U(0x3333333333333333))
        upto = ((upto + (upto >> _U(4))) & (_ONES * _U(15))) * _ONES
        place = _U(8) * np.bitwise_count(((left * _ONES | _TOPS) - upto) & _TOPS).astype(_U)
        left -= ((upto << _U(8)) >> place) & _U(255)
        byte = (value >> place) & _U(255)
        return 64 * word + place.astype(_I) + _IN_BYTE[(byte << _U(3) | left).astype(_I)]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), _I)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(_U)
        low = self.parts["low"]
        out = low.take(word) >> shift
        out |= (low.take(word + 1) << _U(1)) << (_U(63) - shift)
        return (out & _U((1 << self.low_bits) - 1)).astype(_I)

    def _next(self, place: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
        """The first place from these on with this bit, and whether it is in the same word."""
        value = self.parts["upper"][place >> 6]
        value = (value if bit else ~value) >> (place & 63).astype(_U)
        return place + np.bitwise_count((value & (~value + _U(1))) - _U(1)).astype(_I), value != 0

    def _run(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first entry with each upper half, and the one after the last."""
        begin = np.where(h > 0, self._select(np.maximum(h - 1, 0), 0) + 1, 0)
        end, near = self._next(begin, 0)
        if len(far := np.flatnonzero(~near)):
            end[far] = self._select(h[far], 0)
        return begin - h, end - h

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, 1) - i) << self.low_bits) | self._low(i)

    def bounds(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries i and i + 1."""
        place = self._select(i, 1)
        after, near = self._next(place + 1, 1)
        if len(far := np.flatnonzero(~near)):
            after[far] = self._select(i[far] + 1, 1)
        return ((place - i) << self.low_bits) | self._low(i), ((after - i - 1) << self.low_bits) | self._low(i + 1)

    def find(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Where each x is between lo and hi, or -1: a successor search."""
        if not self.n:
            return np.full(len(x), -1, _I)
        high = x >> self.low_bits
        inside = (high < int(self.parts["zeros"][-1])) & (hi > lo)
        h = np.where(inside, high, 0)
        start, stop = self._run(h)
        a, b = np.maximum(start, lo), np.minimum(stop, hi)
        hit, want = inside & (a < b), x & ((1 << self.low_bits) - 1)
        live = np.flatnonzero(hit & (a < b - 1))
        lo, hi, low = a[live], b[live] - 1, want[live]
        while len(live):
            mid = (lo + hi) >> 1
            less = self._low(mid) < low
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            open_ = lo < hi
            a[live[~open_]] = lo[~open_]
            live, lo, hi, low = live[open_], lo[open_], hi[open_], low[open_]
        hit[hit] = self._low(a[hit]) == want[hit]
        return np.where(hit, a, -1)


def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-31)) * STEPS), 0, 65535).astype(np.uint16)


def _value(code: np.ndarray) -> np.ndarray:
    return _VALUES[code]


def _store(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """One file of arrays; the name is new, so a task that runs again harms nothing."""
    store, root = pa.fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    name, at, index = f"{uuid.uuid4().hex}.bin", 0, {}
    with store.open_output_stream(f"{root}/{name}") as f:
        for key, a in arrays.items():
            index[key] = (at, a.dtype.str, len(a))
            f.write(np.ascontiguousarray(a).tobytes())
            at += a.nbytes
            f.write(b"\0" * (-at % 8))
            at += -at % 8
        f.write(json.dumps(index).encode())
        f.write(at.to_bytes(8, "little"))
    return name


def _open(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped; from a store that isn't mounted, a copy without a name is mapped."""
    store, root = pa.fs.FileSystem.from_uri(folder)
    if isinstance(store, pa.fs.LocalFileSystem):
        whole = np.memmap(f"{root}/{name}", np.uint8, "r")
    else:
        with tempfile.TemporaryFile() as copy, store.open_input_stream(f"{root}/{name}") as f:
            while piece := f.read(1 << 20):
                copy.write(piece)
            whole = np.memmap(copy, np.uint8, "r")
    at = int.from_bytes(whole[-8:].tobytes(), "little")
    index = json.loads(whole[at:-8].tobytes())
    return {k: np.asarray(whole[o : o + n * np.dtype(d).itemsize].view(d)) for k, (o, d, n) in index.items()}


def _packed(pairs: np.ndarray, c: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted n-grams with their counts: differences and numbers by byte planes, compressed."""
    planes = [x.view(np.uint8).reshape(len(pairs), -1).T.tobytes() for x in (np.diff(pairs, prepend=0), c, n)]
    return len(pairs).to_bytes(8, "little") + pa.compress(b"".join(planes), "zstd", asbytes=True)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8:], 24 * m, "zstd"), np.uint8)
    read = lambda lo, kind: np.ascontiguousarray(planes[lo * m : (lo + np.dtype(kind).itemsize) * m].reshape(-1, m).T).view(kind).ravel()
    return np.cumsum(read(0, _I)), read(8, _I), read(16, _I)


class Vocabulary:
    def __init__(self, folder: str, shards: list[tuple[int, int]], files: list[str | None]):
        self.starts = np.array([s for s, _ in shards], _I)
        self.parts = [None if f is None else _open(folder, f) for f in files]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, _I)
        which = hashes & (len(self.parts) - 1)
        for s, part in enumerate(self.parts):
            if part is None or not len(at := np.flatnonzero(which == s)):
                continue
            keys = part["keys"]
            i = np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)
            out[at] = np.where(keys[i] == hashes[at], self.starts[s] + i, -1)
        return out

    def ranked(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the distinct tokens, rising; each token's place among them); each is sought once, unknown ones are -1 and first."""
        distinct, at = np.unique(tokens, return_inverse=True)
        ids = self.ids(distinct)
        order = np.argsort(ids)
        rank = np.empty(len(ids), _I)
        rank[order] = np.arange(len(ids))
        return ids[order], rank[at]

    def read(self, ids: np.ndarray, key: str, missing: int = 0) -> np.ndarray:
        out = np.full(len(ids), missing, _I)
        which = np.searchsorted(self.starts, ids, "right") - 1
        for s, part in enumerate(self.parts):
            if part is not None and len(at := np.flatnonzero((which == s) & (ids >= 0))):
                out[at] = part[key][ids[at] - self.starts[s]]
        return out


def _spans(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text, tokens with ends, tokens of each text), some texts at a time."""
    data, offsets = column_bytes(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _SPAN, "right")) - 1)
        hashes, _, _, counts = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        counts = np.asarray(counts, _I)
        counts = counts if len(counts) == hi - lo else np.zeros(hi - lo, _I)
        tokens = np.insert(hashes.astype(_U).view(_I), np.cumsum(counts), _END)
        yield lo, hi, tokens, counts + 1
        lo = hi


def _counted(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(tokens, return_counts=True)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def merged() -> pa.RecordBatch:
        w, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        n = np.bincount(at, np.concatenate([y for _, y in held])).astype(_I)
        held[:] = [(w, n)]
        return pa.RecordBatch.from_arrays([pa.array(w), pa.array(n)], names=["w", "n"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for _, _, tokens, _ in _spans(batch.column(0)):
            held.append(_counted(tokens))
            if sum(len(w) for w, _ in held) > _AT_ONCE:
                out = merged()
                if out.num_rows > _AT_ONCE // 2:
                    yield out
                    held = []
    if held:
        yield merged()


def _store_words(folder: str):
    def store(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("w").to_numpy())
        keys = table.column("w").to_numpy()[order]
        name = _store(folder, {"keys": keys, "counts": table.column("n").to_numpy()[order]})
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "file": [name], "size": pa.array([len(keys)], pa.int64())})

    return store


def _by_shard(shard: np.ndarray, n: int) -> np.ndarray:
    """The order of the shards, of n at most, that leaves a shard's own order."""
    return np.argsort(shard.astype(np.uint16) if n <= 1 << 16 else shard, kind="stable")


def _summed(pieces: list[tuple[np.ndarray, int]], vocabulary: Vocabulary, size: int, n_tries: int) -> pa.RecordBatch:
    """Each n-gram of these pieces of tokens once, with its count, packed for each shard; a piece says how many of its tokens begin one."""
    tokens = np.concatenate([t for t, _ in pieces])
    ids, word = vocabulary.ranked(tokens)
    seen = vocabulary.read(ids, "counts")
    whole = np.concatenate([np.arange(len(t)) < begun for t, begun in pieces]) & (tokens != _END)
    # ranks of words from 1 on, 0 for none; a block has at most 2^20 words and a few, so that three have 63 bits
    m, a = len(ids) + 1, np.flatnonzero(whole)
    word += 1
    b = word[a + 1]
    c = np.where(tokens[a + 1] == _END, 0, np.append(word, 0)[a + 2])
    grams = np.sort((word[a] * m + b) * m + c)
    new = _firsts(grams)
    n = np.diff(np.append(new, len(grams)))
    pairs, c = np.divmod(grams[new], m)
    a, b = np.divmod(pairs, m)
    a, b, c, seen = ids[a - 1], ids[b - 1], np.append(_PAD, ids)[c], seen[a - 1]
    shard, pairs = shard_of(a, b, seen, n_tries), a * size + b
    order = _by_shard(shard, n_tries)
    shard, pairs, c, n = shard[order], pairs[order], c[order], n[order]
    begin = _firsts(shard)
    blobs = [_packed(pairs[lo:hi], c[lo:hi], n[lo:hi]) for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(shard)][: len(begin)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(shard[begin].astype(np.int32)), pa.array(blobs, pa.binary())], names=["shard", "grams"])


def _count_ngrams(folder: str, shards: list, files: list, size: int, n_tries: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(folder, shards, files)
        waiting, held = [], 0
        for batch in batches:
            for _, _, tokens, _ in _spans(batch.column(0)):
                for lo in range(0, len(tokens), _AT_ONCE):
                    piece = tokens[lo : lo + _AT_ONCE + 2]
                    waiting.append((piece, _AT_ONCE))
                    held += min(len(piece), _AT_ONCE)
                    if held >= _AT_ONCE:
                        yield _summed(waiting, vocabulary, size, n_tries)
                        waiting, held = [], 0
        if held:
            yield _summed(waiting, vocabulary, size, n_tries)

    return count


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys begin to differ from what is before."""
    differ = np.zeros(len(keys[0]), bool)
    differ[:1] = True
    for k in keys:
        differ[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(differ)


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of some runs of a shard, sorted, each once, with their counts."""
    pairs, c, n = (np.concatenate(x) for x in zip(*map(_unpacked, table.column("grams").to_pylist()), strict=True))
    # a pair's rank and a third word have 63 bits, as a shard has far fewer pairs than 2^31 and c is below 2^32 - 1
    distinct, rank = np.unique(pairs, return_inverse=True)
    grams = (rank << 32) + (c + 1)
    order = np.argsort(grams)
    grams, n = grams[order], n[order]
    new = _firsts(grams)
    grams = grams[new]
    return distinct[grams >> 32], (grams & 0xFFFFFFFF) - 1, np.add.reduceat(n, new)


def _sum_runs(key: tuple, table: pa.Table) -> pa.Table:
    """Some runs of a shard as one."""
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "grams": pa.array([_packed(*_merged(table))], pa.binary())})


def _store_trie(folder: str, size: int, words_folder: str, shards: list, files: list):
    def store(key: tuple, table: pa.Table) -> pa.Table:
        pairs, c, n = _merged(table)
        a, b = np.divmod(pairs, size)
        two = _firsts(pairs)
        one = _firsts(a[two])
        pairs = np.add.reduceat(n, two)
        rank1 = np.repeat(np.arange(len(one)), np.diff(np.append(one, len(two))))
        rank2 = np.repeat(np.arange(len(two)), np.diff(np.append(two, len(a))))
        real = c != _PAD
        kinds = np.bincount(rank2[real], minlength=len(two))
        seen = Vocabulary(words_folder, shards, files).read(a[two], "counts")
        levels = {
            "one": a[two][one],
            "two": rank1 * size + b[two],
            "three": rank2[real] * size + c[real],
            "to_two": np.append(one, len(two)),
            "to_three": np.append(0, np.cumsum(kinds)),
        }
        arrays = {f"{k}.{p}": v for k, x in levels.items() for p, v in Rising.encode(x.astype(_I)).items()}
        arrays["two.p"] = quantise((pairs - DISCOUNT) / seen)
        arrays["two.rest"] = quantise(np.where(kinds > 0, DISCOUNT * kinds / pairs, 1.0))
        arrays["three.p"] = quantise((n[real] - DISCOUNT) / pairs[rank2[real]])
        name = _store(folder, arrays)
        n_one, w = len(one), a[two][one]
        v = np.searchsorted([start for start, _ in shards], w, "right") - 1  # the part of the vocabulary that has the word
        return pa.table({"shard": pa.array([key[0].as_py()] * n_one, pa.int32()), "file": [name] * n_one, "w": pa.array(w), "v": pa.array(v.astype(np.int32)), "kinds": pa.array(np.diff(np.append(one, len(two))), pa.int64())})

    return store


def _store_kinds(folder: str, shards: list):
    def store(key: tuple, table: pa.Table) -> pa.Table:
        start, size = shards[key[0].as_py()]
        kinds = np.zeros(size, np.int64)
        kinds[table.column("w").to_numpy() - start] = table.column("kinds").to_numpy()
        return pa.table({"v": pa.array([key[0].as_py()], pa.int32()), "file": [_store(folder, {"kinds": kinds})]})

    return store


class Model:
    """The files of a fitted model; a worker opens them once."""

    def __init__(self, folder: str, shards: list, words_files: list, kinds_files: list, tries: dict[int, str], n_tries: int, n_words: int, n_tokens: int):
        self.folder, self.shards, self.words_files, self.kinds_files = folder, shards, words_files, kinds_files
        self.tries, self.n_tries, self.n_words, self.n_tokens = tries, n_tries, n_words, n_tokens

    def open(self) -> Scorer:
        return Scorer(self)


def shard_of(a: np.ndarray, b: np.ndarray, seen: np.ndarray, n: int) -> np.ndarray:
    """The shard of a pair of words, of which the first is ``seen`` times in all: one for most words."""
    spread = 1 + seen * _PARTS // SHARD
    return ((a * 40503 >> 4) + (b * 7919 >> 2) % spread * 104729) % n


class Scorer:
    def __init__(self, model: Model):
        self.m = model
        self.vocabulary = Vocabulary(model.folder, model.shards, model.words_files)
        self.kinds = Vocabulary(model.folder, model.shards, model.kinds_files)
        self._tries: dict[int, tuple] = {}

    def _trie(self, s: int) -> tuple | None:
        if s not in self._tries:
            if s not in self.m.tries:
                self._tries[s] = None
            else:
                parts = _open(self.m.folder, self.m.tries[s])
                level = lambda k: Rising({p[len(k) + 1 :]: v for p, v in parts.items() if p.startswith(k + ".")})
                self._tries[s] = (*(level(k) for k in ("one", "two", "three", "to_two", "to_three")), parts["two.p"], parts["two.rest"], parts["three.p"])
        return self._tries[s]

    def log10(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 of p, log10 of the base, known) of each token; a word, pair or n-gram is sought once, in the order of the files."""
        n, m = len(tokens), self.m
        ids, word = self.vocabulary.ranked(tokens)
        seen, kinds = self.vocabulary.read(ids, "counts"), self.kinds.read(ids, "kinds")
        base = (seen + 1) / (m.n_tokens + m.n_words + 1)
        left = np.where(seen > 0, DISCOUNT * kinds / np.maximum(seen, 1), 1.0)  # of a context of this word, for shorter ones
        first = np.zeros(n, bool)
        first[np.cumsum(counts) - counts] = True
        p = base[word]
        p[1:] *= np.where(first[1:], 1.0, left[word[:-1]])
        known = seen > 0
        follows = known[word]
        follows[1:] &= follows[:-1]
        follows &= ~first
        paired = np.flatnonzero(follows)
        prior_rest, prior_more = np.ones(n + 1), np.zeros(n + 1)
        if len(paired):
            pairs, pair = np.unique(word[paired - 1] * len(ids) + word[paired], return_inverse=True)
            x, y = np.divmod(pairs, len(ids))
            shard = shard_of(ids[x], ids[y], seen[x], m.n_tries)
            order = _by_shard(shard, m.n_tries)
            x, y, shard = x[order], y[order], shard[order]
            place = np.empty(len(order), _I)
            place[order] = np.arange(len(order))
            pair = place[pair]
            own, rest, b, begin, end = self._pairs(ids, x, y, shard)
            p[paired] += own[pair]
            prior_rest[paired + 1] = rest[pair]
            # the words after pairs that have some
            on = np.flatnonzero(follows[np.minimum(paired + 1, n - 1)] & (paired + 1 < n) & (begin < end)[pair])
            if len(on):
                grams, gram = np.unique(pair[on] * len(ids) + word[paired[on] + 1], return_inverse=True)
                k, z = np.divmod(grams, len(ids))
                prior_more[paired[on] + 1] = self._thirds(b[k], ids[z], begin[k], end[k], shard[k])[gram]
        prior_rest, prior_more = prior_rest[:-1], prior_more[:-1]
        prior_rest[first], prior_more[first] = 1.0, 0.0
        return np.log10(prior_more + prior_rest * p), np.log10(base)[word], known[word]

    def _by_trie(self, shard: np.ndarray) -> Iterator[tuple[slice, tuple]]:
        starts = _firsts(shard)
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(shard)], strict=True):
            if (trie := self._trie(int(shard[lo]))) is not None:
                yield slice(lo, hi), trie

    def _pairs(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, ...]:
        """(own share, rest, place in the trie, first and end of the words after it) of sorted pairs of words; an absent one has no own share and all rest."""
        n = len(x)
        own, rest, place, begin, end = np.zeros(n), np.ones(n), np.zeros(n, _I), np.zeros(n, _I), np.zeros(n, _I)
        for of, (one, two, _, to_two, to_three, two_p, two_rest, _) in self._by_trie(shard):
            new = _firsts(x[of])
            times = np.diff(np.append(new, of.stop - of.start))
            w = ids[x[of][new]]
            a = one.find(w, np.zeros(len(w), _I), np.full(len(w), one.n, _I))
            have = a >= 0
            if not have.any():
                continue
            at = of.start + np.flatnonzero(np.repeat(have, times))
            a, times = a[have], times[have]
            a, lo, hi = (np.repeat(v, times) for v in (a, *to_two.bounds(a)))
            b = two.find(a * self.m.n_words + ids[y[at]], lo, hi)
            at, b = at[b >= 0], b[b >= 0]
            if len(at):
                own[at], rest[at], place[at] = _value(two_p[b]), _value(two_rest[b]), b
                begin[at], end[at] = to_three.bounds(b)
        return own, rest, place, begin, end

    def _thirds(self, place: np.ndarray, z: np.ndarray, begin: np.ndarray, end: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """The own share of sorted n-grams: a pair's place in its trie, and a third word."""
        more = np.zeros(len(z))
        for of, (_, _, three, _, _, _, _, three_p) in self._by_trie(shard):
            c = three.find(place[of] * self.m.n_words + z[of], begin[of], end[of])
            hit = np.flatnonzero(c >= 0)
            more[of.start + hit] = _value(three_p[c[hit]])
        return more


def fit(docs: DataFrame, shard: int = SHARD, fan: int = FAN) -> tuple[Model, Workspace]:
    """A model of the texts of all rows of docs; a null text counts as an empty one."""
    work = Workspace(docs.sparkSession, "ngram-lm")
    folder = work.store_path("files")
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counted = work.write(texts.mapInArrow(_count_words, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "words")
    size, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_parts = 1 << max(0, (size // shard).bit_length())
    by_part = counted.withColumn("shard", F.col("w").bitwiseAND(F.lit(n_parts - 1)).cast("int")).groupBy("shard")
    listed = {r["shard"]: (r["file"], r["size"]) for r in work.write(by_part.applyInArrow(_store_words(folder), "shard int, file string, size long"), "word-files").collect()}
    shards, at = [], 0
    for s in range(n_parts):
        shards.append((at, listed.get(s, (None, 0))[1]))
        at += shards[-1][1]
    files = [listed.get(s, (None, 0))[0] for s in range(n_parts)]
    # no more n-grams than tokens; dealt by shard once, for the sums and the tries alike
    n_tries = max(1, -(-int(total) // shard))
    if size > _MOST_WORDS:
        raise OverflowError(f"{size} distinct words; a pair of words is a number of 64 bits")
    runs = texts.mapInArrow(_count_ngrams(folder, shards, files, size, n_tries), "shard int, grams binary")
    # a frequent pair has a run from almost every block of tokens: they are summed in a tree
    left = int(total) // _AT_ONCE
    while left > fan:
        runs = runs.groupBy("shard", F.pmod(F.xxhash64("grams"), F.lit(-(-left // fan)))).applyInArrow(_sum_runs, "shard int, grams binary")
        left = -(-left // fan)
    built = work.write(runs.groupBy("shard").applyInArrow(_store_trie(folder, size, folder, shards, files), "shard int, file string, w long, v int, kinds long"), "trie-files")
    names = {r["shard"]: r["file"] for r in built.select("shard", "file").distinct().collect()}
    kinds = built.groupBy("v", "w").agg(F.sum("kinds").alias("kinds")).groupBy("v").applyInArrow(_store_kinds(folder, shards), "v int, file string")
    kept = {r["v"]: r["file"] for r in work.write(kinds, "kinds-files").collect()}
    return Model(folder, shards, files, [kept.get(s) for s in range(n_parts)], names, n_tries, size, int(total)), work


def _score(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.open()
        for batch in batches:
            n = batch.num_rows
            many, known, base, whole = np.zeros(n, _I), np.zeros(n, _I), np.zeros(n), np.zeros(n)
            for lo, hi, tokens, counts in _spans(batch.column(batch.num_columns - 1)):
                p, q, seen = scorer.log10(tokens, counts)
                at = np.cumsum(counts) - counts
                many[lo:hi] = counts
                known[lo:hi] = np.add.reduceat(seen.astype(_I), at)
                base[lo:hi], whole[lo:hi] = np.add.reduceat(q, at), np.add.reduceat(p, at)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(many), pa.array(known), pa.array(base), pa.array(whole)], names=[*batch.schema.names[:-1], "n_tokens", "n_known", "base_score", "score"])

    return score


def score_texts(docs: DataFrame, keep: list[str] | None = None, shard: int = SHARD, fan: int = FAN) -> DataFrame:
    """``docs``' columns ``keep`` (default: all but the text) with the scores of their texts.

    Learned from rows that are not held out (crc32 of doc_id mod 7 is not 2). Tokens are
    the words, A-Z lower-cased, and one end. Added: held_out, n_tokens, n_known (those seen
    in training), train_tokens, base_score (unigrams plus one) and score, the model's log10
    probability of the text.

    Defined results: a null or empty text is its end alone; a row without doc_id is learned
    from; repeated rows are learned and scored each; with nothing to learn from every token
    is unknown with probability 1; an empty table gives no rows; texts are read whole; input
    columns named as the results are replaced.
    """
    own = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in (*own, "text")]
    out = held_out(F.col("doc_id"), 7)
    model, _ = fit(docs.where(~out), shard, fan)
    rows = docs.select(*keep, out.alias("held_out"), F.col("text").cast("string").alias(unused(docs, "__text")))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "n_tokens long, n_known long, base_score double, score double"])
    return rows.mapInArrow(_score(model), schema).withColumn("train_tokens", F.lit(model.n_tokens).cast("long"))
