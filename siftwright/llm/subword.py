"""Averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is the mean of the learned vectors of its hashed features: words, pairs of
neighbouring words and byte n-grams, each kind averaged by itself first, so that the many
n-grams don't drown the words. Training works on a bounded, documented sample;
scoring reads whole texts. Because the last layer is linear, a trained model folds into
one table of class scores for each bucket, so scoring is a gather and a sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from siftwright.llm.hashing import LOWER_AZ, column_bytes, mix, pair, words

GRAMS = (3, 4)  # bytes of an n-gram; at most 4, they are packed into 32 bits
KINDS = len(GRAMS) + 2


@dataclass(frozen=True)
class Shape:
    """What a model looks at and how it is trained."""

    buckets_log2: int = 15
    dims: int = 12
    epochs: int = 5
    batch: int = 64
    rate: float = 0.05
    lower: bool = False  # whether A-Z are lower-cased before n-grams are cut
    seed: int = 7


@dataclass
class Model:
    shape: Shape
    classes: list
    table: np.ndarray = field(repr=False)  # buckets x classes
    bias: np.ndarray
    temperature: float = 1.0
    floor: float = 0.0  # calibrated: below it, a prediction is rejected

    def scores(self, column: pa.Array) -> np.ndarray:
        """Class probabilities of each text; a text without features gets the bias alone."""
        data, offsets = column_bytes(column)
        total = np.zeros((len(offsets) - 1, len(self.classes)))
        columns = np.ascontiguousarray(self.table.T)
        for lo, hi in _spans(offsets):
            cut = offsets[lo : hi + 1] - offsets[lo]
            for bucket, owner_ends in _features(data[offsets[lo] : offsets[hi]], cut, self.shape):
                many = np.maximum(np.diff(owner_ends), 1) * KINDS
                for k in range(len(self.classes)):
                    total[lo:hi, k] += _sums(columns[k][bucket], owner_ends) / many
        logits = (total + self.bias) / self.temperature
        return _softmax(logits)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _spans(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes together; a longer text is a run of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive ends."""
    upto = np.zeros(len(values) + 1)
    np.cumsum(values, dtype=np.float64, out=upto[1:])
    return np.diff(upto[ends])


def _features(data: np.ndarray, offsets: np.ndarray, shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature buckets in text order, kind by kind, with the bounds of each text's own."""
    shift32, shift64 = np.uint32(32 - shape.buckets_log2), np.uint64(64 - shape.buckets_log2)
    seen = LOWER_AZ[data] if shape.lower else data
    wide = seen.astype(np.uint32)
    for n in GRAMS:
        if len(wide) < n:
            continue
        code = wide[: len(wide) - n + 1].copy()
        for k in range(1, n):
            code |= wide[k : len(wide) - n + 1 + k] << np.uint32(8 * k)
        bucket = (code * np.uint32(0x9E3779B1) ^ np.uint32(0x85EBCA6B * n & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> shift32
        whole = np.ones(len(code), bool)  # an n-gram lies within one text
        for back in range(1, n):
            at = offsets[1:-1] - back
            whole[at[(at >= 0) & (at < len(code))]] = False
        upto = np.zeros(len(code) + 1, np.int64)
        np.cumsum(whole, out=upto[1:])
        yield bucket[whole], upto[np.minimum(offsets, len(code))]
    hashes, _, _, counts = words(data, offsets)
    ends = np.concatenate([[0], np.cumsum(counts)])
    yield mix(hashes ^ np.uint64(1)) >> shift64, ends
    if len(hashes) > 1:
        twins = pair(hashes[:-1], hashes[1:])
        twins[hashes[:-1] == hashes[1:]] = np.uint64(0)  # a word that follows itself, whichever it is
        within = np.ones(len(twins), bool)
        edge = ends[1:-1] - 1
        within[edge[(edge >= 0) & (edge < len(twins))]] = False
        upto = np.zeros(len(twins) + 1, np.int64)
        np.cumsum(within, out=upto[1:])
        yield (mix(twins) >> shift64)[within], upto[np.minimum(ends, len(twins))]


def _rows(column: pa.Array, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct buckets and their weights in its mean, text after text, and where each text's start.

    They are written into two arrays of the most there can be, which take memory as they are
    filled and give it back; a pair of arrays for each text leaves it in pieces that stay.
    """
    data, offsets = column_bytes(column)
    size = 1 << shape.buckets_log2
    most = int(np.minimum(KINDS * np.diff(offsets), size).sum())
    buckets, weights = np.empty(most, np.int32), np.empty(most, np.float32)
    bounds = np.zeros(len(offsets), np.int64)
    for i in range(len(offsets) - 1):
        own = data[offsets[i] : offsets[i + 1]]
        parts = [b.astype(np.int64) for b, _ in _features(own, np.array([0, len(own)]), shape)]
        weight = sum((np.bincount(b, minlength=size) / (KINDS * max(1, len(b))) for b in parts), np.zeros(size))
        at = np.flatnonzero(weight)
        bounds[i + 1] = bounds[i] + len(at)
        buckets[bounds[i] : bounds[i + 1]] = at
        weights[bounds[i] : bounds[i + 1]] = weight[at]
    return bounds, buckets, weights


def train(texts: pa.Array, labels: list, shape: Shape, calibrate: float = 0.1, accept: float = 0.99) -> Model:
    """Fit by stochastic gradient descent (Adagrad steps) on texts and their labels.

    A share ``calibrate`` of the sample sets the temperature, by likelihood, and the floor
    under which a prediction is rejected: the score that a share ``accept`` of the right
    predictions exceeds. With no labels at all the model has one class, None.
    """
    classes = sorted(set(labels))
    size = 1 << shape.buckets_log2
    if not classes:
        return Model(shape, [None], np.zeros((size, 1), np.float32), np.zeros(1))
    random = np.random.default_rng(shape.seed)
    bounds, buckets, weights = rows = _rows(texts, shape)
    target = np.array([classes.index(x) for x in labels])
    n = len(bounds) - 1
    order = random.permutation(n)
    held = order[: int(calibrate * n)] if n >= 50 else order[:0]
    used = order[len(held) :]
    embed = random.normal(0, 0.1, (size, shape.dims)).astype(np.float32)
    out = random.normal(0, 0.1, (shape.dims, len(classes))).astype(np.float32)
    bias = np.log(np.bincount(target[used], minlength=len(classes)) / len(used) + 1e-9).astype(np.float32)
    steps = [np.full_like(x, 1e-8) for x in (embed, out, bias)]
    for _ in range(shape.epochs):
        random.shuffle(used)
        for lo in range(0, len(used), shape.batch):
            own = used[lo : lo + shape.batch]
            dense = np.zeros((len(own), size), np.float32)
            for r, i in enumerate(own):
                dense[r, buckets[bounds[i] : bounds[i + 1]]] = weights[bounds[i] : bounds[i + 1]]
            mean = dense @ embed
            grad = _softmax(mean @ out + bias).astype(np.float32)
            grad[np.arange(len(own)), target[own]] -= 1
            grad /= len(own)
            for x, g, past in zip((embed, out, bias), (dense.T @ (grad @ out.T), mean.T @ grad, grad.sum(axis=0)), steps, strict=True):
                past += g * g
                x -= shape.rate * g / np.sqrt(past)
    model = Model(shape, classes, embed @ out, bias.astype(np.float64))
    if len(held):
        _calibrate(model, rows, target, held, accept)
    return model


def _calibrate(model: Model, rows: tuple[np.ndarray, np.ndarray, np.ndarray], target: np.ndarray, held: np.ndarray, accept: float) -> None:
    bounds, buckets, weights = rows
    logits = np.array([weights[bounds[i] : bounds[i + 1]] @ model.table[buckets[bounds[i] : bounds[i + 1]]] for i in held]) + model.bias
    truth = target[held]
    model.temperature = min(np.geomspace(0.25, 4, 33), key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(held)), truth] + 1e-12).mean())
    # an intercept for each class, by likelihood; drawn to zero as by two rows, so that few rows move it little
    wanted, shift = np.eye(len(model.classes))[truth], np.zeros(len(model.classes))
    for _ in range(500):
        shift += 0.5 * ((wanted - _softmax(logits / model.temperature + shift)).sum(axis=0) - 2 * shift) / (len(held) + 2)
    model.bias = model.bias + model.temperature * shift
    logits = logits + model.temperature * shift
    best = _softmax(logits / model.temperature)
    right = best.argmax(axis=1) == truth
    if right.any():
        model.floor = float(np.quantile(best.max(axis=1)[right], 1 - accept))
