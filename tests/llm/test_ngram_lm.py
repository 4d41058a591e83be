"""The model against plain counting in dictionaries."""

import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from siftwright.llm import ngram_lm
from siftwright.llm.ngram_lm import DISCOUNT, Rising, Vocabulary, _count_ngrams, _packed, _score, _unpacked, fit, score_texts


def _tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


class Plain:
    def __init__(self, texts):
        self.one, self.two, self.three = Counter(), Counter(), Counter()
        self.after, self.after2 = defaultdict(Counter), defaultdict(Counter)
        for t in map(_tokens, texts):
            self.one.update(t)
            for a, b in zip(t, t[1:]):
                self.after[a][b] += 1
            for a, b, c in zip(t, t[1:], t[2:]):
                self.after2[a, b][c] += 1
        self.n, self.v = sum(self.one.values()), len(self.one)

    def base(self, w):
        return (self.one[w] + 1) / (self.n + self.v + 1)

    def p(self, context, w):
        p = self.base(w)
        for key, table in ((context[-1:], self.after), (context[-2:], self.after2)):
            key = key[0] if table is self.after and key else tuple(key)
            if table is self.after2 and len(context) < 2 or not context or key not in table:
                continue
            total = sum(table[key].values())
            p = max(table[key][w] - DISCOUNT, 0) / total + DISCOUNT * len(table[key]) / total * p
        return p


def _texts(n=120):
    r = random.Random(3)
    made = [" ".join(r.choice(["a", "B", "c", "dd", "eé", "f"]) for _ in range(r.randrange(0, 30))) for _ in range(n)]
    return [*made, None, "", "  \n", "x " * 30_000, "ein anderes wort", made[0], made[0]]


def _pair_in_most_texts():
    return [f"{k % 9} of the {k % 11} of the {k % 4} end" for k in range(160)] + ["of the " * 200]


@pytest.mark.parametrize("texts, shard, blocks", [(_texts(), 1 << 20, None), (_texts(), 5, None), (_pair_in_most_texts(), 1 << 20, 40), (_pair_in_most_texts(), 50, 10)])
def test_scores_are_those_of_plain_counting(spark, monkeypatch, texts, shard, blocks):
    if blocks:  # runs of many blocks are summed in a tree
        monkeypatch.setattr(ngram_lm, "_AT_ONCE", blocks)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(12 if blocks else 4)
    out = {r["doc_id"]: r for r in score_texts(docs, shard=shard, fan=2 if blocks else 1024).collect()}
    assert len(out) == len(rows)
    held = {i for i, _ in rows if crc32(str(i).encode()) % 7 == 2}
    plain = Plain([t for i, t in rows if i not in held])
    for i, t in rows:
        tokens = _tokens(t)
        got = out[i]
        assert got["held_out"] == (i in held)
        assert (got["n_tokens"], got["n_known"], got["train_tokens"]) == (len(tokens), sum(plain.one[w] > 0 for w in tokens), plain.n)
        assert got["base_score"] == pytest.approx(sum(math.log10(plain.base(w)) for w in tokens), rel=1e-9)
        want = sum(math.log10(plain.p(tokens[:k], w)) for k, w in enumerate(tokens))
        assert got["score"] == pytest.approx(want, abs=len(tokens) / 2048)


def test_words_and_ngrams_that_occur_again_are_not_sought_again(spark, monkeypatch):
    texts = _pair_in_most_texts()
    model, _ = fit(spark.createDataFrame([(t,) for t in texts], "text string"), shard=50)
    sought = Counter()
    for kind, name in ((Vocabulary, "ids"), (Rising, "find")):
        monkeypatch.setattr(kind, name, lambda self, x, *a, f=getattr(kind, name), name=name: (sought.update({name: len(x)}), f(self, x, *a))[1])

    def work(step, times):
        sought.clear()
        out = list(step(iter([pa.RecordBatch.from_arrays([pa.array(texts * times)], names=["text"])])))
        return out, dict(sought)

    (once, few), (often, many) = work(_score(model), 1), work(_score(model), 30)
    assert many == few and set(few) == {"ids", "find"}
    assert often[0].column(3).to_pylist() == once[0].column(3).to_pylist() * 30
    count = _count_ngrams(model.folder, model.shards, model.words_files, model.n_words, model.n_tries)
    assert work(count, 30)[1] == work(count, 1)[1]


def test_only_empty_texts(spark):
    rows = score_texts(spark.createDataFrame([(i, None if i % 2 else " ") for i in range(30)], "doc_id long, text string")).collect()
    train = sum(not r.held_out for r in rows)
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in rows} == {(1, 1, train)}
    assert [r.score for r in rows] == pytest.approx([math.log10((train + 1) / (train + 2))] * 30)


@pytest.mark.parametrize("bits", [0.02, 0.5, 0.98])
def test_select_finds_each_bit(bits):
    r = np.random.default_rng(4)
    x = np.cumsum(r.random(5000) > bits)  # rising by one or not at all, so both kinds of bits come in runs
    code = Rising(Rising.encode(x))
    upper = np.unpackbits(code.parts["upper"].view(np.uint8), bitorder="little")
    for bit in (0, 1):
        want = np.flatnonzero(upper == bit)
        assert (code._select(np.arange(len(want)), bit) == want).all()


def test_a_vocabulary_of_over_a_thousand_shards(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(7 * i + k) % 1100}" for k in range(9))) for i in range(170)], "doc_id long, text string")
    few, many = ({r.doc_id: r.score for r in score_texts(docs, shard=s).collect()} for s in (1 << 20, 1))
    assert few == pytest.approx(many)


def test_runs_hold_numbers_of_64_bits():
    pairs, c, n = np.array([5, 7 << 40, 1 << 62]), np.array([-1, 1 << 40, 3]), np.array([1, 1 << 35, 2])
    assert all((x == y).all() for x, y in zip(_unpacked(_packed(pairs, c, n)), (pairs, c, n)))


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert score_texts(empty).count() == 0
    held = next(i for i in range(100) if crc32(str(i).encode()) % 7 == 2)
    (row,) = score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (3, 0, 0, 0.0, 0.0)


@pytest.mark.parametrize("top", [1, 70, 10**6, 10**13])
def test_elias_fano(top):
    x = np.unique(np.random.default_rng(1).integers(0, top, 3000))
    code = Rising(Rising.encode(x))
    assert (code.get(np.arange(len(x))) == x).all()
    whole = np.zeros(len(x), np.int64), np.full(len(x), len(x))
    assert (code.find(x, *whole) == np.arange(len(x))).all()
    absent = np.setdiff1d(np.random.default_rng(2).integers(0, 2 * top, 3000), x)
    assert (code.find(absent, np.zeros(len(absent), np.int64), np.full(len(absent), len(x))) == -1).all()
