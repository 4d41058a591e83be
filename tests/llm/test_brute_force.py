"""Decontamination, the Jaccard join, the classifiers and the pipeline against plain Python."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwright.llm import mixing, ngram_join
from siftwright.llm.classify import fit_language, fit_quality, identify_language, score_quality
from siftwright.llm.decontaminate import drop_contaminated, find_contamination
from siftwright.llm.ngram_join import jaccard_components, keep_one_of_each
from siftwright.llm.subword import Model, Shape
from tests.llm.test_lines_tokens import _plain as _without_runs


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _bench_words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text)) if w]


def _contamination(text, items):
    words, hit, ids = _bench_words(text), set(), set()
    for item, said in items:
        own = _bench_words(said)
        n = min(13, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == own[k : k + n]:
                    hit.update(range(at, at + n))
                    ids.update([str(item)] if item is not None else [])
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def test_contamination_is_that_of_plain_comparison(spark):
    r = random.Random(4)
    word = lambda: r.choice(["Alpha", "b", "ΣΑΣ", "ü", "x1", "dd"])
    items = [(n, " ".join(f"{word()}{n}_{k}" for k in range(n))) for n in range(1, 16)] + [(20, None), (21, ""), (22, "..."), (None, "nobody knows this"), (5, "a second text of item five"), (30, "b b")]
    rows = []
    for d in range(60):
        told = [t for _, t in r.sample(items, 2) if t]
        filler = [" ".join(word() for _ in range(r.randrange(0, 60))) for _ in range(3)]
        parts = [filler[0], *(x for t, f in zip(told, filler[1:]) for x in (t.upper() if d % 3 == 0 else t.replace(" ", ", "), f))]
        rows.append((d // 2 * 2 if d % 10 == 1 else d, r.choice([" ", ". ", "\n"]).join(parts), 1))
    rows += [(100, None, 1), (101, "", 2), (102, "b " * 20_000, 3), (None, items[4][1], 4), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id int, text string, doc_id string")
    got = find_contamination(docs, bench).collect()
    want = Counter((i, *_contamination(t, items)) for i, t, _ in rows)
    assert Counter((x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in got) == want
    kept = Counter(x.doc_id for x in drop_contaminated(docs, bench).collect())
    assert kept == Counter(i for i, t, _ in rows if not _contamination(t, items)[4]) and kept
    assert find_contamination(docs.limit(0), bench).count() == 0
    assert not any(x.contaminated for x in find_contamination(docs, bench.limit(0)).collect())


def _shingles(text, k):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", _lower(text)) if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def _components(rows, percent, k):
    sets = [(i, _shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return Counter((i, len(s), find(i)) for i, s in sets)


def _families(seed):
    """Near copies around a common text, a shingle in hundreds of texts, short, empty and repeated ones."""
    r = random.Random(seed)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for d in range(120):
        own = list(base)
        for _ in range(r.randrange(0, 4)):
            own[r.randrange(60)] = f"v{r.randrange(40)}"
        rows.append(" ".join(own))
    rows += [f"one very common line {d} " + " ".join(f"u{d // 2}_{k + (d % 2) * r.randrange(2)}" for k in range(12)) for d in range(150)]
    rows += ["a b", "A  b", "a", "a b c", "", None, " \n", "q " * 5000, "q " * 4000, "q " * 5000]
    r.shuffle(rows)
    return list(enumerate(rows, 10))


@pytest.mark.parametrize(("percent", "size", "crowd", "tile"), [(90, 3, 32, 512), (80, 5, 4, 16), (90, 3, 2, 7)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, percent, size, crowd, tile):
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rows = _families(size)
    docs = spark.createDataFrame([(i, t, i, 0) for i, t in rows], "doc_id long, text string, owner long, n int").repartition(3)
    want = _components(rows, percent, size)
    assert len({c for _, _, c in want}) < len(rows) - 60
    got = jaccard_components(docs, percent, size).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == want
    if size == 3:
        return
    again = docs.unionByName(docs.limit(1).selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "owner", "n"))
    kept = keep_one_of_each(again, percent, size)
    assert kept.columns == docs.columns
    stay = Counter(i for i, _, c in want.elements() if i == c)
    assert Counter(x.doc_id for x in kept.collect()) == stay + Counter([None])


def test_near_copies_of_empty_tables_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (1, "other words of the same id")], "doc_id long, text string")
    assert Counter((x.doc_id, x.component_id) for x in jaccard_components(docs).collect()) == Counter({(1, 1): 3, (2, 1): 1})
    assert sorted(x.text for x in keep_one_of_each(docs).collect()) == ["a b c d e f", "other words of the same id"]
    assert jaccard_components(docs.limit(0)).count() == 0 and keep_one_of_each(docs.limit(0)).count() == 0


SF = "/root/testdata/sf0.1"


def _held(i, parts=4):
    return crc32(str(i).encode()) % parts == 2


def test_quality_is_learned(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality")
    got = score_quality(rows, fit_quality(docs, labels), keep=["doc_id", "quality"]).collect()
    assert all(x.held_out == _held(x.doc_id) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got)
    out = [x for x in got if x.held_out]
    assert sum(x.predicted == x.quality for x in out) >= 0.97 * len(out)
    good, bad = ([x.score for x in out if x.quality == q] for q in (1, 0))
    assert sum(a > b for a in good for b in bad) >= 0.99 * len(good) * len(bad)


def test_language_is_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [x for x in identify_language(docs, fit_language(docs), keep=["doc_id", "lang"]).collect() if x.held_out]
    assert sum(x.lang_pred == x.lang for x in out) >= 0.98 * len(out)
    sure = [x for x in out if not x.rejected]
    assert len(sure) >= 0.9 * len(out)


_M64 = (1 << 64) - 1


def _mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) & _M64
    return x ^ (x >> 31)


def _word_hash(word):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in word)
    if len(word) > 256:
        return _mixed(int.from_bytes(hashlib.blake2b(low, digest_size=8).digest(), "little"))
    return _mixed(sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(low)) & _M64)


def _buckets(text, log2, lower):
    """The features of a text, kind by kind, one at a time."""
    data = text.encode()
    seen = bytes(b + 32 if lower and 65 <= b <= 90 else b for b in data)
    for n in (3, 4):
        codes = [int.from_bytes(seen[k : k + n], "little") for k in range(len(seen) - n + 1)]
        yield [((((c * 0x9E3779B1) & 0xFFFFFFFF) ^ (0x85EBCA6B * n & 0xFFFFFFFF)) * 0xC2B2AE35 & 0xFFFFFFFF) >> (32 - log2) for c in codes]
    hashes = [_word_hash(w) for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    yield [_mixed(h ^ 1) >> (64 - log2) for h in hashes]
    yield [_mixed(0 if a == b else _mixed((a * 0xD6E8FEB86659FD93 + b) & _M64)) >> (64 - log2) for a, b in zip(hashes, hashes[1:])]


@pytest.mark.parametrize("lower", [False, True])
def test_scores_are_those_of_a_plain_loop(lower):
    r = np.random.default_rng(8)
    shape = Shape(buckets_log2=9, lower=lower)
    model = Model(shape, ["a", "b", "c"], r.normal(size=(512, 3)).astype(np.float32), r.normal(size=3), temperature=0.7)
    texts = ["Some WORDS here, here here", "", None, "ü", "ab", "  \n", "é" * 5000, "W" * 300 + " w", "x y " * 3000, "last Text"]
    got = model.scores(pa.array(texts))
    for own, text in zip(got, texts):
        logits = np.array(model.bias, np.float64)
        for kind in _buckets(text or "", 9, lower):
            for bucket in kind:
                logits += model.table[bucket].astype(np.float64) / (4 * len(kind))
        want = np.exp(logits / 0.7) / np.exp(logits / 0.7).sum()
        assert own == pytest.approx(want, abs=1e-9)


def test_classifiers_on_awkward_rows(spark):
    rows = [(i, "good words here" if i % 2 else "BAD 123", ["de", "en"][i % 2], 0.5, True) for i in range(40)] + [(100, None, "de", 0.0, False), (101, "", "en", 0.0, False), (102, "12 34", None, 0.0, False), (103, "x" * 300_000, "en", 0.0, False), (103, "x", "en", 0.0, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, held_out boolean")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(0, None), (None, 1), (1, 7)], "doc_id long, quality int")
    got = score_quality(docs, fit_quality(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    assert {x.score for x in score_quality(docs, fit_quality(docs, labels.limit(0))).collect()} == {0.5}
    assert {x.score for x in score_quality(docs, fit_quality(docs, labels.where("quality = 0"))).collect()} == {0.0}
    said = {x.doc_id: x.lang_pred for x in identify_language(docs, fit_language(docs)).collect()}
    assert (said[100], said[101], said[102]) == ("und", "und", "und") and set(said.values()) == {"und", "de", "en"}
    nothing = identify_language(docs, fit_language(docs.limit(0))).collect()
    assert {(x.lang_pred, x.score) for x in nothing} == {("und", 0.0)}
    assert score_quality(docs.limit(0), fit_quality(docs, labels)).count() == 0


def test_stages_take_effect_one_after_another(spark):
    sf_dir = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs, names = spark.read.parquet(f"{sf_dir}/documents.parquet"), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "decontamination", "mixing"]
    docs = docs.unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string")))
    for (name, stage), k in zip(corpus_pipeline.STAGES, range(5)):
        before = docs.toPandas()
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.count() == 0 or name == "quality_classifier"
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toPandas(), schema=empty.schema)
        after = docs.toPandas()
        if name == "ngram_jaccard_join":
            texts = [(i, t) for i, t in zip(before.doc_id, before.text)]
            ids = {i for i, _, c in _components(texts, 80, 5).elements() if i == c}
            assert set(after.doc_id) == ids
        elif name == "decontamination":
            assert sorted(after.doc_id) == sorted(i for i, t in zip(before.doc_id, before.text) if not _contamination(t, items)[4])
        elif name == "line_dedup":
            # texts in the order of their ids, those without one empty, as whole rows are compared
            order = before.sort_values("doc_id", kind="stable")
            once = order.drop_duplicates("doc_id")
            want = dict(zip(once.doc_id, _without_runs([t or "" for t in once.text], 50)))
            assert sorted(after.doc_id) == sorted(before.doc_id)
            own = {(i, t) for i, t in zip(after.doc_id, after.text) if t}
            assert own == {(i, t) for i, t in want.items() if t}
        elif name == "mixing":
            con = duckdb.connect()
            con.register("documents", before)
            times = Counter(zip(after.doc_id.map(int), after.epoch.map(int)))
            assert times == Counter((r[0], r[1]) for r in con.sql(f"SELECT doc_id, epoch FROM ({mixing.SQL})").df().itertuples(index=False, name=None)) and times
        else:
            scored = score_quality(spark.createDataFrame(before), fit_quality(spark.createDataFrame(before), spark.read.parquet(f"{sf_dir}/labels.parquet")), keep=["doc_id"])
            assert sorted(after.doc_id) == sorted(r.doc_id for r in scored.where("predicted = 1").collect()) and len(after)
        if name != "mixing":
            assert list(after.columns) == list(before.columns)
