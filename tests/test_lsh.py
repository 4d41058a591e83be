"""Bands, signatures, near pairs and shared items against plain sets, with hot items and crowded buckets."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwright.operators import lsh, overlap
from siftwright.operators.lsh import Sets, best_bands, estimate, pairs_within, signature
from siftwright.operators.overlap import contained, item_filter, known_items, shared
from siftwright.plans.leaks import near_copies, swept


def _families(seed, n=160):
    """Near copies of a few texts, exact copies, and others."""
    r = random.Random(seed)
    base = [[f"{b}-{k}" for k in range(40)] for b in range(4)]
    out = {}
    for i in range(n):
        own = set(base[i % 4])
        for _ in range(r.randrange(0, 9)):
            own.discard(f"{i % 4}-{r.randrange(40)}")
        own |= {f"own{i}-{k}" for k in range(r.randrange(0, 5))}
        out[i] = own
    return out | {n: set(base[0]), n + 1: set(base[0]), n + 2: {"alone"}, n + 3: set()}


def _table(spark, sets, key="id"):
    return spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], f"{key} long, items array<string>").repartition(3)


def _jaccard(x, y):
    return len(x & y) / len(x | y)


def test_bands_are_those_of_the_least_area():
    def area(threshold, b, r):
        s = np.linspace(0, 1, 4001)
        meets = 1 - (1 - s**r) ** b
        return np.where(s < threshold, meets, 1 - meets).mean()

    for t in (0.5, 0.7, 0.8, 0.9):
        b, r = best_bands(t, 64)
        assert b * r <= 64 and area(t, b, r) <= min(area(t, x, y) for y in range(1, 65) for x in range(1, 64 // y + 1)) + 1e-3
    assert best_bands(1.0) == (1, 128)
    assert best_bands(0.8, missed=0.95)[1] < best_bands(0.8, missed=0.05)[1]


def test_estimates_come_near(spark):
    sets = {k: {f"x{i}" for i in range(k, k + 100)} for k in (0, 20, 60)} | {1: set()}
    signs = {r.id: r.s for r in _table(spark, sets).select("id", signature(F.col("items")).alias("s")).collect()}
    assert len(signs[0]) == 128 and signs[1] == []
    pairs = spark.createDataFrame([(signs[a], signs[b], _jaccard(sets[a], sets[b])) for a, b in ((0, 0), (0, 20), (0, 60))], "a array<long>, b array<long>, j double")
    assert all(abs(r.e - r.j) < 0.12 for r in pairs.select(estimate(F.col("a"), F.col("b")).alias("e"), "j").collect())


@pytest.mark.parametrize("part", [256, 3])
def test_pairs_of_crowded_groups_come_once(spark, part):
    rows = [(g, i) for g, n in ((1, 40), (2, 1), (3, 2), (4, 7)) for i in range(n)]
    got = pairs_within(spark.createDataFrame(rows, "group long, id long"), part).collect()
    assert sorted(map(tuple, got)) == sorted((g, a, b) for g, n in ((1, 40), (3, 2), (4, 7)) for a, b in combinations(range(n), 2))


def test_sweep_finds_near_copies(spark, monkeypatch):
    monkeypatch.setattr(lsh, "PART", 16)
    sets = _families(2)
    thresholds = (1.0, 0.8, 0.7)
    held = Sets(_table(spark, sets, "doc").withColumnRenamed("doc", "key"), "key")
    least = {}
    for i, s in sets.items():
        least.setdefault(frozenset(s), i)
    near = {(a, b): _jaccard(sets[a], sets[b]) for a, b in combinations(sorted(least[s] for s in least if s), 2)}
    got = near_copies(held, thresholds).collect()
    for t in thresholds:
        own = {(r.a, r.b): r.jaccard for r in got if r.threshold == t}
        assert own == pytest.approx({k: j for k, j in near.items() if j >= t})
    rows = {r.threshold: r for r in swept(held, thresholds).collect()}
    for t in thresholds:
        pairs = [(a, b) for a, b in combinations([i for i in sets if sets[i]], 2) if _jaccard(sets[a], sets[b]) >= t]
        assert (rows[t].pairs, rows[t].documents) == (len(pairs), len({x for p in pairs for x in p}))
        assert rows[t].found >= 0.9 and rows[t].off < 0.05
    none = swept(Sets(_table(spark, sets).limit(0), "id"), (0.8,)).first()
    assert (none.pairs, none.documents, none.found) == (0, 0, 1.0)


@pytest.mark.parametrize("most", [32 << 20, 0])
def test_an_item_in_every_row(spark, monkeypatch, most):
    monkeypatch.setattr(overlap, "HOT_LEAST", 20)
    pool = {i: {"everywhere", *(f"p{i}-{k}" for k in range(30))} | ({"rare"} if i % 50 == 0 else set()) for i in range(200)}
    bench = {0: {"everywhere", "rare", "absent"}, 1: {"everywhere"}, 2: {"nowhere"}, 3: set()}
    want = {(i, j): (len(x & y), len(x | y)) for i, x in pool.items() for j, y in bench.items() if x & y}
    p, b = _table(spark, pool, "p"), _table(spark, bench, "b")
    assert {(r.p, r.b): (r.inter, r.n_union) for r in shared(p, "p", b, "b", most).collect()} == want
    assert {(r.p, r.b) for r in contained(p, "p", b, "b", 0.6).collect()} == {(i, j) for i, x in pool.items() for j, y in bench.items() if y and len(x & y) >= 0.6 * len(y)}
    assert shared(p, "p", b.limit(0), "b", most).count() == 0 and shared(p.limit(0), "p", b, "b", most).count() == 0


def test_most_items_stay_where_they_are(spark):
    pool = spark.range(300).select(F.col("id").alias("p"), F.transform(F.sequence(F.lit(0), F.lit(199)), lambda k: F.concat_ws("-", F.col("id").cast("string"), k.cast("string"))).alias("items"))
    known = item_filter(spark.createDataFrame([(f"{i}-7",) for i in range(0, 300, 3)], "item string"), "item", 100)
    left = known_items(pool, "p", known)
    found = {r["__item"] for r in left.collect()}
    assert {f"{i}-7" for i in range(0, 300, 3)} <= found and len(found) < 100 + 60_000 * 0.01
    assert {r["__n"] for r in left.collect()} == {200}


@pytest.mark.parametrize("few", [64, 3])
def test_crowded_items_lose_no_pair(spark, monkeypatch, few):
    monkeypatch.setattr(lsh, "FEW", few)
    monkeypatch.setattr(lsh, "PART", 8)
    monkeypatch.setattr(lsh, "TOLD_BY", 1)
    sets = _families(5, 120)
    least = {}
    for i, s in sets.items():
        least.setdefault(frozenset(s), i)
    near = {(a, b): _jaccard(sets[a], sets[b]) for a, b in combinations(sorted(least[s] for s in least if s), 2)}
    held = Sets(_table(spark, sets), "id")
    found = {(r.a, r.b): r.jaccard for r in held.compared(held.similar(0.6)).collect()}
    assert {k: j for k, j in found.items() if j >= 0.6} == pytest.approx({k: j for k, j in near.items() if j >= 0.6})


def test_a_shared_passage_alone_is_no_candidate(spark):
    """Sets that share a passage but can't be near are never compared."""
    passage = [f"p{k}" for k in range(12)]
    sets = {i: {*passage, *(f"{i}-{k}" for k in range(60))} for i in range(40)} | {40: {f"0-{k}" for k in range(60)}}
    assert [tuple(r) for r in Sets(_table(spark, sets), "id").similar(0.7).collect()] == [(0, 40)]


def test_hashed_shingles_are_those_of_strings(spark):
    from siftwright.functions.hashed import hashed_shingles
    from siftwright.functions.text import plain_words
    from siftwright.operators.overlap import shingles

    r = random.Random(3)
    texts = ["", None, " ", "one", "one two", "one two three", "one two three four", "a b a b a b a b", "È due tre  quattro cinque sei", *(" ".join(r.choice(["ab", "abc", "lengthy-word-of-more-than-8", "é", "abcdefgh", "abcdefghi"]) for _ in range(r.randrange(1, 60))) for _ in range(700))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1).withColumn("plain", plain_words(F.col("text")))
    got = rows.select("id", shingles(F.col("plain"), 4).alias("s"), hashed_shingles(F.col("plain"), 4).alias("h")).collect()
    told = {}
    for row in got:
        assert len(row.h) == len(row.s) and row.h == sorted(set(row.h))
        told.setdefault(frozenset(row.s), set()).add(tuple(row.h))
    assert all(len(h) == 1 for h in told.values()) and len({h for x in told.values() for h in x}) == len(told)
    assert len({x for row in got for x in row.h}) == len({x for row in got for x in row.s})


def test_sweep_writes_no_more_than_its_input(spark, monkeypatch):
    """Sets of items were written and shuffled whole, 22 times the input on disk; now a few numbers of each are."""
    from siftwright.sources.shared import Workspace

    written = []

    def write(self, df, name, f=Workspace.write):
        out = f(self, df, name)
        written.append((name, [t for _, t in out.dtypes], out.count()))
        return out

    monkeypatch.setattr(Workspace, "write", write)
    sets = {i: {f"{i}-{k}" for k in range(200)} for i in range(100)}
    assert swept(Sets(_table(spark, sets), "id"), (0.7,)).first().pairs == 0
    assert written and not any(t == "array<string>" or n > len(sets) for _, kinds, n in written for t in kinds)
