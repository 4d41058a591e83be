"""Drawn shots against Floyd's method in plain Python, and what draws promise."""

import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from siftwright.operators.draws import distinct_places, with_drawn_shots


def _floyd(key, n, many, seed, name):
    out = []
    for i in range(many):
        top = n - many + i
        u = int(hashlib.md5(f"{seed}:{name}:{i}:{key}".encode()).hexdigest()[:13], 16) / 2**52
        t = math.floor(u * (top + 1))
        out.append(top if t in out else t)
    return out


def test_places_are_different_and_alike_likely(spark):
    rows = spark.range(4000)
    for n, many in ((3, 3), (7, 3), (10**12, 6), (5, 1), (4, 0)):
        got = rows.select("id", distinct_places(F.col("id"), n, F.lit(many), 9, "x").alias("p")).collect()
        assert all(r.p == _floyd(r.id, n, many, 9, "x") for r in got)
        assert all(len(set(r.p)) == many and all(0 <= p < n for p in r.p) for r in got)
    seen = Counter(p for r in rows.select(distinct_places(F.col("id"), 7, F.lit(3), 9, "x").alias("p")).collect() for p in r.p)
    assert all(abs(seen[p] - 4000 * 3 / 7) < 200 for p in range(7))


def test_shots_of_awkward_pools(spark):
    schema = "row long, question string, many int, drawn string, key string"
    rows = [(10 * k, "the same question" if k % 2 else f"question {k}", k % 7, "own", "own") for k in range(40)] + [(None, "no key", 2, "own", "own"), (1000, None, None, "own", "own")]
    got = with_drawn_shots(spark.createDataFrame(rows, schema).repartition(3).drop("drawn"), "row", F.col("many"), ["row", "question"], 5).collect()
    assert len(got) == len(rows) and all(r["key"] == "own" for r in got)
    for r in got:
        own = [s["row"] for s in r.drawn]
        assert len(own) == len(set(own)) == (r.many or 0) and r.row not in own and None not in own
    copies = [s.question for r in got for s in r.drawn if r.question == "the same question"]
    assert "the same question" in copies  # another row with the question is another row
    few = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, "c", 1)], "row long, question string, many int")
    assert {r.row: sorted(s.row for s in r.drawn) for r in with_drawn_shots(few.where("row < 3"), "row", F.col("many"), ["row"]).collect()} == {1: [2], 2: [1]}
    assert all(len(r.drawn) == min(r.many, 2) for r in with_drawn_shots(few, "row", F.col("many"), ["row"]).collect())
    assert [r.drawn for r in with_drawn_shots(few.where("row = 1"), "row", F.col("many"), ["row"]).collect()] == [[]]
    assert with_drawn_shots(few.limit(0), "row", F.col("many"), ["row"]).count() == 0
