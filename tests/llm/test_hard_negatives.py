"""Hard negatives against plain sorting: ties, copies, rows that take no part, scores of any size."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwright.llm import hard_negatives
from siftwright.llm.hard_negatives import mine_hard_negatives, products

SCHEMA = "vec_id long, embedding array<double>, label long"


def _plainly(rows, is_anchor, positives=5, negatives=10):
    able = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, y) in enumerate(able):
        if not is_anchor(i):
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), j, z) for b, (j, w, z) in enumerate(able) if a != b and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if x[2] == y)[:positives]:
            fit = sorted(x for x in scored if x[2] != y and 30 * -s <= 100 * -x[0] <= 90 * -s)
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fit[:negatives])]
    return sorted(out)


def _rows(n, dims, kinds, seed, copies=0):
    r = random.Random(seed)
    rows = [(i * 10, [round(r.gauss(0.3, 1), 3) for _ in range(dims)], r.randrange(kinds)) for i in range(n)]
    hot = rows[1][1]
    return rows + [(10**12 + 7 * (i * 7919 % 100_003), hot, i % 2) for i in range(copies)]


@pytest.mark.parametrize("gather, n, copies", [(64, 60, 0), (1, 40, 0), (1, 30, 300), (64, 30, 300)])
def test_windows_are_those_of_sorting(spark, monkeypatch, gather, n, copies):
    monkeypatch.setattr(hard_negatives, "GATHER", gather)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", 8 * 4 * 3)
    monkeypatch.setattr(hard_negatives, "ROW_BYTES", 8 * 4 * 50)
    rows = _rows(n, 4, 3, n, copies)
    got = mine_hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 70 == 0).collect()
    assert sorted(map(tuple, got)) == _plainly(rows, lambda i: i % 70 == 0)


def test_rows_that_take_no_part_and_clashing_names(spark):
    rows = _rows(30, 3, 2, 5)
    odd = [(None, [1.0, 1.0, 1.0], 1), (400, None, 1), (410, [], 1), (420, [1.0, None, 1.0], 0), (430, [float("nan"), 1.0, 1.0], 0), (440, [float("inf"), 1.0, 1.0], 0), (450, [1.0, 1.0, 1.0], None), (490, [5.0, 5.0], 1), (0, [1.0, 1.0, 1.0], 1), (0, [1.0, 1.0, 1.0], 1), (70, [0.0, 0.0, 0.0], 0)]
    vectors = spark.createDataFrame(rows + odd, SCHEMA)
    clashing = vectors.select("*", *(F.lit(f"own {n}").alias(n) for n in ("key", "anchor", "v", "tile", "slot", "window", "score", "n", "rank", "bucket")))
    got = mine_hard_negatives(clashing, F.col("vec_id") % 70 == 0).collect()
    assert sorted(map(tuple, got)) == _plainly(rows + odd, lambda i: i % 70 == 0) and got
    words = vectors.withColumn("label", F.concat(F.lit("label "), F.col("label").cast("string")))
    assert sorted(map(tuple, mine_hard_negatives(words, F.col("vec_id") % 70 == 0).collect())) == sorted(map(tuple, got))
    assert mine_hard_negatives(vectors.limit(0), F.lit(True)).count() == 0
    assert mine_hard_negatives(vectors, F.lit(None).cast("boolean")).count() == 0


def test_large_components_are_multiplied_exactly():
    a, b = np.array([[2.0**40 + 1, 3.0]]), np.array([[2.0**20 + 1, -1.0]])
    assert products(a, b).tolist() == [[(2**40 + 1) * (2**20 + 1) - 3]]
    with pytest.raises(OverflowError):
        products(a, a)
