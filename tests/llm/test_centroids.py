"""Clustering by trees against plain Lloyd rounds; the trees' own promises."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwright.llm import centroids
from siftwright.llm.centroids import CoverTree, assigned_nodes, cluster, squared

SCHEMA = "vec_id long, embedding array<double>"


def _plainly(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    middles = [list(v) for _, v in drawn[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(middles))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for c in set(of):
            own = [v for (_, v), x in zip(kept, of) if x == c]
            middles[c] = [sum(col) // len(own) for col in zip(*own)]
    return sorted((str(i), c, d) for (i, v) in kept for d, c in [nearest(v)]), middles


def _clumps(n, dims, seed, noise=0.05):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(7, dims))
    return [(int(i), (middle[r.integers(7)] + noise * r.normal(size=dims)).tolist()) for i in range(n)]


@pytest.mark.parametrize("n, dims, k, tile", [(300, 6, 9, 20), (120, 3, 40, 1000), (30, 5, 40, 4)])
def test_rounds_are_plain_ones(spark, n, dims, k, tile):
    rows = _clumps(n, dims, n) + [(1000 + i, [0.25] * dims) for i in range(90)] + [(5, [0.5] * dims), (5, [0.75] * dims)]
    want, middles = _plainly(rows, k, 5, dims)
    assigned, final = cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), k, dims=dims, tile=tile)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in assigned.collect()) == want
    assert [r.centroid for r in final.orderBy("cluster").collect()] == middles


def test_rows_that_are_left_out_and_clashing_names(spark):
    odd = [(None, [0.1, 0.2, 0.3]), (50, None), (51, []), (52, [1.0, 2.0]), (53, [1.0, None, 2.0]), (54, [float("nan")] * 3), (55, [float("-inf")] * 3), (56, [0.0, 0.0, 0.0])]
    rows = _clumps(20, 3, 1) + odd
    vectors = spark.createDataFrame(rows, SCHEMA)
    clashing = vectors.select("*", *(F.lit(f"own {c}").alias(c) for c in ("row", "v", "pivot", "cluster", "distance", "part", "bits")))
    want, _ = _plainly(rows, 4, 5, 3)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in cluster(clashing, 4, dims=3)[0].collect()) == want
    nothing, none = cluster(vectors.limit(0), 4, dims=3)
    assert nothing.count() == 0 and none.count() == 0


def test_a_cover_tree_covers_and_separates():
    points = np.round(np.random.default_rng(2).normal(size=(200, 4)) * 300)
    points[50:70] = points[3]
    tree = CoverTree.over(points)
    assert sorted(tree.order.tolist()) == list(range(200))
    for node in range(len(tree.center)):
        own = tree.order[tree.begin[node] : tree.end[node]]
        gap = np.sqrt(squared(points[own], points[tree.center[node]][None, :]))
        assert gap.max() <= tree.radius[node]
        below = range(tree.first[node], tree.last[node])
        middles = points[tree.center[list(below)]] if len(below) else points[:0]
        assert all(tree.radius[b] <= tree.radius[node] / 2 for b in below)
        assert all(np.sqrt(((a - b) ** 2).sum()) > tree.radius[node] / 2 for i, a in enumerate(middles) for b in middles[:i])
        assert not len(below) or sorted(x for b in below for x in range(tree.begin[b], tree.end[b])) == list(range(tree.begin[node], tree.end[node]))
        assert len(below) or tree.radius[node] == 0


def test_ties_go_to_the_smaller_number_and_bounds_prune(monkeypatch):
    points = np.array(_clumps(600, 8, 4, 0.02), dtype=object)
    points = np.floor(256 * np.array([p[1] for p in points]))
    middles = points[[0, 5, 9, 5, 33, 40, 60, 0]]  # two of them twice
    compared = []
    plain = centroids.squared
    monkeypatch.setattr(centroids, "squared", lambda a, b: compared.append(max(len(a), len(b))) or plain(a, b))
    tree, over = CoverTree.over(points), CoverTree.over(middles)
    compared.clear()
    node, number = assigned_nodes(tree, points, over, middles)
    of = np.full(600, -1)
    for a, b, c in zip(tree.begin[node], tree.end[node], number):
        assert (of[tree.order[a:b]] == -1).all()
        of[tree.order[a:b]] = c
    assert of.tolist() == [min((((p - m) ** 2).sum(), c) for c, m in enumerate(middles))[1] for p in points]
    assert sum(compared) < 600 * len(middles) / 2


def test_large_components_are_exact():
    a, b = np.array([[2.0**28 + 1, 0.0]]), np.array([[0.0, 1.0]])
    assert squared(a, b).tolist() == [(2**28 + 1) ** 2 + 1]
    with pytest.raises(OverflowError):
        squared(a * 2.0**10, b)
