"""Neighbours over many tiles against all products, ties and copies included."""

import numpy as np
import pytest

from siftwright.operators import tiles
from siftwright.operators.nearest import nearest, top_k


def _table(spark, vectors, first=0):
    return spark.createDataFrame([(first + k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("tile_bytes, fan", [(1, 2), (8 * 6 * 7, 3), (4 << 20, 64)])
def test_many_tiles_give_what_one_does(spark, monkeypatch, tile_bytes, fan):
    monkeypatch.setattr(tiles, "FAN", fan)
    monkeypatch.setattr(tiles, "PER_UNIT", 2)
    n = 14 if tile_bytes == 1 else 60
    r = np.random.default_rng(3)
    pool = r.normal(size=(n, 6))
    pool[n // 2 :] = pool[r.integers(0, 4, n - n // 2)]  # copies of four vectors: ties everywhere
    bench = np.vstack([pool[:5] * 3.0, r.normal(size=(8, 6))])
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    sims = (unit(bench)[:, None, :] * unit(pool)[None, :, :]).sum(axis=2)
    got = {}
    p, b = _table(spark, pool.tolist()).repartition(3), _table(spark, bench.tolist(), 1000).repartition(2)
    for row in top_k(p, b, 5, tile_bytes=tile_bytes).orderBy("bench_id", "rank").collect():
        got.setdefault(row.bench_id, []).append(row.vec_id)
    want = {1000 + i: sorted(range(n), key=lambda j: (-sims[i, j], j))[:5] for i in range(len(bench))}
    assert got == want
    best = {row.vec_id: row.bench_id for row in nearest(p, b, tile_bytes=tile_bytes).collect()}
    assert best == {j: min(range(len(bench)), key=lambda i: (-sims[i, j], i)) + 1000 for j in range(n)}


def test_a_crowd_of_copies_is_held_in_bounds(spark):
    rows = spark.range(30_000).selectExpr("id AS vec_id", "array(1.0D, 0.0D, 0.0D) AS embedding")
    bench = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 0.0]), (6, [1.0]), (None, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    got = top_k(rows, bench, 3, tile_bytes=24 * 1000).orderBy("bench_id", "rank").collect()
    assert [(r.bench_id, r.vec_id, r.rank) for r in got] == [(b, k, k + 1) for b in (1, 2) for k in range(3)]
    assert top_k(rows.limit(0), bench, 3).count() == 0 and nearest(rows.limit(5), bench.limit(0)).count() == 0
