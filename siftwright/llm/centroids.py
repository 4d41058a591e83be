"""Centroid clustering: Lloyd's rounds by two trees, exact in whole numbers.

Vectors lie in tiles of bounded size, near ones together, each with its cover tree: a node's
children are net points more than half its radius apart that cover it within half its radius.
A round builds such a tree over the centroids; every tile walks both trees together. A pair
of nodes goes when no vector of the one can be nearer to a centroid of the other than to one
already seen; leaf pairs are compared exactly, and a node that only one centroid is left for
is assigned whole. Tiles send sums for each centroid, never vectors.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.llm.workspace import Workspace
from siftwright.operators.tiles import matrices
from siftwright.sources.shared import load_arrays, save_arrays

TILE = 1024  # vectors of a tile and its tree, about
PIVOTS = 64  # starting centroids that tell near vectors apart, at most
SIGNS = 16  # directions that do so within a pivot's vectors, at most
_AT_ONCE = 1 << 15  # distances computed at once
_SLACK = 1e-9  # of a distance; more than rounding in the bounds can lose


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of whole numbers held as doubles, each of a with the same one of b, exact."""
    most = 4.0 * a.shape[1] * max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) ** 2
    if most >= 2.0**62:
        raise OverflowError("a squared distance doesn't fit in 64 bits")
    if most >= 1 << 53:
        a, b = a.astype(np.int64), b.astype(np.int64)
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap).astype(np.int64)


class CoverTree:
    """Nodes in arrays; the points of a node are order[begin:end], its children nodes first:last (none for a leaf)."""

    FIELDS = ("order", "center", "begin", "end", "first", "last", "radius")

    def __init__(self, **fields: np.ndarray):
        self.__dict__.update(fields)

    @classmethod
    def over(cls, points: np.ndarray) -> CoverTree:
        order = np.arange(len(points))
        nodes = [[0, 0, len(points), 0, 0, 0.0]]
        for node in nodes:  # grows meanwhile
            center, begin, end = node[:3]
            own = order[begin:end].copy()
            gap = np.sqrt(squared(points[own], points[center][None, :]).astype(np.float64))
            node[5] = radius = float(gap.max())
            if radius == 0:
                continue
            owner, centers = np.zeros(len(own), np.int64), [center]
            while gap[far := int(gap.argmax())] > radius / 2:
                to = np.sqrt(squared(points[own], points[own[far]][None, :]).astype(np.float64))
                nearer = to < gap
                gap[nearer], owner[nearer] = to[nearer], len(centers)
                centers.append(int(own[far]))
            order[begin:end] = own[np.argsort(owner, kind="stable")]
            stops = begin + np.cumsum(np.bincount(owner, minlength=len(centers)))
            node[3:5] = len(nodes), len(nodes) + len(centers)
            nodes += [[c, a, b, 0, 0, 0.0] for c, a, b in zip(centers, [begin, *stops[:-1].tolist()], stops.tolist())]
        columns = list(zip(*nodes))
        return cls(order=order, **{k: np.array(c, np.int64) for k, c in zip(cls.FIELDS[1:-1], columns)}, radius=np.array(columns[-1]))


def _opened(of: np.ndarray, tree: CoverTree) -> tuple[np.ndarray, np.ndarray]:
    """For nodes ``of``: which of them, and each child."""
    many = tree.last[of] - tree.first[of]
    which = np.repeat(np.arange(len(of)), many)
    return which, tree.first[of][which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)


def assigned_nodes(tree: CoverTree, points: np.ndarray, over: CoverTree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, centroid): nodes of tree that together hold each point once, with the nearest centroid, ties to the smaller number."""
    numbers = np.array([over.order[a:b].min() for a, b in zip(over.begin, over.end)])  # all points of a leaf are equal
    leaf, over_leaf = tree.first == tree.last, over.first == over.last
    best = np.full(len(leaf), np.inf)  # how far the nearest centroid of any point of a node can be
    x, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    gap = np.full(1, -1, np.int64)  # squared; -1 where it isn't known yet
    nodes, chosen = [], []
    while len(x):
        new = np.flatnonzero(gap < 0)
        for at in range(0, len(new), _AT_ONCE):
            i = new[at : at + _AT_ONCE]
            gap[i] = squared(points[tree.center[x[i]]], centroids[over.center[c[i]]])
        far = np.sqrt(gap.astype(np.float64))
        np.minimum.at(best, x[new], far[new] + tree.radius[x[new]])
        near = far - tree.radius[x] - over.radius[c] <= best[x] * (1 + _SLACK)
        x, c, gap = x[near], c[near], gap[near]
        # a centroid's node is opened first if it is the wider one; the point's node waits for all of these
        wide = ~over_leaf[c] & (leaf[x] | (over.radius[c] >= tree.radius[x]))
        waits = np.zeros(len(leaf), bool)
        waits[x[wide]] = True
        stay = waits[x] & ~wide
        ready = ~waits[x]
        alone = np.bincount(x[ready], minlength=len(leaf)) == 1
        ends = ready & over_leaf[c] & (leaf[x] | alone[x])
        if ends.any():
            order = np.lexsort((numbers[c[ends]], gap[ends], x[ends]))
            node, first = np.unique(x[ends][order], return_index=True)
            nodes.append(node)
            chosen.append(numbers[c[ends][order[first]]])
        open_x = ready & ~ends
        which_c, child_c = _opened(c[wide], over)
        which_x, child_x = _opened(x[open_x], tree)
        best[child_x] = np.minimum(best[child_x], best[x[open_x][which_x]])
        none = lambda n: np.full(n, -1, np.int64)
        x, c, gap = (np.concatenate(p) for p in ((x[stay], x[wide][which_c], child_x), (c[stay], child_c, c[open_x][which_x]), (gap[stay], none(len(child_c)), none(len(child_x)))))
    return np.concatenate(nodes), np.concatenate(chosen)


def _placed(pivots: np.ndarray):
    """Adds to rows (vec_id, v) the nearest pivot and, in bits, on which sides of some planes through it a vector lies."""
    planes = np.random.default_rng(13).choice([-1.0, 1.0], (SIGNS, pivots.shape[1]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, sides = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
            for at, v in matrices(batch.columns[-1]):
                far = (pivots * pivots).sum(axis=1) - 2 * (v @ pivots.T)
                near[at] = far.argmin(axis=1)
                sides[at] = ((v - pivots[near[at]]) @ planes.T > 0) @ (1 << np.arange(SIGNS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(sides)], names=[*batch.schema.names, "pivot", "sides"])

    return place


def _store_tile(folder: str):
    def store(key: tuple, table: pa.Table) -> pa.Table:
        _, v = next(matrices(table.column("v").combine_chunks()))
        tree = CoverTree.over(v)
        rows = table.column("row").to_numpy()[tree.order]
        # points are stored in the tree's order
        place = np.empty(len(v), np.int64)
        place[tree.order] = np.arange(len(v))
        fields = {k: getattr(tree, k) for k in CoverTree.FIELDS} | {"center": place[tree.center], "order": np.arange(len(v))}
        return pa.table({"tile": [save_arrays(folder, v=v[tree.order], row=rows, **fields)]})

    return store


def _walk(folder: str, centroids: np.ndarray, over: CoverTree, last: bool):
    """Sums and numbers of each centroid's vectors; in the last round each vector's centroid and distance."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = centroids.shape
        sums = np.zeros((k, d + 1), np.int64)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held = load_arrays(folder, name)
                tree, v = CoverTree(**{f: held[f] for f in CoverTree.FIELDS}), held["v"]
                node, number = assigned_nodes(tree, v, over, centroids)
                if last:
                    of = np.empty(len(v), np.int64)
                    for a, b, c in zip(tree.begin[node], tree.end[node], number):
                        of[a:b] = c
                    yield pa.RecordBatch.from_arrays([pa.array(held["row"]), pa.array(of.astype(np.int32)), pa.array(squared(v, centroids[of]))], names=["row", "cluster", "distance"])
                else:
                    upto = np.zeros((len(v) + 1, d + 1), np.int64)
                    upto[1:, :d], upto[1:, d] = np.cumsum(v.astype(np.int64), axis=0), np.arange(1, len(v) + 1)
                    np.add.at(sums, number, upto[tree.end[node]] - upto[tree.begin[node]])
        if not last:
            some = np.flatnonzero(sums[:, d])
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["cluster", "sums"])

    return walk


def _sound(vector: Column, dims: int) -> Column:
    whole = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & whole, F.lit(False))


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2", tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(vec_id, cluster, distance) of each vector of exactly ``dims`` sound components, and (cluster, centroid).

    Components become floor(scale * x). Centroids start as the k vectors with the smallest
    sha256 of ``seed:vec_id``, in this order; each round assigns every vector to the nearest
    one (ties: the smaller number) and moves each centroid that has vectors to the floor of
    their mean; at last vectors are assigned once more. distance is squared.

    Defined results: vectors that are null, of another length or hold null or non-finite
    components are left out; rows without vec_id are clustered but start no centroid while
    others can; rows that share a vec_id are vectors of their own; with fewer than k vectors
    each starts a centroid; equal vectors may start several, of which the first gets all;
    squared distances beyond 62 bits are an error; an empty table gives no rows; other columns
    aren't read.

    k * dims numbers pass through the driver and to every task each round, whatever the
    number of vectors.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "centroids")
    folder = work.store_path("tiles")
    folder = folder if ":" in folder.split("/")[0] else os.path.abspath(folder)
    wide = F.col("embedding").cast("array<double>")
    whole = F.transform(wide, lambda x: F.floor(x * scale).cast("double"))
    rows = work.write(vectors.where(_sound(wide, dims)).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")), "vectors")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = rows.select(drawn.alias("drawn"), "v").orderBy(F.asc_nulls_last("drawn"), "v").limit(k).collect()
    if not start:
        empty = spark.createDataFrame([], "vec_id long, cluster int, distance long")
        return empty, spark.createDataFrame([], "cluster int, centroid array<long>")
    centroids = np.array([r["v"] for r in start])
    placed = work.write(rows.select("row", "v").mapInArrow(_placed(centroids[:PIVOTS]), "row long, v array<double>, pivot int, sides int"), "placed")
    # a pivot's vectors are told apart by as many planes as they fill tiles
    fills = placed.groupBy("pivot").agg(F.greatest(F.lit(0), F.least(F.lit(SIGNS), F.floor(F.log2(F.count(F.lit(1)) / tile)))).cast("int").alias("bits"))
    placed = placed.join(F.broadcast(fills), "pivot").withColumn("cell", F.expr("sides & (shiftleft(1, bits) - 1)"))  # PIVOTS rows at most
    sizes = placed.groupBy("pivot", "cell").agg(F.ceil(F.count(F.lit(1)) / tile).alias("parts"))
    dealt = placed.join(sizes, ["pivot", "cell"]).select("pivot", "cell", F.pmod(F.xxhash64("row"), F.col("parts")).alias("part"), "row", "v")
    tiles = work.write(dealt.groupBy("pivot", "cell", "part").applyInArrow(_store_tile(folder), "tile string"), "tile-list")
    work.drop("placed")
    n_tasks = max(1, min(tiles.count(), max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    tiles = tiles.repartition(n_tasks, "tile")
    for _ in range(rounds):
        sums = tiles.mapInArrow(_walk(folder, centroids, CoverTree.over(centroids), False), "cluster int, sums array<long>")
        added = sums.select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("col").alias("sum")).collect()  # k * (dims + 1) rows at most
        many = {r["cluster"]: r["sum"] for r in added if r["pos"] == dims}
        for r in added:
            if r["pos"] < dims:
                centroids[r["cluster"], r["pos"]] = r["sum"] // many[r["cluster"]]
    found = work.write(tiles.mapInArrow(_walk(folder, centroids, CoverTree.over(centroids), True), "row long, cluster int, distance long"), "found")
    work.drop("tiles")
    work.drop("tile-list")
    at_last = spark.createDataFrame([(n, [int(x) for x in m]) for n, m in enumerate(centroids)], "cluster int, centroid array<long>")
    return rows.select("row", "vec_id").join(found, "row").drop("row"), at_last


_KEPT = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _sql(k: int = 40, rounds: int = 5) -> str:
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE {_KEPT})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, q AS m FROM kept QUALIFY c < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, q, c, list_dot_product(q, q) - 2 * list_dot_product(q, m) + list_dot_product(m, m) AS d
  FROM kept, c{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"""
        )
        if r < rounds:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, o.m) AS m FROM c{r} o LEFT JOIN (SELECT c, list(floor(s / n) ORDER BY p) AS m
  FROM (SELECT c, p, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS p FROM a{r}) GROUP BY c, p) GROUP BY c) n USING (c))"""
            )
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(CAST(m AS BIGINT[]), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)"""


#: The registered query's rows in DuckDB.
SQL = _sql()
