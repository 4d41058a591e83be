"""Connected components of a graph that is only ever a distributed table."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.llm.workspace import Workspace


def connected_components(edges: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """(node, component) for every node of edges (a, b): the smallest node reachable.

    Alternating large-star and small-star steps: every node is tied to the smallest
    neighbour seen so far until each component is a star, in about log(n) rounds. Each
    round is two partial aggregations and two joins, written to the shared folder. The
    neighbours of a node are only ever reduced to their minimum, never gathered, so one
    node may have any number of them. Nodes without an edge are not listed. Rounds go on
    until one changes nothing: each but the last ties some node to a smaller one, so they end.
    """
    now = work.write(_clean(edges.select("a", "b")), f"{name}-0")
    before = None
    for n in count(1):
        after = work.write(_small_star(_large_star(now)), f"{name}-{n}")
        mark = after.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        work.drop(f"{name}-{n - 1}")
        now = after
        if tuple(mark) == before:
            break
        before = tuple(mark)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _clean(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node (a) to the smaller (b)."""
    return edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node are tied to its smallest neighbour (or itself)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    return _clean(larger.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node's smaller neighbours, and the node, are tied to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _clean(moved.unionByName(least.select("a", F.col("m").alias("b"))))
