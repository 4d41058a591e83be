"""Best cosine neighbours between a pool and a benchmark, each of any size.

Vectors that are null, zero, or hold null or non-finite components have no neighbours;
vectors of different lengths aren't compared. Both sides are written as tiles to the shared
folder, and a task compares a tile with some of the other side's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.operators.tiles import TILE_BYTES, best_k


def nearest(pool: DataFrame, bench: DataFrame, pool_id: str = "vec_id", bench_id: str = "vec_id", vector: str = "embedding", tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(vec_id, bench_id, sim) of each pool row's best benchmark neighbour; ties go to the smaller bench_id.

    Pool rows without a comparable vector are not in the result.
    """
    found = best_k(pool.select(pool_id, vector), bench.select(bench_id, vector), 1, tile_bytes)
    return found.select(F.col("id").alias("vec_id"), F.col("best")[0]["other"].alias("bench_id"), F.col("best")[0]["sim"].alias("sim"))


def top_k(pool: DataFrame, bench: DataFrame, k: int = 5, pool_id: str = "vec_id", bench_id: str = "vec_id", vector: str = "embedding", tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(bench_id, vec_id, sim, rank) of each benchmark row's k best pool rows; ties go to the smaller vec_id.

    Fewer than k comparable pool rows are all returned.
    """
    found = best_k(bench.select(bench_id, vector), pool.select(pool_id, vector), k, tile_bytes)
    each = found.select(F.col("id").alias("bench_id"), F.posexplode("best").alias("at", "m"))
    return each.select("bench_id", F.col("m.other").alias("vec_id"), F.col("m.sim").alias("sim"), (F.col("at") + 1).alias("rank"))
