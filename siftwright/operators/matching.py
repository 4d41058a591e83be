"""Benchmark rows against their nearest pool rows: options and content decide whether they match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.functions.arrays import jaccard

# Sets of options that many unrelated questions share.
GENERIC = (("vero", "falso"), ("si", "no"), ("vero", "falso", "non so"))


def generic(options: Column, most: int = 3, least: int = 2) -> Column:
    """Whether a small set of options shares at least two with a set that says nothing of the question."""
    shared = [F.size(F.array_intersect(options, F.array(*map(F.lit, s)))) >= least for s in GENERIC]
    return (F.size(options) <= most) & F.greatest(*shared)


def semantic_hit(sim: Column, options: Column, content: Column, low: float = 0.75, high: float = 0.92, least_options: float = 0.4, least_content: float = 0.5) -> Column:
    return ((options >= least_options) & (sim >= low)) | ((sim >= high) & (content >= least_content))


def verified(sim: Column, options: Column, content: Column, least: float = 0.9, least_options: float = 0.4, least_content: float = 0.5) -> Column:
    return (sim >= least) & ((options >= least_options) | (content >= least_content))


def compared(pairs: DataFrame, bench: DataFrame, pool: DataFrame) -> DataFrame:
    """pairs (bench_id, vec_id, ...) with option_sim and content_sim; both sides have id, options, content."""
    left = bench.select(F.col("id").alias("bench_id"), F.col("options").alias("__o"), F.col("content").alias("__c"))
    right = pool.select(F.col("id").alias("vec_id"), F.col("options").alias("__p"), F.col("content").alias("__d"))
    empty = F.array().cast("array<string>")
    set_of = lambda c: F.coalesce(F.col(c), empty)
    joined = pairs.join(left, "bench_id", "left").join(right, "vec_id", "left")
    return joined.withColumns({"option_sim": jaccard(set_of("__o"), set_of("__p")), "content_sim": jaccard(set_of("__c"), set_of("__d"))}).drop("__o", "__p", "__c", "__d")


def best_hit(rows: DataFrame, hit: Column) -> DataFrame:
    """For each bench_id the accepted row of the largest sim, ties to the smaller vec_id."""
    top = F.max_by(F.struct("vec_id", "sim", "option_sim", "content_sim"), F.struct(F.col("sim"), -F.col("vec_id"))).alias("m")
    return rows.where(hit).groupBy("bench_id").agg(top).select("bench_id", "m.*")


def match_report(matches: DataFrame, n_bench: int, reworded: Column) -> DataFrame:
    """One row: matched, matched_pct, reworded, drop_rows and drop_ids, sorted."""
    out = matches.agg(F.count(F.lit(1)).alias("matched"), F.count_if(reworded).alias("reworded"), F.array_sort(F.collect_set("vec_id")).alias("ids"))
    return out.select("matched", F.round(F.try_divide(100.0 * F.col("matched"), F.lit(n_bench)), 2).alias("matched_pct"), "reworded", F.size("ids").cast("long").alias("drop_rows"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("drop_ids"))
