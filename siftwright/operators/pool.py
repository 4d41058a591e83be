"""Operators on a pool of rows: deduplication, leaks, splits, samples and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, key: Column, order: list[Column], row_id: str | None = None) -> DataFrame:
    """The first row of each key in the given ascending order, nulls first; the order must be total for a fixed result.

    An aggregation with partial minima, so that a key of very many rows is shared out. Whole
    rows go through it, which suits narrow ones; with row_id, a column that tells rows apart
    and is never null, only keys, places and ids do, and rows are joined with the ids that stay.
    """
    place = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)))
    if row_id:
        kept = rows.groupBy(key.alias("__key")).agg(F.min_by(row_id, place).alias(row_id)).select(row_id)
        return rows.join(kept, row_id, "left_semi")
    firsts = rows.groupBy(key.alias("__key")).agg(F.min_by(F.struct(*rows.columns), place).alias("__row"))
    return firsts.select("__row.*")


def without_keys(rows: DataFrame, key: Column, bench: DataFrame, bench_key: Column) -> DataFrame:
    """Rows whose key isn't among the benchmark's; Spark broadcasts the keys while they are few."""
    keys = bench.select(bench_key.alias("__bench")).distinct()
    return rows.withColumn("__key", key).join(keys, F.col("__key") == F.col("__bench"), "left_anti").drop("__key")


def with_keys(rows: DataFrame, key: Column, bench: DataFrame, bench_key: Column) -> DataFrame:
    keys = bench.select(bench_key.alias("__bench")).distinct()
    return rows.withColumn("__key", key).join(keys, F.col("__key") == F.col("__bench"), "left_semi").drop("__key")


def dev_split(rows: DataFrame, key: Column, order: list[Column], size: int) -> DataFrame:
    """The first ``size`` rows by key: the same rows however the input is laid out."""
    return rows.withColumn("__key", key).orderBy("__key", *order).limit(size).drop("__key")


def upweight(rows: DataFrame, chosen: Column, times: int) -> DataFrame:
    """Chosen rows ``times`` times, others once, with the number of the copy from 1."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(chosen, times).otherwise(1))))
