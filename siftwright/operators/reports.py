"""Reports on evaluation runs: accuracy by groups, running means, gains and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accuracy(rows: DataFrame, right: Column, *by: str) -> DataFrame:
    """n, n_right and accuracy for each group, each prefix of the groups and all rows."""
    return rows.rollup(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("n_right"), F.avg(right.cast("int")).alias("accuracy"))


def gains_by(rows: DataFrame, before: Column, after: Column, by: str) -> DataFrame:
    """What a second run fixed and broke in each group, and its net share of the rows."""
    fixed, broke = F.count_if(~before & after), F.count_if(before & ~after)
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), fixed.alias("fixed"), broke.alias("broke"))
    return out.withColumn("net_percent", 100.0 * (F.col("fixed") - F.col("broke")) / F.col("n"))


def running_accuracy(rows: DataFrame, place: str, right: Column, block: int = 100_000) -> DataFrame:
    """(place, seen, n_right) up to each place, a unique whole number; places may have gaps.

    Sums of blocks of places are carried forward first, so that only one number for each
    block is ordered in one task; the rest runs within blocks.
    """
    own = rows.select(place, F.floor(F.col(place) / block).alias("__block"), right.cast("long").alias("__right"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"), F.sum("__right").alias("__r"))
    carried = sums.select("__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"), F.coalesce(F.sum("__r").over(before), F.lit(0)).alias("__r"))
    within = Window.partitionBy("__block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    joined = own.join(carried, "__block")
    return joined.select(place, (F.col("__n") + F.count(F.lit(1)).over(within)).alias("seen"), (F.col("__r") + F.sum("__right").over(within)).alias("n_right"))


def with_position(rows: DataFrame, key: str, block: int = 100_000, of: str | None = None) -> DataFrame:
    """rows with position, from 0 by a whole-number key; keys may have gaps, a repeated key has equal positions of its first.

    of: the name of a column for how many rows with a key there are, which the same pass counts.

    Counts of blocks of keys are carried forward, so that only one number for each block is
    ordered in one task. A null key has a null position.
    """
    own = rows.withColumn("__block", F.floor(F.col(key) / block))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    counts = own.where(F.col(key).isNotNull()).groupBy("__block").agg(F.count(F.lit(1)).alias("__n"))
    more = [F.sum("__n").over(Window.partitionBy(F.lit(0))).alias(of)] if of else []
    carried = counts.select("__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"), *more)
    nth = F.rank().over(Window.partitionBy("__block").orderBy(key))
    return own.join(carried, "__block", "left").withColumn("position", F.col("__n") + nth - 1).drop("__block", "__n")


def cumulative_counts(rows: DataFrame, value: str, edges: tuple[float, ...]) -> DataFrame:
    """(edge, n): how many values reach each edge; one pass, one row for each edge."""
    counted = rows.agg(*(F.count_if(F.col(value) >= e).alias(str(k)) for k, e in enumerate(edges)))
    return counted.select(F.inline(F.array(*(F.struct(F.lit(float(e)).alias("edge"), F.col(str(k)).alias("n")) for k, e in enumerate(edges)))))
