"""Exact samples: the rows of the smallest keys, of all rows or of each group, without ranking them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.sources.shared import unused

DIGITS = 4  # of a hexadecimal key; so many tell the bucket in which a sample ends


def draw(seed: int, key: Column) -> Column:
    """A hexadecimal number for each key; rows of the smallest ones are a uniform sample."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def smallest(rows: DataFrame, key: Column, ties: list[Column], n: int, by: list[str] | None = None) -> DataFrame:
    """The n rows of the smallest keys, hexadecimal strings, for each group ``by`` if there are any; all where there are fewer.

    Rows are counted by the first digits of their keys. The counts tell in which bucket a
    group's sample ends: rows below it are taken as they are, and only those within it are
    ranked, by key and then ``ties``. So no task gets a group's rows, and the rows that lose
    are never moved. A null key comes last; null groups are a group.
    """
    by = by or []
    held, bucket, cut, left, nth = (unused(rows, f"__{c}") for c in ("key", "bucket", "cut", "left", "nth"))
    keyed = rows.withColumn(held, key).withColumn(bucket, F.coalesce(F.conv(F.substring(held, 1, DIGITS), 16, 10).cast("int"), F.lit(1 << 4 * DIGITS)))
    counts = keyed.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("n"))  # at most 65,537 for a group
    upto = F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(bucket))
    ends = counts.select(*by, bucket, upto.alias("upto"), "n").where(F.col("upto") - F.col("n") < n)
    last = ends.groupBy(*by).agg(F.max(bucket).alias(cut), (n - F.max(F.col("upto") - F.col("n"))).alias(left))
    if by:
        names = {c: unused(rows, f"__by_{c}") for c in by}
        own = last.select(*(F.col(c).alias(a) for c, a in names.items()), cut, left)
        same = [F.col(c).eqNullSafe(F.col(a)) for c, a in names.items()]
        met = keyed.join(own, same).drop(*names.values())
    else:
        met = keyed.join(F.broadcast(last))  # one row
    sure = met.where(F.col(bucket) < F.col(cut))
    rank = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.asc_nulls_last(held), *ties))
    edge = met.where(F.col(bucket) == F.col(cut)).withColumn(nth, rank).where((F.col(nth) <= n) & (F.col(nth) <= F.col(left)))
    return sure.select(*rows.columns).unionByName(edge.select(*rows.columns))
