"""Draws that depend on a row's key and a seed alone, so that every task makes the same ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.operators.reports import with_position
from siftwright.sources.shared import Workspace, unused


def uniform(key: Column, seed: int, name: str) -> Column:
    """A number from 0 to below 1 for each key."""
    first = F.substring(F.md5(F.concat(F.lit(f"{seed}:{name}:"), key.cast("string")).cast("binary")), 1, 8)
    return F.conv(first, 16, 10).cast("double") / F.lit(4294967296.0)


def regime_draw(rows: DataFrame, key: str, seed: int = 0, official: float = 0.5, pool: float = 0.25, most: int = 5, reasoned: float = 0.0, official_shots: int = 5) -> DataFrame:
    """rows with regime (official, pool or zero), the number of its shots, and fast (no reasoning)."""
    u = uniform(F.col(key), seed, "regime")
    regime = F.when(u < official, "official").when(u < official + pool, "pool").otherwise("zero")
    shots = F.when(u < official, official_shots).when(u < official + pool, 1 + F.floor(uniform(F.col(key), seed, "shots") * most)).otherwise(0)
    return rows.withColumns({"regime": regime, "shots": shots.cast("int"), "fast": uniform(F.col(key), seed, "form") >= reasoned})


def distinct_places(key: Column, n: int, many: Column, seed: int, name: str) -> Column:
    """``many`` different whole numbers from 0 to below n, every set of them alike likely, by Floyd's method.

    Number i is drawn from the first n - many + i + 1 places; if it was drawn before, the last
    of these is taken. many is at most n; nothing of size n is made.
    """

    def place(i: Column) -> Column:
        hashed = F.md5(F.concat(F.lit(f"{seed}:{name}:"), i.cast("string"), F.lit(":"), key.cast("string")).cast("binary"))
        u = F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
        return F.floor(u * (F.lit(n) - many + i + 1)).cast("long")

    def drawn(sofar: Column, i: Column) -> Column:
        last = (F.lit(n) - many + i).cast("long")
        return F.array_append(sofar, F.when(F.array_contains(sofar, place(i)), last).otherwise(place(i)))

    none = F.array().cast("array<bigint>")
    return F.when(many > 0, F.aggregate(F.sequence(F.lit(0), many - 1), none, drawn)).otherwise(none)


def with_drawn_shots(rows: DataFrame, key: str, many: Column, shot: list[str], seed: int = 0) -> DataFrame:
    """rows with ``drawn``: an array of ``many`` other rows, each as a struct of the columns ``shot``.

    many + 1 rows are drawn without replacement, or all if there are fewer; a row's own place
    is taken out and the rest cut to many, so that fewer than many + 1 rows give one less each.
    Other rows with the same question may be drawn. key is a whole number that tells rows
    apart; a row without one is no shot but gets shots. What moves is places, and each drawn
    row once.
    """
    work = Workspace(rows.sparkSession, "shots")
    keys = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"))
    places = work.write(with_position(keys, "key"), "places")
    n = places.count()
    own, left = unused(rows, "__own"), unused(rows, "__left")
    asked = rows.select(F.col(key).cast("long").alias("key"), F.coalesce(many, F.lit(0)).cast("int").alias("many")).where(F.col("many") > 0)
    asked = asked.join(places, "key", "left").select("key", "many", F.coalesce("position", F.lit(-1)).alias("position"))
    with_own = distinct_places(F.coalesce(F.col("key").cast("string"), F.lit("null")), n, F.least(F.col("many") + 1, F.lit(n)), seed, "shot")
    others = F.slice(F.filter(with_own, lambda p: p != F.col("position")), 1, F.col("many"))
    draws = asked.select(F.col("key").alias("to"), F.posexplode(others).alias("at", "position"))
    named = draws.join(places.withColumnRenamed("key", "from"), "position").select("to", "at", "from")
    told = rows.select(F.col(key).cast("long").alias("from"), F.struct(*shot).alias("shot"))
    each = named.join(told, "from").groupBy("to").agg(F.array_sort(F.collect_list(F.struct("at", "shot"))).alias("shots"))
    lists = each.select(F.col("to").alias(own), F.transform("shots", lambda s: s["shot"]).alias(left))
    joined = rows.join(lists, F.col(key).cast("long").eqNullSafe(F.col(own)), "left")
    empty = F.array().cast(lists.schema[left].dataType)
    return joined.withColumn("drawn", F.coalesce(F.col(left), empty)).drop(own, left)
