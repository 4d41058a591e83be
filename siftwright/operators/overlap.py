"""Overlap of texts with a benchmark: shared shingles, shared options.

Pool rows leave behind, before anything is shuffled, what a Bloom filter of the benchmark's
items doesn't know. Pairs of rows of the pool are never made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.sources.shared import Workspace

BROADCAST_BYTES = 32 << 20  # of a benchmark's items
HOT_ITEMS = 10_000  # items that are split, at most: each has more than a ten-thousandth of the pool's rows
HOT_LEAST = 100_000  # and at least so many
SPLIT = 64  # parts of a hot item
_BITS_AN_ITEM, _MOST_BITS = 16, 27  # of a filter; its size as a power of two, so at most 16 MB


def shingles(plain: Column, k: int) -> Column:
    """Distinct runs of k words of a normalised text (``plain_words``); a shorter one is one run, an empty or null one none."""

    def runs(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1)))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " ")))

    # bound once, in an array of one; as a plain expression the words would be cut for every run
    of_words = F.transform(F.array(F.split(plain, " ")), runs)[0]
    return F.when(F.coalesce(F.length(plain), F.lit(0)) > 0, of_words).otherwise(F.array().cast("array<string>"))


def _probes(hashes: np.ndarray, log2: int) -> Iterator[np.ndarray]:
    """Four bits for each hash."""
    x, mask = hashes, np.uint64((1 << log2) - 1)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(factor)
        x = x ^ (x >> np.uint64(32))
        yield x & mask
        yield (x >> np.uint64(32)) & mask


def item_filter(items: DataFrame, item: str, n: int) -> Broadcast:
    """A Bloom filter of a column of about n strings."""
    return hash_filter(items.select(F.xxhash64(item)), n)


def hash_filter(hashes: DataFrame, n: int) -> Broadcast:
    """A Bloom filter of about n 64-bit hashes: tasks set bits, which are joined by word before the driver sees them."""
    log2 = min(_MOST_BITS, max(10, int(n * _BITS_AN_ITEM).bit_length()))

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(1 << (log2 - 6), np.uint64)
        for batch in batches:
            for bit in _probes(batch.column(0).to_numpy().view(np.uint64), log2):
                np.bitwise_or.at(words, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words[some].view(np.int64))], names=["word", "bits"])

    parts = hashes.mapInArrow(set_bits, "word long, bits long")
    found = parts.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (log2 - 6), np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(words)


def in_filter(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which hashes the filter has, and a few others."""
    keep = np.ones(len(hashes), bool)
    for bit in _probes(hashes, len(words).bit_length() + 5):
        keep &= (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
    return keep


def known_items(rows: DataFrame, key: str, known: Broadcast) -> DataFrame:
    """(key, __n, __item): the items of rows (key, items) that the filter has, and a few others, and how many each row has.

    Strings are hashed in the JVM; a task looks up whole batches of hashes.
    """

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value
        for batch in batches:
            ids, items, hashes = batch.columns
            many = items.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = hashes.flatten().to_numpy().view(np.uint64)
            at = np.flatnonzero(in_filter(flat, words))
            owner = np.repeat(np.arange(len(many)), many)[at]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(many[owner].astype(np.int32)), items.flatten().take(pa.array(at))], names=[key, "__n", "__item"])

    hashed = rows.select(key, "items", F.transform("items", lambda s: F.xxhash64(s)).alias("__hashes"))
    return hashed.mapInArrow(kept, f"`{key}` {rows.schema[key].dataType.simpleString()}, __n int, __item string")


def overlaps(pool: DataFrame, pool_id: str, bench: DataFrame, bench_id: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(pool_id, bench_id, inter, n, m): all pairs that share elements of ``items``, how many, and how many each has.

    A benchmark whose items have at most broadcast_bytes goes to the pool, whose rows then stay
    where they are until their counts are known; else both are joined by item, and the items
    that a great part of the rows has are split.
    """
    work = Workspace(pool.sparkSession, "overlap")
    right = bench.select(bench_id, F.size("items").alias("__m"), "items").select(bench_id, "__m", F.explode("items").alias("__item"))
    right = work.write(right, "bench")
    n, size = right.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("__item") + 24), F.lit(0))).first()
    left = known_items(pool, pool_id, item_filter(right, "__item", n))
    if size <= broadcast_bytes:
        met = left.join(F.broadcast(right), "__item")
    else:
        left = work.write(left, "pool")
        many = max(HOT_LEAST, left.count() // HOT_ITEMS)
        hot = work.write(left.groupBy("__item").agg(F.count(F.lit(1)).alias("__many")).where(F.col("__many") > many).select("__item", F.lit(True).alias("__hot")), "hot")
        part = F.when(F.col("__hot"), F.pmod(F.xxhash64(pool_id), F.lit(SPLIT))).otherwise(0).cast("int")
        left = left.join(F.broadcast(hot), "__item", "left").withColumn("__part", part).drop("__hot")
        copies = F.sequence(F.lit(0), F.when(F.col("__hot"), SPLIT - 1).otherwise(0))
        met = left.join(right.join(F.broadcast(hot), "__item", "left").withColumn("__part", F.explode(copies)).drop("__hot"), ["__item", "__part"])
    return met.groupBy(pool_id, bench_id).agg(F.count(F.lit(1)).alias("inter"), F.max("__n").alias("n"), F.max("__m").alias("m"))


def shared(pool: DataFrame, pool_id: str, bench: DataFrame, bench_id: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(pool_id, bench_id, inter, n_union) of all pairs that share an element of ``items``."""
    met = overlaps(pool, pool_id, bench, bench_id, broadcast_bytes)
    return met.select(pool_id, bench_id, "inter", (F.col("n") + F.col("m") - F.col("inter")).cast("long").alias("n_union"))


def contained(pool: DataFrame, pool_id: str, bench: DataFrame, bench_id: str, least: float = 0.8) -> DataFrame:
    """(pool_id, bench_id, inter, containment): pairs where a pool row has at least that share of a benchmark row's set."""
    share = (F.col("inter") / F.col("m")).alias("containment")
    return overlaps(pool, pool_id, bench, bench_id).select(pool_id, bench_id, "inter", share).where(F.col("containment") >= least)


def best_match(pairs: DataFrame, pool_id: str, bench_id: str) -> DataFrame:
    """For each benchmark row the pair of the largest similarity, ties to the smallest pool id."""
    best = pairs.groupBy(bench_id).agg(F.max(F.struct((F.col("inter") / F.col("n_union")).alias("sim"), (-F.col(pool_id)).alias("at"), "inter", "n_union")).alias("m"))
    return best.select(bench_id, (-F.col("m.at")).alias(pool_id), F.col("m.inter").alias("inter"), F.col("m.n_union").alias("n_union"))


def accepted(option_sim: Column, stem_sim: Column, generic: Column, least: float = 0.6, least_generic: float = 0.5) -> Column:
    """Whether shared options make a match; sets that many questions have need a similar stem."""
    return (option_sim >= least) & (~generic | (stem_sim >= least_generic))
