"""MinHash signatures, bands for a threshold, and pairs of near sets found by them or exactly.

Equal sets are one class first, so copies never meet each other. A crowded bucket is dealt to
tasks as pairs of its parts. Candidates are ids; sets meet only to be verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from siftwright.functions.hashed import in_pieces, lists, mix
from siftwright.operators.overlap import BROADCAST_BYTES, hash_filter, in_filter
from siftwright.sources.shared import Workspace

SLOTS = 128
MISSED = 0.95  # weight of pairs missed against needless ones, where candidates are verified
PART = 256  # members of a part of a bucket, about
PART_ITEMS = 1 << 19  # items that meet in a task at once, about
FEW = 64  # rows of an item that meet where it is, at most
TOLD_BY, OFTEN = 8, 3  # one of so many sets tells which items are frequent; those of so many of them
BATCH = 1000  # sets that Python sees at once
_AT_ONCE, _PAIRS_AT_ONCE = 1 << 13, 1 << 17


@F.arrow_udf(ArrayType(LongType()))
def _signature(hashes: pa.Array) -> pa.Array:
    """The least value of each set's 64-bit hashes under each of 128 permutations."""
    random = np.random.default_rng(12)
    factors = random.integers(1, 2**63, SLOTS, dtype=np.uint64) | np.uint64(1)
    shifts = random.integers(0, 2**63, SLOTS, dtype=np.uint64)
    flat = hashes.flatten().to_numpy().view(np.uint64)
    many = hashes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    least = np.empty((SLOTS, int((many > 0).sum())), np.uint64)
    begins = np.concatenate([[0], np.cumsum(many[many > 0])])[:-1].astype(np.int64)
    for k in range(SLOTS if len(flat) else 0):
        y = flat * factors[k] + shifts[k]
        y ^= y >> np.uint64(29)
        y *= np.uint64(0xBF58476D1CE4E5B9)
        y ^= y >> np.uint64(32)
        least[k] = np.minimum.reduceat(y, begins)
    ends = np.concatenate([[0], np.cumsum(np.where(many > 0, SLOTS, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(least.T.ravel().view(np.int64)))


def signature(items: Column) -> Column:
    """128 minima of a set of strings, none for an empty set; strings are hashed once, in the JVM."""
    return F.coalesce(_signature(F.transform(items, lambda s: F.xxhash64(s))), F.array().cast("array<long>"))


def estimate(a: Column, b: Column) -> Column:
    """The share of equal slots of two signatures, which estimates the similarity of their sets."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, e: s + e) / F.greatest(F.size(a), F.lit(1))


def bands_for(least: float, slots: int = SLOTS, recall: float = 0.999) -> int:
    """The most slots in a band such that a pair of similarity ``least`` meets with chance ``recall`` in some band."""
    return max(r for r in range(1, slots + 1) if r == 1 or (slots % r == 0 and 1 - (1 - least**r) ** (slots // r) >= recall))


@lru_cache
def best_bands(threshold: float, slots: int = SLOTS, missed: float = 0.5) -> tuple[int, int]:
    """(bands, slots in a band) with the smallest weighted area of chances that are wrong.

    Below the threshold it is wrong to meet, from it on not to; ``missed`` is the weight of
    the latter. Areas are those below the curve 1 - (1 - s**r)**b of a similarity s.
    """
    below, above = np.linspace(0, threshold, 513), np.linspace(threshold, 1, 513)

    def wrong(b: int, r: int) -> float:
        meets = lambda s: 1 - (1 - s**r) ** b
        return (1 - missed) * np.trapezoid(meets(below), below) + missed * np.trapezoid(1 - meets(above), above)

    return min(((b, r) for r in range(1, slots + 1) for b in range(1, slots // r + 1)), key=lambda x: (wrong(*x), x))


def banded(signed: DataFrame, key: str, bands: int, rows: int) -> DataFrame:
    """signed (key, signature, ...) once for each band, with ``bucket``, a hash of the band's slots; sets without a signature are out."""
    each = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice("signature", b * rows + 1, rows)))
    return signed.where(F.size("signature") > 0).select(key, F.explode(each).alias("bucket"))


def verified_candidates(pool: DataFrame, pool_id: str, bench: DataFrame, bench_id: str, least: float, slots: int = SLOTS) -> DataFrame:
    """(pool_id, bench_id, jaccard) of pairs that agree in a band and are at least that similar.

    Signatures are cut into bands for ``least``; only ids meet, and the sets of the pairs
    that met are compared exactly.
    """
    rows, work = bands_for(least, slots), Workspace(pool.sparkSession, "candidates")
    # read three times: for signatures, and for the pairs
    pool, bench = work.write(pool.select(pool_id, "items"), "pool"), work.write(bench.select(bench_id, "items"), "bench")

    def signed(side: DataFrame, key: str) -> DataFrame:
        return banded(work.write(side.select(key, signature(F.col("items")).alias("signature")), f"signed-{key}"), key, slots // rows, rows)

    met = signed(pool, pool_id).join(signed(bench, bench_id), "bucket").select(pool_id, bench_id).distinct()
    sets = met.join(pool.select(pool_id, F.col("items").alias("__x")), pool_id).join(bench.select(bench_id, F.col("items").alias("__y")), bench_id)
    return sets.select(pool_id, bench_id, _jaccard("__x", "__y").alias("jaccard")).where(F.col("jaccard") >= least)


def _jaccard(x: str, y: str) -> Column:
    both = F.size(F.array_intersect(x, y))
    return both / F.greatest(F.size(x) + F.size(y) - both, F.lit(1))


def pairs_within(rows: DataFrame, part: int = PART) -> DataFrame:
    """(group, a, b) with a < b for each two of rows (group, id) that share a group.

    A group of many is cut into parts by hash, and each two parts meet as a key of their own,
    so that no task has more than two parts' pairs to make at a time. Where rows have ``prev``,
    another group of theirs or null, two of the same one are left to that.
    """
    known = [c for c in rows.columns if c == "prev"]
    sizes = rows.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"), F.count(F.lit(1)).alias("n")).where("n > 1")
    own = rows.join(sizes.select("group", "parts"), "group").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = own.select("group", "id", "part", *known, other.alias("with")).select("group", "id", "part", *known, F.least("part", "with").alias("lo"), F.greatest("part", "with").alias("hi"))
    right = dealt.select("group", "lo", "hi", F.col("id").alias("b"), F.col("part").alias("part_b"), *(F.col(c).alias(f"{c}_b") for c in known))
    new = F.coalesce(F.col("prev") != F.col("prev_b"), F.lit(True)) if known else F.lit(True)
    met = dealt.join(right, ["group", "lo", "hi"]).where(new & (F.col("id") < F.col("b")) & ((F.col("lo") == F.col("hi")) | (F.col("part") != F.col("part_b"))))
    return met.select("group", F.col("id").alias("a"), "b")


def _minima(flat: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The least value of each set's hashes, 32 bits of them, under each of 128 permutations, one set after another; none for an empty set."""
    random = np.random.default_rng(12)
    factors = random.integers(1, 2**32, SLOTS, dtype=np.uint32) | np.uint32(1)
    shifts = random.integers(0, 2**32, SLOTS, dtype=np.uint32)
    small, many = (flat.view(np.uint64) >> np.uint64(32)).astype(np.uint32), many[many > 0]
    ends, least, lo = np.cumsum(many), np.empty((len(many), SLOTS), np.uint32), 0
    while lo < len(many):  # a few sets at once, which stay in a core's cache
        begin = ends[lo] - many[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, begin + _AT_ONCE, "right")))
        some, begins = small[begin : ends[hi - 1]], ends[lo:hi] - many[lo:hi] - begin
        y = np.empty_like(some)
        for k in range(SLOTS):
            np.multiply(some, factors[k], out=y)
            y += shifts[k]
            least[lo:hi, k] = np.minimum.reduceat(y, begins)
        lo = hi
    return least.ravel().view(np.int32)


def _flat(items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values, and how many each list has."""
    return items.flatten().to_numpy(), items.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _told(items: pa.Array) -> pa.Array:
    """How large each set of 64-bit hashes is, 128 bits that tell it, and a signature of 32 bits a slot."""
    flat, many = _flat(items)
    begins = (np.cumsum(many) - many)[many > 0]
    keys = [np.zeros(len(many), np.uint64) for _ in range(2)]
    for key, salt in zip(keys, (0x2545F4914F6CDD1D, 0xD1342543DE82EF95)):
        if len(begins):
            key[many > 0] = mix(np.add.reduceat(mix(flat.view(np.uint64) ^ np.uint64(salt)), begins))
    signed = lists(_minima(flat, many), np.where(many > 0, SLOTS, 0))
    return pa.StructArray.from_arrays([pa.array(many.astype(np.int32)), *(pa.array(k.view(np.int64)) for k in keys), signed], names=["n", "k1", "k2", "signature"])


@F.arrow_udf(StructType().add("n", IntegerType()).add("k1", LongType()).add("k2", LongType()).add("signature", ArrayType(IntegerType())))
def _described(items: pa.Array) -> pa.Array:
    return in_pieces(_told, items)


def _lowest(least: float) -> Callable[[Column], Column]:
    """Of each set the items among which its first ones at that similarity surely are but for frequent items: twice their share of all numbers."""
    bound = np.int64(min(2**63 - 1, round(-(2**63) + 2**64 * min(1.0, 2 * (1 - least)))))

    def of_piece(items: pa.Array) -> pa.Array:
        flat, many = _flat(items)
        kept = flat <= bound
        return lists(flat[kept], np.bincount(np.repeat(np.arange(len(many)), many)[kept], minlength=len(many)))

    @F.arrow_udf(ArrayType(LongType()))
    def lowest(items: pa.Array) -> pa.Array:
        return in_pieces(of_piece, items)

    return lowest


def _first_items(least: float, frequent: Broadcast) -> Callable[[Column], Column]:
    """The first n - ceil(least * n) + 1 items of each set, by number, those that the filter has last."""

    def of_piece(items: pa.Array) -> pa.Array:
        flat, many = _flat(items)
        owner, begins = np.repeat(np.arange(len(many)), many), np.cumsum(many) - many
        late = in_filter(flat.view(np.uint64), frequent.value)
        before = np.concatenate([[0], np.cumsum(late)])  # late items before each place
        rare, place = many - (before[begins + many] - before[begins]), np.arange(len(flat)) - begins[owner]
        behind = before[:-1] - before[begins][owner]
        nth = np.where(late, rare[owner] + behind, place - behind)
        kept = nth < (many - np.ceil(least * many - 1e-9).astype(np.int64) + 1)[owner]
        return lists(flat[kept], np.bincount(owner[kept], minlength=len(many)))

    @F.arrow_udf(ArrayType(LongType()))
    def first(items: pa.Array) -> pa.Array:
        return in_pieces(of_piece, items)

    return first


def _dealt(parts: int):
    """Rows (id, items) as items and their ids, those of a part together."""

    def together(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        flat, ids = (np.concatenate(x) for x in zip(*held))
        part = (flat.view(np.uint64) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        own, n = np.unique(part, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), lists(flat[order], n), lists(ids[order], n)], names=["part", "items", "ids"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            flat, many = _flat(batch.column(1))
            held.append((flat, np.repeat(batch.column(0).to_numpy(zero_copy_only=False), many)))
            n += len(flat)
            if n > PART_ITEMS:
                yield together(held)
                held, n = [], 0
        if n:
            yield together(held)

    return deal


def _counted(pairs: list[np.ndarray]) -> np.ndarray:
    """Columns (a, b, times), a pair once each with its times summed."""
    both = np.concatenate(pairs, axis=1)
    both = both[:, np.lexsort(both[:2])]
    new = np.flatnonzero(np.concatenate([[True], (both[:2, 1:] != both[:2, :-1]).any(axis=0)])) if both.shape[1] else np.zeros(0, np.int64)
    return np.vstack([both[:2, new], np.add.reduceat(both[2], new)]) if len(new) else both


def _met(few: int):
    """Of a part: the pairs of ids that share items of few rows, and how many; rows of other items as (item, id)."""

    def meet(part: pa.Table) -> pa.Table:
        items, ids = (np.concatenate([c.flatten().to_numpy() for c in part.column(k).chunks]) for k in ("items", "ids"))
        order = np.lexsort((ids, items))
        items, ids = items[order], ids[order]
        begins = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]])) if len(items) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(begins, len(items)))
        found, held = [np.zeros((3, 0), np.int64)], 0
        for n in np.unique(sizes[(sizes > 1) & (sizes <= few)]):
            low, high = np.triu_indices(n, 1)
            at = begins[sizes == n]
            step = max(1, _PAIRS_AT_ONCE // len(low))
            for lo in range(0, len(at), step):
                rows = ids[at[lo : lo + step, None] + np.arange(n)]
                found.append(np.stack([rows[:, low].ravel(), rows[:, high].ravel(), np.ones(len(rows) * len(low), np.int64)]))
                held += found[-1].shape[1]
                if held > max(4 * _PAIRS_AT_ONCE, found[0].shape[1]):
                    found, held = [_counted(found)], 0
        pairs, many = _counted(found), np.repeat(sizes > few, sizes)
        pairs = pairs[:, pairs[0] != pairs[1]]
        n, crowd = pairs.shape[1], np.arange(pairs.shape[1] + many.sum()) >= pairs.shape[1]
        columns = {"a": np.append(pairs[0], ids[many]), "b": np.append(pairs[1], ids[many]), "times": np.append(pairs[2], ids[many]), "item": np.append(np.zeros(n, np.int64), items[many])}
        return pa.table({k: pa.array(v, mask={"a": None, "item": ~crowd}.get(k, crowd)) for k, v in columns.items()})

    return meet


def _against_one(group: pa.Table) -> pa.Table:
    """(a, b, jaccard, estimate) of the set that is a against each other of its group."""
    group = group.combine_chunks()
    ids, a = group.column("id").to_numpy(), group.column("a")[0].as_py()
    flat, many = _flat(group.column("items").combine_chunks())
    signed = group.column("signature").combine_chunks().flatten().to_numpy().reshape(-1, SLOTS)
    own, begins = int(np.flatnonzero(ids == a)[0]), np.cumsum(many) - many
    mine = flat[begins[own] : begins[own] + many[own]]
    both = np.add.reduceat(mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat, begins, dtype=np.int64)
    others = ids != a
    jaccard = both / (many + len(mine) - both)
    return pa.table({"a": pa.array(np.full(others.sum(), a)), "b": pa.array(ids[others]), "jaccard": pa.array(jaccard[others]), "estimate": pa.array((signed == signed[own]).mean(axis=1)[others])})


class _ShortBatches(Workspace):
    """Tables whose rows Python sees a thousand at a time, since a set takes kilobytes."""

    def write(self, df: DataFrame, name: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, str(BATCH))
        try:
            return super().write(df, name)
        finally:
            self.spark.conf.set(key, before)


class Sets:
    """Sets of items with their signatures, computed once; equal sets are one class.

    Sets are never kept: they are made of their rows again where they are looked at, so that
    no more than a part of their items is written or shuffled at a time.
    """

    def __init__(self, rows: DataFrame, key: str, items: Column | None = None):
        """key is a 64-bit number; items, else the column ``items``, are distinct strings, or sorted 64-bit hashes of such.

        Rows without a key or items are in no class.
        """
        items = F.col("items") if items is None else items
        if rows.select(items.alias("items")).schema["items"].dataType == ArrayType(StringType()):
            items = F.array_sort(F.transform(items, lambda s: F.xxhash64(s)))
        self.work, self.items = _ShortBatches(rows.sparkSession, "lsh"), items
        self.rows = rows.where(F.col(key).isNotNull()).withColumn("__id", F.col(key).cast("long"))
        told = self.rows.select(F.col("__id").alias("id"), _described(items).alias("told")).select("id", "told.*")
        # a set is told by 128 bits; read from the table, a condition makes no set twice
        self.members = self.work.write(told, "members").where("n > 0")
        firsts = self.members.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"))
        self.classes = self.work.write(firsts, "classes")
        more = self.classes.where("copies > 1").select("k1", "k2", F.col("id").alias("first"))
        self.others = self.work.write(self.members.select("id", "k1", "k2").join(more, ["k1", "k2"]).where("id > first").select("id"), "others")

    def _firsts(self, rows: DataFrame, key: str) -> DataFrame:
        """One row of each class."""
        return rows.join(_small(self.others.withColumnRenamed("id", key)), key, "left_anti")

    def _sharing(self, rows: DataFrame, n: int, name: str) -> tuple[DataFrame, DataFrame]:
        """(a, b, times), once each: a < b of rows (id, items), n items together, that share an item; and (id, crowded).

        Items are dealt to parts of bounded size. Those of few rows meet there, and times counts
        them for each pair. Rows of crowded ones, which each id's crowded counts, are paired
        out, but not where the item before theirs has made the same pair.
        """
        cores = rows.sparkSession.sparkContext.defaultParallelism
        parts = max(cores, -(-n // PART_ITEMS))
        dealt = rows.mapInArrow(_dealt(parts), "part int, items array<long>, ids array<long>")
        met = self.work.write(dealt.groupBy("part").applyInArrow(_met(FEW), "a long, b long, times long, item long"), name)
        crowded = met.where("item is not null").select(F.col("item").alias("group"), F.col("a").alias("id"))
        pairs = pairs_within(crowded.withColumn("prev", F.lag("group").over(Window.partitionBy("id").orderBy("group"))))
        pairs = met.where("item is null").select("a", "b", "times").unionByName(pairs.select("a", "b", F.lit(0).cast("long").alias("times")))
        return pairs.groupBy("a", "b").agg(F.sum("times").alias("times")), crowded.groupBy("id").agg(F.count(F.lit(1)).alias("crowded"))

    def candidates(self, threshold: float, missed: float = MISSED) -> DataFrame:
        """(a, b), once each: classes that meet in a band of those best for the threshold."""
        bands, slots = best_bands(threshold, missed=missed)
        buckets = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice("signature", b * slots + 1, slots)))
        return self._sharing(self._firsts(self.members.select("id", buckets.alias("items")), "id"), self.classes.count() * bands, f"met-{threshold}")[0].select("a", "b")

    def similar(self, least: float) -> DataFrame:
        """(a, b), once each: a superset of all pairs at least that similar, by their first items.

        In any one order of all items, two such sets share one of the first n - ceil(least * n) + 1
        items of the one with n items, and of the other. The order is that of the hashes, but
        that frequent items come last. An eighth of the sets says which ones are frequent; what
        they say decides how much work there is, never what is found. Pairs whose first items
        leave no room for the similarity are out.
        """
        firsts = self._firsts(self.rows, "__id")
        some = firsts.where(F.pmod(F.xxhash64("__id"), F.lit(TOLD_BY)) == 0).select(F.explode(_lowest(least)(self.items)).alias("item"))
        often = self.work.write(some.groupBy("item").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= OFTEN).select("item"), f"often-{least}")
        frequent = hash_filter(often, often.count())
        n = self.classes.agg(F.coalesce(F.sum(F.floor((1 - least) * F.col("n")) + 1), F.lit(0)).cast("long")).first()[0]
        met, crowded = self._sharing(firsts.select(F.col("__id").alias("id"), _first_items(least, frequent)(self.items).alias("items")), n, f"first-{least}")
        sizes, crowded = _small(self.classes.select("id", "n")), _small(self.work.write(crowded, f"crowded-{least}"))
        for side in "ab":
            met = met.join(sizes.withColumnsRenamed({"id": side, "n": f"n_{side}"}), side).join(crowded.withColumnsRenamed({"id": side, "crowded": f"crowded_{side}"}), side, "left")
        # of all items that two sets share, those up to the last first item of one are first items of both
        rest = lambda side: F.ceil(F.lit(least) * F.col(f"n_{side}") - F.lit(1e-9)) - 1
        most = F.col("times") + F.least(*(F.coalesce(f"crowded_{c}", F.lit(0)) for c in "ab")) + F.greatest(rest("a"), rest("b"))
        asked = F.col("n_a") + F.col("n_b")
        return met.where((F.least("n_a", "n_b") >= F.lit(least) * F.greatest("n_a", "n_b") - F.lit(1e-9)) & (most >= asked * F.lit(least / (1 + least)) - F.lit(1e-6))).select("a", "b")

    def compared(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b), once each, with jaccard, estimate, and how many sets are in each class.

        A set goes to each set that it is compared with, and to itself; many of one are dealt to parts.
        """
        pairs = self.work.write(pairs, "pairs")
        parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
        links = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("__id"))
        links = self.work.write(links.unionByName(links.select("a", "part", F.col("a").alias("__id")).distinct()), "links")
        sets = self.rows.join(_small(links.select("__id").distinct()), "__id", "left_semi").select("__id", self.items.alias("items"), _described(self.items)["signature"].alias("signature"))
        met = self._firsts(sets, "__id").join(_small(links), "__id").select("a", "part", F.col("__id").alias("id"), "items", "signature")
        found = met.groupBy("a", "part").applyInArrow(_against_one, "a long, b long, jaccard double, estimate double")
        many = _small(self.classes.where("copies > 1").select("id", "copies"))
        for side in "ab":
            found = found.join(many.withColumnsRenamed({"id": side, "copies": f"copies_{side}"}), side, "left")
        return found.select("a", "b", *(F.coalesce(f"copies_{c}", F.lit(1)).alias(f"copies_{c}") for c in "ab"), "jaccard", "estimate")


def _small(df: DataFrame) -> DataFrame:
    """df, of a few numbers a row, marked for broadcast if its rows have few bytes together; else it is joined by a shuffle."""
    return F.broadcast(df) if df.count() * 8 * len(df.columns) <= BROADCAST_BYTES else df
