"""Vectors as files of bounded size, and the comparison of one set of them with another, tile by tile.

Tasks write the tiles and tasks read them; the driver sees how many there are, never a
vector or a name. A unit of work is a tile of one side with a few of the other's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.sources.shared import Workspace, load_arrays, save_arrays

TILE_BYTES = 4 << 20  # of a tile's vectors
PER_UNIT = 64  # tiles of the other side in a unit of work, at most
FAN = 64  # partial results of a row that are merged at once
CELLS = 1 << 20  # products held at once
_EXACT_AT_ONCE = 1 << 15
_SLACK = 1e-12  # more than a product's last digits can differ with its place in a matrix


def unit_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) of the comparable vectors of each length: not null, not zero, all components finite."""
    for at, x in matrices(column):
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt((x * x).sum(axis=1))
        sound = np.isfinite(norm) & (norm > 0)
        if sound.any():
            yield at[sound], x[sound] / norm[sound, None]


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of each length, of those without nulls and components."""
    if column.null_count or column.flatten().null_count:
        rows = [None if v is None or None in v else np.asarray(v, np.float64) for v in column.to_pylist()]
        lengths = np.array([0 if v is None else len(v) for v in rows])
        for d in np.unique(lengths[lengths > 0]):
            at = np.flatnonzero(lengths == d)
            yield at, np.stack([rows[i] for i in at])
        return
    begins = column.offsets.to_numpy()
    lengths, flat = np.diff(begins), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    for d in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == d)
        yield at, flat[begins[at][:, None] + np.arange(d)]


def store_tiles(rows: DataFrame, work: Workspace, name: str, tile_bytes: int = TILE_BYTES, unit: bool = True) -> DataFrame:
    """(tile, dim, n): files in work's folder ``name`` of rows (numbers..., vector).

    A file has an array for each column but the last, and ``v``, the vectors, made unit
    vectors if asked for; rows whose vector isn't comparable are in none. Each task fills its
    own tiles, so the last of each vector length may be small.
    """
    folder, columns = work.store_path(name), rows.columns[:-1]

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}

        def flush(d: int) -> pa.RecordBatch:
            *numbers, v = (np.concatenate(parts) for parts in zip(*held.pop(d), strict=True))
            file = save_arrays(folder, v=v, **dict(zip(columns, numbers, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([d], pa.int32()), pa.array([len(v)], pa.int64())], names=["tile", "dim", "n"])

        for batch in batches:
            numbers = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]]
            for at, v in (unit_rows if unit else matrices)(batch.columns[-1]):
                d = v.shape[1]
                most = max(1, tile_bytes // (8 * d))
                while len(at):
                    room = most - sum(len(x[-1]) for x in held.get(d, ()))
                    held.setdefault(d, []).append([*(n[at[:room]] for n in numbers), v[:room]])
                    at, v = at[room:], v[room:]
                    if sum(len(x[-1]) for x in held[d]) >= most:
                        yield flush(d)
        for d in list(held):
            yield flush(d)

    return work.write(rows.mapInArrow(store, "tile string, dim int, n long"), f"{name}-list")


def units(one: DataFrame, other: DataFrame, per_unit: int = PER_UNIT) -> tuple[DataFrame, int]:
    """Every tile of ``one`` with every tile of ``other`` of the same length, as rows (tile, dim, part, others), and the number of parts.

    others are at most about per_unit names; there are as many parts as that takes, or as
    keep all cores busy. Only names meet.
    """
    spark = one.sparkSession
    n_one, n_other = one.count(), other.count()
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, min(n_other, max(-(-n_other // per_unit), -(-4 * cores // max(n_one, 1)))))
    dealt = other.groupBy("dim", F.pmod(F.xxhash64("tile"), F.lit(parts)).cast("int").alias("part")).agg(F.collect_list("tile").alias("others"))
    each = one.select("tile", "dim", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    n_tasks = max(cores, min(n_one * parts, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return each.join(dealt, ["dim", "part"]).select("tile", "dim", "part", "others").repartition(n_tasks, "tile", "part"), parts


class _Best:
    """The k best products of each row so far; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.sims, self.ids = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, lo: int, x: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        """Compare rows lo, lo + 1, ... (x) with y."""
        k, n = self.k, len(x)
        rough = x @ y.T
        floor = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(n, -np.inf)
        i, j = np.nonzero(rough >= np.maximum(floor, self.sims[lo : lo + n, -1])[:, None] - _SLACK)
        # a product by itself doesn't depend on its place, so equal vectors tie
        sims = np.concatenate([(x[i[a : a + _EXACT_AT_ONCE]] * y[j[a : a + _EXACT_AT_ONCE]]).sum(axis=1) for a in range(0, len(i), _EXACT_AT_ONCE)] or [np.zeros(0)])
        row = np.concatenate([i, np.repeat(np.arange(n), k)])
        sims, own = np.concatenate([sims, self.sims[lo : lo + n].ravel()]), np.concatenate([ids[j], self.ids[lo : lo + n].ravel()])
        order = np.lexsort((own, -sims, row))
        nth = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        order = order[nth < k]
        self.sims[lo : lo + n], self.ids[lo : lo + n] = sims[order].reshape(n, k), own[order].reshape(n, k)


def _best_of_units(folder: str, other_folder: str, k: int):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.to_pylist():
                mine = load_arrays(folder, unit["tile"])
                found = _Best(len(mine["v"]), k)
                for name in unit["others"]:
                    theirs = load_arrays(other_folder, name)
                    wide = min(len(theirs["v"]), max(k + 1, CELLS // 1024))
                    for b in range(0, len(theirs["v"]), wide):
                        for a in range(0, len(mine["v"]), 1024):
                            found.add(a, mine["v"][a : a + 1024], theirs["id"][b : b + wide], theirs["v"][b : b + wide])
                row, nth = np.nonzero(np.isfinite(found.sims))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mine["id"][row]), pa.array(np.full(len(row), unit["part"], np.int32)), pa.array(found.sims[row, nth]), pa.array(found.ids[row, nth])], names=["id", "part", "sim", "other"]
                )

    return best


def best_k(queries: DataFrame, base: DataFrame, k: int, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(id, best) for every row of queries (id, vector): the k rows of base (id, vector) of the largest cosine.

    best is an array of (sim, other), the largest sim first, ties to the smaller id of base;
    fewer than k comparable rows are all there. Rows without an id, and vectors that are
    null, zero, or hold null or non-finite components, have no neighbours and are none;
    vectors of different lengths aren't compared. Queries that share an id are one row.
    """
    work = Workspace(queries.sparkSession, "nearest")

    def stored(rows: DataFrame, name: str) -> DataFrame:
        key, vector = rows.columns
        return store_tiles(rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>")), work, name, tile_bytes)

    mine, theirs = stored(queries, "queries"), stored(base, "base")
    work_units, parts = units(mine, theirs)
    found = work_units.mapInArrow(_best_of_units(work.store_path("queries"), work.store_path("base"), k), "id long, part int, sim double, other long")
    found = found.select("id", "part", F.struct("sim", (-F.col("other")).alias("at")).alias("m"))
    top = F.slice(F.sort_array(F.collect_list("m"), asc=False), 1, k).alias("m")  # of at most FAN * k
    while parts > FAN:
        merged = found.groupBy("id", F.floor(F.col("part") / FAN).cast("int").alias("part")).agg(top)
        found, parts = merged.select("id", "part", F.explode("m").alias("m")), -(-parts // FAN)
    turned = F.transform("m", lambda m: F.struct(m["sim"].alias("sim"), (-m["at"]).alias("other")))
    return found.groupBy("id").agg(top).select("id", turned.alias("best"))
