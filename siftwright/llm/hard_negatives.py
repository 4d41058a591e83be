"""Hard-negative mining: distributed radix selection over integer scores.

A window is what one selection is made from: for an anchor the rows of its label, for an
anchor and a positive the rows of other labels in a range of scores. Tasks count the scores
of each window in up to 256 buckets; summed, they tell the bucket that holds the last row
wanted, which the next round divides again, and where a single score has too many rows
their ids are divided in the same way. When few rows are left at or above the place found,
exactly these are gathered.

Anchors and rows are tiles of bounded bytes in the shared folder; a task scores a tile of
anchors against some tiles of rows and sends counts, never scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.llm.workspace import Workspace
from siftwright.operators.tiles import store_tiles, units
from siftwright.sources.shared import load_arrays

DIGIT = 8  # bits told apart in a round
GATHER = 64  # rows of a window that are gathered without dividing on
ANCHOR_BYTES = 256 << 10  # of a tile of anchors
ROW_BYTES = 2 << 20  # of a tile of rows
_CELLS = 1 << 20  # scores held at once
_STATE = "window int, slot int, same boolean, want int, top long, lo long, hi long, taken long, by_id boolean, id_lo long, id_hi long, shift int, done boolean"
_NAMES = [f.split()[0] for f in _STATE.split(", ")]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles."""
    most = a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0)
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    if most >= 2.0**62:
        raise OverflowError("a score doesn't fit in 64 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def _scans(folder: str, row_folder: str):
    """Units of work to (windows as arrays, anchors, the rows' ids, scores, which are in each window)."""

    def scans(batch: pa.RecordBatch) -> Iterator[tuple]:
        for unit in batch.to_pylist():
            anchors = load_arrays(folder, unit["tile"])
            w = {k: np.array([s[k] for s in unit["state"]]) for k in _NAMES}
            # windows of an anchor are layers, so that no step holds more than a tile's scores
            order = np.lexsort((w["window"], w["slot"]))
            layer = np.empty(len(order), np.int64)
            layer[order] = np.arange(len(order)) - np.searchsorted(w["slot"][order], w["slot"][order])

            def parts() -> Iterator[tuple]:
                for name in unit["others"]:
                    rows = load_arrays(row_folder, name)
                    wide = max(1, _CELLS // len(anchors["v"]))
                    for at in range(0, len(rows["v"]), wide):
                        label, key, ids = (rows[c][at : at + wide] for c in ("label", "key", "vec_id"))
                        scores = products(anchors["v"], rows["v"][at : at + wide])
                        for n in range(int(layer.max(initial=-1)) + 1):
                            own = np.flatnonzero(layer == n)
                            slot, here = w["slot"][own], scores[w["slot"][own]]
                            alike = anchors["label"][slot][:, None] == label[None, :]
                            into = alike == w["same"][own][:, None]
                            into &= anchors["key"][slot][:, None] != key[None, :]
                            yield own, here, into, ids

            yield unit["tile"], anchors, w, parts()

    return scans


def _count(folder: str, row_folder: str):
    scans = _scans(folder, row_folder)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, _, w, parts in scans(batch):
                held = np.zeros((len(w["window"]), 1 << DIGIT), np.int64)
                for own, scores, into, ids in parts:
                    lo, hi, shift = (w[c][own] for c in ("lo", "hi", "shift"))
                    i, j = np.nonzero(into & (scores >= lo[:, None]) & (scores <= hi[:, None]))
                    by_id = w["by_id"][own][i]
                    digit = np.where(by_id, ids[j] - w["id_lo"][own][i], hi[i] - scores[i, j])
                    fits = ~by_id | ((digit >= 0) & (ids[j] <= w["id_hi"][own][i]))
                    i, digit = i[fits], digit[fits] >> shift[i[fits]]
                    held[own] += np.bincount((i << DIGIT) + digit, minlength=len(own) << DIGIT).reshape(len(own), -1)
                at, bucket = np.nonzero(held)
                yield pa.RecordBatch.from_arrays([pa.array([tile] * len(at), pa.string()), pa.array(w["window"][at].astype(np.int32)), pa.array(bucket), pa.array(held[at, bucket])], names=["tile", "window", "bucket", "n"])

    return count


def _gather(folder: str, row_folder: str):
    scans = _scans(folder, row_folder)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, anchors, w, parts in scans(batch):
                for own, scores, into, ids in parts:
                    lo, top, by_id, id_hi = (w[c][own][:, None] for c in ("lo", "top", "by_id", "id_hi"))
                    into &= (scores >= lo) & (scores <= top)
                    into &= ~by_id | (scores > lo) | (ids[None, :] <= id_hi)
                    i, j = np.nonzero(into)
                    if len(i):
                        # rows that nothing tells apart are one with their number
                        found, n = np.unique(np.stack([i, scores[i, j], ids[j]]), axis=1, return_counts=True)
                        at = own[found[0]]
                        columns = [pa.array([tile] * len(at), pa.string()), *(pa.array(w[c][at].astype(np.int32)) for c in ("window", "slot")), pa.array(anchors["vec_id"][w["slot"][at]]), pa.array(found[1]), pa.array(found[2]), pa.array(n.astype(np.int64))]
                        yield pa.RecordBatch.from_arrays(columns, names=["tile", "window", "slot", "anchor_id", "score", "vec_id", "n"])

    return gather


def _bits(lo: Column, hi: Column) -> Column:
    """How far numbers from lo to hi are shifted to leave one digit."""
    return F.greatest(F.lit(0), F.length(F.bin(hi - lo)) - DIGIT).cast("int")


def _windows(rows: DataFrame, same: bool, want: int, lo: Column, hi: Column) -> DataFrame:
    """First states of windows (tile, window, slot)."""
    bounds = rows.withColumns({"lo": lo.cast("long"), "hi": hi.cast("long")}).where("lo <= hi")
    none = F.lit(0).cast("long")
    rest = {"same": F.lit(same), "want": F.lit(want), "top": F.col("hi"), "taken": none, "by_id": F.lit(False), "id_lo": none, "id_hi": none, "shift": _bits(F.col("lo"), F.col("hi")), "done": F.lit(False)}
    return bounds.withColumns(rest).select("tile", *_NAMES)


def _divided(state: DataFrame, counts: DataFrame, least_id: int, most_id: int) -> DataFrame:
    """The states after a round: the bucket that holds the last row wanted, or all if there are too few."""
    summed = counts.groupBy("tile", "window", "bucket").agg(F.sum("n").alias("n"))
    upto = F.col("taken") + F.sum("n").over(Window.partitionBy("tile", "window").orderBy("bucket"))
    cut = summed.join(state, ["tile", "window"]).withColumn("upto", upto).where(F.col("upto") - F.col("n") < F.col("want"))
    last = cut.groupBy("tile", "window").agg(F.max_by(F.struct("bucket", "n", "upto"), "bucket").alias("m"))
    rows = state.join(last, ["tile", "window"]).select("*", "m.*")  # windows without rows are gone
    enough, by_id = F.col("upto") >= F.col("want"), F.col("by_id")
    step, width = F.expr("shiftleft(bucket, shift)"), F.expr("shiftleft(1L, shift)")
    hi = F.when(enough & ~by_id, F.col("hi") - step).otherwise(F.col("hi"))
    lo = F.when(enough & ~by_id, F.greatest(F.col("lo"), F.col("hi") - step - width + 1)).otherwise(F.col("lo"))
    id_lo = F.when(enough & by_id, F.col("id_lo") + step).otherwise(F.col("id_lo"))
    id_hi = F.when(enough & by_id, F.least(F.col("id_hi"), F.col("id_lo") + step + width - 1)).otherwise(F.col("id_hi"))
    rows = rows.withColumns({"lo2": lo, "hi2": hi, "id_lo2": id_lo, "id_hi2": id_hi})
    done = ~enough | (F.col("upto") <= F.greatest(F.lit(GATHER), F.col("want"))) | (by_id & (F.col("id_lo2") == F.col("id_hi2")))
    turns = ~done & ~by_id & (F.col("lo2") == F.col("hi2"))  # one score: ids are divided next
    out = {
        "lo": F.col("lo2"),
        "hi": F.col("hi2"),
        "taken": F.col("upto") - F.col("n"),
        "by_id": by_id | turns,
        "id_lo": F.when(turns, F.lit(least_id)).otherwise(F.col("id_lo2")).cast("long"),
        "id_hi": F.when(turns, F.lit(most_id)).otherwise(F.col("id_hi2")).cast("long"),
        "done": done,
    }
    rows = rows.select("tile", *(out.get(c, F.col(c)).alias(c) for c in _NAMES if c != "shift"))
    shift = F.when(F.col("by_id"), _bits(F.col("id_lo"), F.col("id_hi"))).otherwise(_bits(F.col("lo"), F.col("hi")))
    return rows.withColumn("shift", shift).select("tile", *_NAMES)


def _selected(state: DataFrame, work: Workspace, name: str, pairs: DataFrame, ids: tuple[int, int]) -> DataFrame:
    """(tile, window, slot, anchor_id, score, vec_id, rank): the rows wanted of each window."""
    state, done, n = work.write(state, f"{name}-0"), [], 0
    spark = pairs.sparkSession
    n_tasks = max(1, min(pairs.count(), max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    folders = work.store_path("anchors"), work.store_path("rows")

    def dealt(states: DataFrame) -> DataFrame:
        own = states.groupBy("tile").agg(F.collect_list(F.struct(*_NAMES)).alias("state"))  # as many as a tile has windows
        # a unit is a task's work, however few bytes its names have
        return pairs.join(own, "tile").select("tile", "part", "others", "state").repartition(n_tasks, "tile", "part")

    while not state.isEmpty():
        counts = dealt(state).mapInArrow(_count(*folders), "tile string, window int, bucket long, n long")
        n += 1
        after = work.write(_divided(state, counts, *ids), f"{name}-{n}")
        done.append(after.where("done"))
        state = after.where("NOT done")
    if not done:
        return state.select("tile", "window", "slot", *(F.lit(0).cast("long").alias(c) for c in ("anchor_id", "score", "vec_id")), F.lit(1).alias("rank"))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    found = dealt(every).mapInArrow(_gather(*folders), "tile string, window int, slot int, anchor_id long, score long, vec_id long, n long")
    each = found.groupBy("tile", "window", "slot", "anchor_id", "score", "vec_id").agg(F.sum("n").alias("n"))
    want = every.agg(F.max("want")).first()[0]
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(want)).cast("int"))))
    rank = F.row_number().over(Window.partitionBy("tile", "window").orderBy(F.col("score").desc(), "vec_id"))
    found = each.withColumn("rank", rank).where(F.col("rank") <= want).drop("n", "copy")
    found = work.write(found, f"{name}-found")
    for k in range(n + 1):
        work.drop(f"{name}-{k}")
    return found


def _floor(a: Column, by: int) -> Column:
    return F.call_function("div", a - F.pmod(a, F.lit(by).cast("long")), F.lit(by).cast("long"))


def _sound(vector: Column) -> Column:
    whole = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(whole & (F.size(vector) > 0), F.lit(False))


def mine_hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (vec_id, embedding, label).

    Components become floor(scale * x); a score is the inner product of two rows, the higher
    the better, ties to the smaller vec_id. Rows for which ``anchor`` holds are anchors; their
    positives are the first other rows of the same label, and for each positive the rows of
    another label are returned whose score is from low to high per cent of the positive's,
    the first ``negatives`` of them.

    Defined results: rows without vec_id or label, and vectors that are null, empty or hold
    null or non-finite components take no part; vectors of different lengths aren't compared;
    a null ``anchor`` is none. Rows that share a vec_id are rows of their own, each an anchor,
    a positive or a negative by itself. Labels that aren't whole numbers are told apart by a
    64-bit hash. Scores beyond 64 bits are an error. An empty table gives no rows; other
    columns aren't read.
    """
    work = Workspace(vectors.sparkSession, "hard-negatives")
    whole = vectors.schema["label"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    label = F.col("label").cast("long") if whole else F.when(F.col("label").isNotNull(), F.xxhash64("label"))
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))
    held = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _sound(F.col("embedding").cast("array<double>")))
    rows = held.select(F.monotonically_increasing_id().alias("key"), F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), v.alias("v"))
    rows = work.write(rows, "vectors")
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, least, most, far = rows.agg(F.count(F.lit(1)), F.min("vec_id"), F.max("vec_id"), F.max(squares)).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    columns = ["key", "vec_id", "label", "v"]
    anchors = store_tiles(rows.where("anchor").select(*columns), work, "anchors", ANCHOR_BYTES, unit=False)
    pairs, _ = units(anchors, store_tiles(rows.select(*columns), work, "rows", ROW_BYTES, unit=False))
    pairs = work.write(pairs, "pairs")
    work.drop("vectors")
    bound = min(2**62, int(far * (1 + 1e-9)) + 1)  # no product is larger than the largest square
    slots = anchors.select("tile", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("slot")).withColumn("window", F.col("slot"))
    best = _selected(_windows(slots, True, positives, F.lit(-bound), F.lit(bound)), work, "positives", pairs, (least, most))
    score = F.col("score")
    # 100 times a score is compared with low and high times another one, in whole numbers
    per_positive = best.select("tile", "slot", (F.col("slot") * positives + F.col("rank") - 1).alias("window"), "score", "vec_id")
    found = _selected(_windows(per_positive, False, negatives, -_floor(-low * score, 100), _floor(high * score, 100)), work, "negatives", pairs, (least, most))
    for name in ("anchors", "rows", "pairs", "anchors-list", "rows-list"):
        work.drop(name)
    named = per_positive.select("tile", "window", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(named, ["tile", "window"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The registered query's rows in DuckDB.
SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 10
"""
