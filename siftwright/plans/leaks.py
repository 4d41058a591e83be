"""Queries of near copies among documents: bands for thresholds, held against exact pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.functions.hashed import hashed_shingles
from siftwright.functions.text import plain_words
from siftwright.operators.lsh import MISSED, Sets, best_bands
from siftwright.plans.registry import _query, _runs_sql, _table

# The thresholds of a sweep.
THRESHOLDS = (1.0, 0.9, 0.8, 0.7)
#: What the sweep promises: the share of exact pairs that bands find, and how far estimates are off on average.
LEAST_FOUND, MOST_OFF = 0.9, 0.04

_NEAR = f"""d AS ({_runs_sql("documents", "doc_id")}), n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter FROM d x JOIN d y ON x.item = y.item AND x.doc_id < y.doc_id GROUP BY ALL),
sims AS (SELECT a, b, inter / (p.n + q.n - inter) AS sim FROM met JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b)"""


def near_copies(sets: Sets, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, a, b, copies_a, copies_b, jaccard, estimate, found): exact pairs of classes, and whether bands for the threshold find them."""
    exact = sets.work.write(sets.compared(sets.similar(min(thresholds))), "exact")

    def at(t: float) -> DataFrame:
        met = sets.candidates(t).withColumn("found", F.lit(True))
        return exact.where(F.col("jaccard") >= t).join(met, ["a", "b"], "left").select(F.lit(t).alias("threshold"), *exact.columns, F.coalesce("found", F.lit(False)).alias("found"))

    return sets.work.write(reduce(DataFrame.unionByName, map(at, thresholds)), "swept")


def swept(sets: Sets, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """For each threshold its bands, exact pairs and documents in them, the share found, and the mean error of the estimates.

    Equal documents are pairs that every banding finds.
    """
    pairs = near_copies(sets, thresholds)
    many = sets.classes.agg(F.sum(F.col("copies") * (F.col("copies") - 1) / 2).cast("long").alias("same"))
    ends = pairs.select("threshold", F.inline(F.array(F.struct(F.col("a").alias("id"), F.col("copies_a").alias("copies")), F.struct(F.col("b").alias("id"), F.col("copies_b").alias("copies")))))
    each = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    # a document is in a pair through its class, or through its copies
    alone = sets.classes.where("copies > 1").select(each, "id", "copies")
    documents = ends.unionByName(alone).distinct().groupBy("threshold").agg(F.sum("copies").alias("documents"))
    weight = F.col("copies_a") * F.col("copies_b")
    sums = pairs.groupBy("threshold").agg(F.sum(weight).alias("near"), F.sum(F.when(F.col("found"), weight).otherwise(0)).alias("met"), F.avg(F.abs(F.col("estimate") - F.col("jaccard"))).alias("off"))
    shapes = sets.classes.sparkSession.createDataFrame([(t, *best_bands(t, missed=MISSED)) for t in thresholds], "threshold double, bands int, band_slots int")
    rows = F.broadcast(shapes).join(sums, "threshold", "left").join(documents, "threshold", "left").join(F.broadcast(many))
    total = F.coalesce("near", F.lit(0)) + F.coalesce("same", F.lit(0))
    found = F.try_divide(F.coalesce("met", F.lit(0)) + F.coalesce("same", F.lit(0)), total)
    return rows.select("threshold", "bands", "band_slots", total.alias("pairs"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce(found, F.lit(1.0)).alias("found"), F.coalesce("off", F.lit(0.0)).alias("off"))


def _bands_sql() -> str:
    return "shapes(threshold, bands, band_slots) AS (VALUES " + ", ".join(f"({t}::DOUBLE, {b}, {r})" for t in THRESHOLDS for b, r in [best_bands(t, missed=MISSED)]) + ")"


@_query(
    f"""WITH {_NEAR}, {_bands_sql()}, pairs AS (SELECT threshold, a, b FROM shapes JOIN sims ON sim >= threshold),
ends AS (SELECT threshold, count(DISTINCT id) AS documents FROM (SELECT threshold, a AS id FROM pairs UNION ALL SELECT threshold, b FROM pairs) GROUP BY threshold)
SELECT threshold, bands, band_slots, (SELECT count(*) FROM pairs p WHERE p.threshold = s.threshold) AS pairs, CAST(coalesce(documents, 0) AS BIGINT) AS documents, true AS enough_found, true AS estimates_close
FROM shapes s LEFT JOIN ends USING (threshold)"""
)
def lsh_sweep(spark, sf_dir):
    """Near copies among all documents at each threshold: exact pairs, and whether bands and estimates keep what they promise."""
    rows = swept(Sets(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", hashed_shingles(plain_words(F.col("text")), 4)))
    return rows.select("threshold", "bands", "band_slots", "pairs", "documents", (F.col("found") >= LEAST_FOUND).alias("enough_found"), (F.col("off") <= MOST_OFF).alias("estimates_close"))
