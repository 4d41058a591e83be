"""The registered queries of this subpackage: thin calls of its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import corpus_pipeline
from siftwright.llm import centroids, decontaminate, embedding_dedup, hard_negatives, mixing, ngram_join
from siftwright.llm.classify import fit_language, fit_quality, identify_language, score_quality
from siftwright.llm.decontaminate import find_contamination
from siftwright.llm.embedding_dedup import near_duplicates
from siftwright.llm.hard_negatives import mine_hard_negatives
from siftwright.llm.line_dedup import dedup_lines
from siftwright.llm.mixing import mix_sources
from siftwright.llm.ngram_join import jaccard_components
from siftwright.llm.ngram_lm import score_texts
from siftwright.llm.pii import KINDS, find_pii, listed
from siftwright.llm.token_count import count_tokens
from siftwright.llm.warc import round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(_table(spark, sf_dir, "documents"), "byte_bpe_50k.json", keep=["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


@_query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, _table(spark, sf_dir, "labels")), keep=["doc_id"])


@_query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return identify_language(docs, fit_language(docs), keep=["doc_id"])


@_query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


ORACLES["op4_decontamination"] = decontaminate.SQL


@_query
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


ORACLES["op7_ngram_jaccard"] = ngram_join.SQL


@_query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("n_tokens"))
    return mix_sources(docs, tokens=F.col("n_tokens"))


ORACLES["op6_mixing"] = mixing.SQL


@_query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "embeddings"))


ORACLES["op3_embedding_dedup"] = embedding_dedup.SQL


@_query
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"), keep=["doc_id"])


@_query
def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("pii", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))


@_query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine_hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", moved), vec_id % 100 == 0)


ORACLES["op12_hard_negatives"] = hard_negatives.SQL


@_query
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, final = centroids.cluster(_table(spark, sf_dir, "embeddings"))
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256")
    # a row for each centroid
    of_each = final.join(sums, "cluster").select("cluster", "cluster_inertia", F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0))).alias("inertia"), digest)
    return assigned.join(F.broadcast(of_each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


ORACLES["op13_centroids"] = centroids.SQL


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
