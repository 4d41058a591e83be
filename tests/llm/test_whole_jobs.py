"""Cases that an operator once left out."""

import corpus_pipeline
from pyspark.sql import functions as F

from siftwright.llm.classify import fit_quality, score_quality
from siftwright.llm.decontaminate import find_contamination
from siftwright.llm.warc import round_trip


def test_hits_do_not_depend_on_how_neighbours_lower_a_letter(spark):
    long = ["ΛΟΓΟΣ"] * 14
    items = spark.createDataFrame([(1, "ΟΔΟΣ.ΑΒ ΓΔ"), (2, " ".join(long))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "ΟΔΟΣ.ΑΒ ΓΔ"), (2, "οδος αβ γδ"), (3, ".".join(long))], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in find_contamination(docs, items).collect()}
    assert got == {1: (3, 3, True), 2: (3, 0, False), 3: (14, 14, True)}


def test_archives_give_back_urls_of_any_length(spark):
    urls = {1: "http://a/" + "ü" * 30_000, 2: "data:text/plain,%" + "x" * 200_000, 3: "http://a/" + "WARC/1.0\r\n" * 9000, 4: None, 5: "", 6: "http://a/" + "y" * ((1 << 15) - 9), 7: "http://a/" + "y" * ((1 << 15) - 8)}
    pages = spark.createDataFrame([(i, u, "page" if i < 3 else f"page {i}") for i, u in urls.items()], "page_id long, url string, html string")
    got = round_trip(pages, range_bytes=4096).collect()
    assert {r.page_id: r.url for r in got} == urls and len(got) == len(urls)
    assert {r.page_id: r.refers_to for r in got if r.record_type == "revisit"} == {1: 2}


def test_the_quality_stage_drops_what_the_classifier_rejects(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_quality(docs, fit_quality(docs, labels), keep=["doc_id"])
    want = sorted(r.doc_id for r in scored.where(F.col("predicted") == 1).collect())
    assert scored.where("score >= 0.5 AND predicted = 0").count() > 0
    assert sorted(r.doc_id for r in corpus_pipeline.quality(spark, docs, sf_dir).collect()) == want
