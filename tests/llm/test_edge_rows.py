"""Clashing column names, nulls, repeated rows and empty tables, for each operator."""

import base64
import hashlib
import math
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import siftwright.llm
from siftwright.llm import workspace
from siftwright.llm.classify import fit_language, fit_quality, identify_language, score_quality
from siftwright.llm.decontaminate import drop_contaminated, find_contamination
from siftwright.llm.embedding_dedup import near_duplicates
from siftwright.llm.line_dedup import dedup_lines
from siftwright.llm.mixing import mix_sources
from siftwright.llm.ngram_join import jaccard_components, keep_one_of_each
from siftwright.llm.ngram_lm import score_texts
from siftwright.llm.token_count import count_tokens, tokenizer_path
from siftwright.llm.warc import round_trip

RUN = "\n".join(f"line {i} " + "word " * 9 for i in range(6)).replace(" \n", "\n").strip()
# every name that an operator uses for itself, and some that it uses within
INTERNAL = {n for p in Path(siftwright.llm.__file__).parent.glob("*.py") for n in re.findall(r"[\"`](__\w+)[\"`]", p.read_text(encoding="utf-8"))} - {"__init__"}
CLASHES = [*sorted(INTERNAL | {"__score", "__lang", "__rejected"}),  "doc", "mark", "runs", "kept", "owner", "node", "component", "times", "key", "begin", "end", "n", "s"]


def _clashing(df, names=CLASHES):
    return df.select("*", *(F.lit(f"own {n}").alias(n) for n in names))


def _same_extras(rows, names=CLASHES):
    return all(r[n] == f"own {n}" for r in rows for n in names)


def test_lines_of_awkward_rows(spark):
    rows = [(1, RUN), (1, RUN), (1, "other\n" + RUN), (2, RUN + "\nend"), (None, "null id\n" + RUN), (3, None), (4, ""), (5, "x " * 100_000 + "\n" + RUN)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dedup_lines(_clashing(docs.withColumn("n_lines", F.lit("own")))).collect()
    assert len(got) == len(rows) and _same_extras(got)
    texts = {(r.doc_id, r.text) for r in got}
    assert (None, "null id\n" + RUN) in texts  # rows without an id come before all others
    assert {(2, "end"), (3, None), (4, ""), (5, "x " * 100_000), (1, "other")} <= texts
    assert [r.n_lines for r in got if r.doc_id == 3] == [0]
    assert dedup_lines(docs.limit(0)).count() == 0


def test_archives_of_awkward_rows(spark):
    rows = [(1, "u", "page"), (None, "u", "page"), (2, None, "page"), (2, None, "page"), (3, "v", None), (4, "w", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = round_trip(_clashing(pages, ["payload", "record_type", "refers_to", "payload_digest", "key", "at", "file"])).collect()
    assert len(got) == len(rows)
    for r in got:
        payload = "page" if r.page_id in (None, 1, 2) else ""
        assert r.payload_bytes == len(payload)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()
    assert {r.record_type for r in got if r.page_id in (1, None)} == {"revisit"} and {r.refers_to for r in got if r.page_id == 3} == {4}
    assert round_trip(pages.limit(0)).count() == 0


def test_vectors_with_clashing_names(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [float("nan"), 1.0], 1), (8, [1.0, 0.0], None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(_clashing(vectors)).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False)} | {i: (0, i, True) for i in range(3, 9)}
    assert near_duplicates(vectors.limit(0)).count() == 0


def test_contamination_and_joins_with_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (2, text), (2, text), (3, "clean words only"), (4, None), (None, "")], "doc_id long, text string")
    items = spark.createDataFrame([("a", text), ("b", None), ("c", ""), (None, "absent")], "item_id string, text string")
    got = find_contamination(_clashing(docs), _clashing(items)).collect()
    assert len(got) == 6 and {(r.doc_id, r.contaminated) for r in got} == {(1, True), (2, True), (3, False), (4, False), (None, False)}
    kept = drop_contaminated(_clashing(docs), items).collect()
    assert _same_extras(kept) and sorted(str(r.doc_id) for r in kept) == ["3", "4", "None"]
    assert {(r.doc_id, r.component_id) for r in jaccard_components(_clashing(docs)).collect()} >= {(1, 1), (2, 1), (3, 3), (4, 4)}
    once = keep_one_of_each(_clashing(docs)).collect()
    assert _same_extras(once) and [r.doc_id for r in once if r.text == text] == [1]


@pytest.mark.parametrize("broadcast", [48 << 20, -1])
def test_mixing_keeps_to_a_budget(spark, monkeypatch, broadcast):
    monkeypatch.setattr(workspace, "BROADCAST_BYTES", broadcast)
    rows = [(i, "w " * (1 + i % 7), "big") for i in range(400)] + [(1000 + i, "w w w", "small") for i in range(40)] + [(2000, "w", None), (2001, "", "empty"), (2002, None, "empty"), (None, "w", "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(_clashing(docs), budget=500).collect()
    assert _same_extras(got)
    spent = {}
    for r in got:
        spent[r.source] = spent.get(r.source, 0) + len((r.text or "").split())
    assert 500 - 3 * 8 <= sum(spent.values()) <= 500 and "empty" not in spent
    nameless = sorted(r.epoch for r in got if r.source is None)  # one text of one word, repeated as often as the weight asks
    assert nameless == list(range(len(nameless))) and 1 <= len(nameless) <= 4
    assert mix_sources(docs.where("source = 'empty'")).count() == 0
    more = mix_sources(docs, budget=10**9).groupBy("source", "doc_id").count().agg(F.max("count")).first()[0]
    assert more == 4


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_tokens_of_other_vocabularies(spark, name):
    texts = ["Plain words.", "", None, "Ünï 中文 <|endoftext|> \x1c a!\x1c b", "long " * 30_000]
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    if name.endswith(".model"):
        import sentencepiece

        plain = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name)).encode
    else:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(tokenizer_path(name))
        own.no_truncation()
        plain = lambda t: own.encode(t, add_special_tokens=False).ids
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in count_tokens(docs, name).collect()}
    assert got == {i: (len((t or "").encode()), len(plain(t or ""))) for i, t in enumerate(texts)}


def test_pieces_end_where_the_library_ends_a_word(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = ["!\x1c!\x1d\x85  x  y᠎​ " * 40, "a\x1f!! \x1e" * 99, "\n\n  x\r\n" * 60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chars in (1, 2, 7):
        got = {r.doc_id: r.n_tokens for r in count_tokens(docs, "byte_bpe_50k.json", piece_chars=chars).collect()}
        assert got == {i: len(own.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_classes_and_counts_with_clashing_names(spark):
    assert {"__text", "__letter", "__id", "__nth", "__doc"} <= set(CLASHES)
    rows = [(i, "good words here" if i % 2 else "BAD 123", "de") for i in range(20)] + [(None, None, None), (3, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    clashing = _clashing(docs)
    for got in (score_quality(clashing, fit_quality(clashing, _clashing(labels))), identify_language(clashing, fit_language(clashing)), count_tokens(clashing)):
        got = got.collect()
        assert len(got) == len(rows) and _same_extras(got)


def test_token_batches_reach_beyond_arrow_batches(spark):
    texts = [("x" * (k % 50) + " é " * (k % 7)) * (k % 3) for k in range(700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = {most: {r.doc_id: (r.n_bytes, r.n_tokens) for r in count_tokens(docs, batch_bytes=most, piece_chars=9).collect()} for most in (1, 500, 1 << 20)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[1] == got[500] == got[1 << 20] and len(got[1]) == 700 and all(got[1][k][0] == len(t.encode()) for k, t in enumerate(texts))


def test_scores_of_awkward_rows(spark):
    rows = [(i, "a b c a b") for i in range(12)] + [(None, "a b"), (None, None), (50, ""), (51, None), (51, "z " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = score_texts(_clashing(docs.withColumn("score", F.lit("own")))).collect()
    assert len(got) == len(rows) and _same_extras(got)
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False, False]
    assert {r.n_tokens for r in got if r.doc_id == 51} == {1, 50_001}
