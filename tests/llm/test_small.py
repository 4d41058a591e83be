"""WARC, embeddings and mixing against brute force on small awkward tables."""

import base64
import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwright.llm import embedding_dedup, mixing, workspace
from siftwright.llm.embedding_dedup import near_duplicates
from siftwright.llm.mixing import mix_sources, n_words
from siftwright.llm.warc import round_trip


def _pages():
    inner = "x WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.0\r\n\r\n"
    rows = [(i, f"http://a/{i}", "same" * 50) for i in range(7)]
    rows += [(20, "u\r\nWARC-Type: x%", inner), (21, None, None), (22, "é", ""), (23, "b", "ü" * 9000), (24, "c", "WARC/1.0\r\n" * 300), (24, "c", "WARC/1.0\r\n" * 300), (None, "d", "same" * 50)]
    return rows


@pytest.mark.parametrize("range_bytes", [97, 4096, 1 << 22])
def test_archives_give_back_every_page(spark, range_bytes):
    pages = spark.createDataFrame(_pages(), "page_id long, url string, html string")
    got = round_trip(pages.repartition(2), file_bytes=3000, range_bytes=range_bytes).collect()
    most = {}
    for i, _, h in _pages():
        if i is not None:
            most[h or ""] = max(i, most.get(h or "", i))
    want = []
    for i, u, h in _pages():
        h = h or ""
        first = most[h]
        data = h.encode()
        want.append((i, u, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), *(("response", None) if i == first else ("revisit", first))))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert all(bytes(r.payload).decode() in {h or "" for _, _, h in _pages()} for r in got if r.record_type == "response")
    assert round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize(("tile", "broadcast"), [(1024, 1 << 20), (7, 1 << 20), (7, -1)])
def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch, tile, broadcast):
    monkeypatch.setattr(workspace, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(embedding_dedup, "HOT", 4)
    monkeypatch.setattr(embedding_dedup, "MEET", 3)
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 24))
    rows = [(k, (centres[k % 6] + r.normal(size=24) * r.choice([0.0, 0.05, 0.12, 0.2])).tolist(), int(k % 2)) for k in range(150)]
    rows += [(200 + k, [0.5] * 24, 1) for k in range(9)] + [(300, [0.0] * 24, 1), (301, None, 1), (302, [float("nan")] * 24, 1), (303, [None] + [1.0] * 23, 1), (304, [0.5] * 24, None), (305, [], 1), (306, [0.5] * 23, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(vectors, tile=tile).collect()}
    able = [(i, np.array(v), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v))]
    links = {i: {j for j, w, m in able if i != j and lab == m and len(v) == len(w) and v @ w / math.sqrt(v @ v) / math.sqrt(w @ w) >= 0.98} for i, v, lab in able}
    assert sum(map(len, links.values())) > 100
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            new = links.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert got[i] == (len(links.get(i, ())), min(seen), min(seen) == i)
    assert len(got) == vectors.count() == near_duplicates(vectors, tile=tile).count()
    assert near_duplicates(vectors.limit(0)).count() == 0
    for other in (F.col("label").cast("long") + 2**40, F.concat(F.lit("label "), F.col("label").cast("string"))) if tile == 1024 else ():
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(vectors.withColumn("label", other)).collect()} == got


def _uneven():
    rows = [(i, "w " * (5 + i % 7), "hot") for i in range(900)] + [(1000 + i, "v " * 3, "mid") for i in range(60)] + [(2000 + i, "u", "rare") for i in range(6)]
    return [*rows, (3000, None, "mid"), (3001, "", "none"), (3002, "a b c", None), (3003, "z " * 4000, "mid"), (5, "w " * 10, "hot")]


def test_mixing_agrees_with_sql_and_keeps_to_the_budget(spark):
    docs = spark.createDataFrame(_uneven(), "doc_id long, text string, source string").withColumn("n_tokens", n_words(F.col("text")))
    got = mix_sources(docs.drop("text"), tokens=F.col("n_tokens")).toPandas()
    con = duckdb.connect()
    documents = pd.DataFrame(_uneven(), columns=["doc_id", "text", "source"])
    con.register("documents", documents)
    want = con.sql(mixing.SQL).df()
    key = lambda f: Counter((int(r.doc_id), str(r.source) if r.source else "None", int(r.n_tokens), int(r.epoch), r.draw) for r in f.astype(object).where(f.notna(), None).itertuples())
    assert key(got) == key(want)
    share = got.groupby(got["source"].fillna("null"))["n_tokens"].sum()
    total = int(docs.agg(F.sum("n_tokens")).first()[0])
    assert share.sum() <= total
    assert share["rare"] <= 4 * 6 and got[got.source == "rare"].epoch.max() >= 1
    assert "none" not in share
    assert mix_sources(docs.limit(0)).count() == 0
