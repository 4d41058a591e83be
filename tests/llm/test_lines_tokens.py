"""Line dedup and token counts against plain Python on awkward rows."""

import random

import pytest

from siftwright.llm.line_dedup import dedup_lines
from siftwright.llm.token_count import count_tokens, split_safely, tokenizer_path

RUN = "\n".join(f"line {k} of a passage that two documents share word for word" for k in range(8))


def test_later_runs_go_and_the_rest_stays(spark):
    rows = [(1, f"first\n{RUN}\nend"), (2, f"other start\n\n{RUN}\nits own end"), (3, "short\nlines"), (4, "short\nlines"), (5, None), (6, ""), (7, f"{RUN}\n{RUN}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(docs).collect()}
    assert got[1] == (rows[0][1], 0)
    assert got[2][0].replace("\n\n", "\n") == "other start\nits own end" and got[2][1] >= 8
    assert [got[k][0] for k in (3, 4, 5, 6)] == ["short\nlines", "short\nlines", None, ""]
    assert "passage" not in got[7][0]
    assert dedup_lines(docs.limit(0)).count() == 0


def test_counts_are_those_of_whole_texts(spark):
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    long = "wörter and  spaces\n\n\tevery <|endoftext|> where, 12345 " * 900
    rows = [(1, "hello world"), (2, None), (3, ""), (4, long), (4, long), (5, "x" * 5000), (6, " " * 3000)]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), piece_chars=700, batch_bytes=2000).collect()
    want = [(i, len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == sorted(want)
    assert "".join(split_safely(long, 700)) == long


def _passage(name, words):
    return " ".join(f"{name}{k}" for k in range(words))


def _texts_after(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    return [r.text for r in dedup_lines(docs, **more).orderBy("doc_id").collect()]


def test_a_run_goes_as_far_as_any_earlier_place_reaches(spark):
    w, tail = _passage("w", 60), _passage("t", 40)
    texts = [f"{w}\nanother", f"one\n{w}\n{tail}", f"start\n{w}\n{tail}\nend"]
    assert _texts_after(spark, texts) == [texts[0], f"one\n{tail}", "start\nend"]


def _plain(texts, least):
    """By the definition: every run of least words or more against every earlier run."""
    lines = [[(i, x.strip()) for i, x in enumerate(t.split("\n")) if x.strip()] for t in texts]
    out = []
    for d, own in enumerate(lines):
        gone = set()
        for b in range(len(own)):
            for e in range(b + 1, len(own) + 1):
                run = [x for _, x in own[b:e]]
                if sum(len(x.split()) for x in run) < least:
                    continue
                for c in range(d + 1):
                    for k in range(len(lines[c]) if c < d else b):
                        if [x for _, x in lines[c][k : k + e - b]] == run:
                            # an earlier occurrence in the same text stays, also where this one overlaps it
                            start = own[b][0] if c < d else max(own[b][0], own[k + e - b - 1][0] + 1)
                            gone.update(range(start, own[e - 1][0] + 1))
        out.append("\n".join(x for i, x in enumerate(texts[d].split("\n")) if i not in gone))
    return out


def test_lines_are_those_of_plain_comparison(spark):
    r = random.Random(8)
    pool = ["a", "b c", "d e f", "g h i j", "", " l m ", "n o p q r s t", "u v w x y z 1 2 3", "4 5 6 7 8 9 10 11 12 13"]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randrange(1, 9))) for _ in range(60)]
    texts += ["\n".join(r.choice(pool[:6]) for _ in range(r.randrange(9, 30))) for _ in range(30)]
    want = _plain(texts, 9)
    assert sum(a != b for a, b in zip(texts, want)) > 15
    assert _texts_after(spark, texts, min_words=9) == want


def test_a_run_of_the_same_text_goes_to_its_end(spark):
    p, tail, before = _passage("p", 60), _passage("t", 10), _passage("b", 10)
    kept = f"{before}\n{p}\n{tail}\nother"
    assert _texts_after(spark, [f"{kept}\n{before}\n{p}\n{tail}"]) == [kept]
    assert _texts_after(spark, [f"{p}\n{p}\n{p}\n{tail}"]) == [f"{p}\n{tail}"]
