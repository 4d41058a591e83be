"""Operators that the tables don't exercise, against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from siftwright.functions.answers import announced_answer, robust_answer
from siftwright.functions.arrays import jaccard
from siftwright.functions.prompts import messages, plain_prompt
from siftwright.functions.text import plain_words
from siftwright.operators.lsh import bands_for, verified_candidates
from siftwright.operators.overlap import shared, shingles
from siftwright.operators.pool import keep_first
from siftwright.operators.questions import from_labels, from_letters, from_quiz
from siftwright.operators.reports import running_accuracy
from siftwright.sources.jsonl import read_jsonl, write_jsonl

SAID = [
    ("Ragiono.\nRisposta: B", "B", "B"),
    ("Risposta: la C\nA) no", "C", "C"),
    ("QUINDI, LA RISPOSTA È D", "D", "D"),
    ("la risposta corretta è la lettera A", "A", "A"),
    ("Nessuna delle opzioni. Soluzione: C", "", "N"),
    ("nulla", "", ""),
    ("", "", ""),
    (None, None, None),
]


def test_answers(spark):
    rows = spark.createDataFrame([(k, s) for k, (s, _, _) in enumerate(SAID)], "k int, s string")
    got = rows.select("k", announced_answer(F.col("s")), robust_answer(F.col("s"))).orderBy("k").collect()
    assert [tuple(r)[1:] for r in got] == [w[1:] for w in SAID]


def test_sources_have_one_schema(spark):
    quiz = spark.createDataFrame(
        [
            (" Q? ", [("A", " x ", None), ("B", "y", None)], "B", "ab__cd__e", None, None, None, None),
            ("Q?", [("A", "x", "i.png"), ("B", "y", None)], "B", None, "M", None, None, None),
            ("Q?", [("A", "x", None), ("B", " ", None)], "B", None, "M", None, None, None),
            ("Q?", [("A", "x", None), ("B", "y", None)], "A", None, "Mac", None, "", None),
            (None, None, None, None, None, None, None, None),
        ],
        "question string, options array<struct<value:string,text:string,image:string>>, answer string, genCode string, macro string, image string, table string, context string",
    )
    assert [(r.question, r.answer, r.category) for r in from_quiz(quiz).collect()] == [("Q?", "B", "cd__e"), ("Q?", "A", "mac")]
    letters = spark.createDataFrame([("Q", ["a", "b"], "B", "Two Words"), ("Q", ["a"], "A", None), ("Q", ["a", "b"], "C", None), ("Q", ["a", "b"], "A", "")], "question string, options array<string>, answer string, category string")
    assert [(r.answer, r.category) for r in from_letters(letters).collect()] == [("B", "two_words"), ("A", "conoscenze_generali")]
    labels = spark.createDataFrame([("Q", ["a", "b"], 1, ("S T",)), ("Q", ["a", "b"], 2, None), ("Q", ["a", "b"], None, None), ("Q", ["a", "b"], -1, None)], "input_translation string, choices_translation array<string>, label int, metadata struct<subject:string>")
    assert [(r.answer, r.category) for r in from_labels(labels).collect()] == [("B", "s_t")]


def test_shared_shingles_and_bands(spark):
    texts = {1: "a b c d e f g h", 2: "A  b c d\te f g h", 3: "x y", 4: "", 5: None, 6: "b c d e f g h i"}
    rows = spark.createDataFrame(list(texts.items()), "i long, t string").select("i", plain_words(F.col("t")).alias("p")).select("i", shingles(F.col("p"), 3).alias("items"))

    def of(t):
        w = re.sub(r"\s+", " ", (t or "").lower()).strip().split()
        return {" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()

    want = {(a, b): (len(of(s) & of(t)), len(of(s) | of(t))) for a, s in texts.items() for b, t in texts.items() if of(s) & of(t)}
    right = rows.withColumnRenamed("i", "j")
    assert {(r.i, r.j): (r.inter, r.n_union) for r in shared(rows, "i", right, "j").collect()} == want
    for least in (0.1, 0.9, 1.0):
        met = {(r.i, r.j): r.jaccard for r in verified_candidates(rows, "i", right, "j", least).collect()}
        assert met == {k: pytest.approx(a / b) for k, (a, b) in want.items() if a / b >= least}
    assert [bands_for(x) for x in (0.1, 0.7, 1.0)] == [1, 4, 128]


def test_first_rows_of_keys(spark):
    rows = spark.createDataFrame([(k, k % 3 if k % 7 else None, 10 - k, "t" * k) for k in range(12)], "i long, k long, o long, text string")
    whole, by_id = (sorted(map(tuple, keep_first(rows, F.col("k"), [F.col("o")], row_id).collect()), key=str) for row_id in (None, "i"))
    best = {}
    for r in rows.collect():
        best[r.k] = min(best.get(r.k, r), r, key=lambda x: x.o)
    assert whole == by_id == sorted(map(tuple, best.values()), key=str)


def test_small_functions(spark, tmp_path):
    rows = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in rows.select(jaccard(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 3), 0.0]
    chat = messages(F.lit("S"), [(F.lit("Q1"), F.lit("A"))], F.lit("Q2"))
    assert spark.range(1).select(plain_prompt(chat)).first()[0] == "S\n\nQ1\n\nA\n\nQ2\n"
    marks = [(k, k % 3 == 0) for k in range(25)]
    got = running_accuracy(spark.createDataFrame(marks, "k long, r boolean"), "k", F.col("r"), block=4).orderBy("k").collect()
    assert [(r.seen, r.n_right) for r in got] == [(k + 1, sum(x for _, x in marks[: k + 1])) for k, _ in marks]
    write_jsonl(spark.createDataFrame([(1, "è")], "i long, t string"), str(tmp_path / "x"))
    assert [tuple(r) for r in read_jsonl(spark, str(tmp_path / "x"), "i long, t string").collect()] == [(1, "è")]
