"""Sources, draws, token sequences, evaluation records and neighbours on awkward rows."""

import difflib
import html
import json
import math

import pytest
from pyspark.sql import functions as F

from siftwright.functions.text import unescaped
from siftwright.functions.tokens import clean_completion, learning_rate, swapped, with_begin
from siftwright.operators.evaluation import last_records, line_from_end, looked_up, mode_report, weighted_mean
from siftwright.operators.matching import generic
from siftwright.operators.nearest import nearest, top_k
from siftwright.operators.questions import from_split
from siftwright.operators.reports import with_position
from siftwright.plans.matching import sequence_ratio
from siftwright.sources.jsonl import newest_steps, read_bench, read_jsonl, read_pool, read_shots, read_splits, result_records, run_of, unicode_lines, with_overrides


def _write(path, *rows):
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n\n", encoding="utf-8")
    return str(path)


def test_sources(spark, tmp_path):
    pool = _write(tmp_path / "p.jsonl", {"question": "q", "options": [["A", "x"], ["B", "y"]], "answer": "A", "category": "c", "source": "s"})
    assert [[tuple(o) for o in r.options] for r in read_pool(spark, pool).collect()] == [[("A", "x"), ("B", "y")]]
    bench = _write(tmp_path / "b.jsonl", {"question": "q", "options": [{"A": "x"}, {"B": "y"}], "answer": "B", "category": "c"})
    (row,) = read_bench(spark, bench).collect()
    assert (row.macro, [tuple(o) for o in row.options]) == ("", [("A", "x"), ("B", "y")])
    assert read_shots(spark, bench).columns == ["question", "options", "answer", "category"]
    with pytest.raises(ValueError):
        read_shots(spark, bench, most=0)
    rows, warnings = read_splits(spark, {"one": pool, "gone": str(tmp_path / "none.jsonl")}, "question string")
    assert [(r.question, r.split, r.file_order) for r in rows.collect()] == [("q", "one", 0)]
    assert [(r.split, r.kind, r.n) for r in warnings.collect()] == [("gone", "source", 1)]
    file = tmp_path / "custom_openai_big_italic_fast_1.json"
    file.write_text(json.dumps({"results": [{"index": 1, "output": "A", "answer": "A"}, {"index": 2, "output": "", "answer": "B"}, {"index": 1, "output": "C", "answer": "A"}]}))
    named = read_jsonl(spark, str(file), "results array<struct<index:int,output:string,answer:string>>", with_file=True)
    assert tuple(named.select(*run_of()).first()) == ("big", "fast")
    got = {r["index"]: r["output"] for r in result_records(named, "big", "fast").collect()}
    assert got == {1: "C", 2: ""}
    text = "a b\x85c\r\nd\n"
    lines = unicode_lines(spark.createDataFrame([(text,)], "value string"))
    assert [r.line for r in lines.collect()] == text.splitlines()
    assert newest_steps(["step_2", "final", "step_10", "step_9"], 2) == ["step_2"]
    assert with_overrides({"a": 1, "b": False, "c": 0.5}, ["a=3", "b=Yes", "c=2"]) == {"a": 3, "b": True, "c": 2.0}
    with pytest.raises(KeyError):
        with_overrides({"a": 1}, ["z=1"])


def test_options_of_three_layouts(spark):
    rows = [(" q ", ['{"key":"C","value":" x "}', '{"value":"y"}'], "A", "", "m"), ("q", ['{"D":"x"}', "plain"], None, None, None), (" ", ["a"], "A", "c", "m"), ("q", [], "A", "c", "m"), (None, None, None, None, None)]
    got = from_split(spark.createDataFrame(rows, "question string, options array<string>, answer string, category string, macro string"), "test").collect()
    assert [(r.question, [tuple(o) for o in r.options], r.answer, r.category) for r in got] == [("q", [("C", "x"), ("B", "y")], "A", "m"), ("q", [("D", "x"), ("B", "plain")], "", "test")]


def test_token_sequences(spark):
    rows = spark.createDataFrame([([5, 128256, 7],), ([5, 128258, 7],), ([128300],), ([],), ([1, 128001, 128300],), (None,), ([1, 2],)], "ids array<bigint>")
    got = [r[0] for r in rows.select(clean_completion(F.col("ids"))).collect()]
    assert got == [[5, 128256], [5], [], [], [1, 128001], None, [1, 2]]
    assert rows.select(swapped(F.col("ids"))).first()[0] == [5, 128009, 7]
    assert [r[0] for r in rows.select(with_begin(F.col("ids"), 5)).collect()][:4] == [[5, 128256, 7], [5, 128258, 7], [5, 128300], [5]]
    steps = spark.createDataFrame([(k,) for k in (0, 9, 10, 60, 200)], "s int")
    want = [0.1, 1.0, 1.0, 0.5 * (1 + math.cos(math.pi * 50 / 90)), 0.0]
    assert [r[0] for r in steps.select(learning_rate(F.col("s"), 1.0, 10, 100)).collect()] == pytest.approx(want)
    assert [r[0] for r in steps.select(learning_rate(F.col("s"), 1.0, 10, 100, "constant")).collect()] == pytest.approx([0.1, 1.0, 1.0, 1.0, 1.0])


def test_evaluation_records(spark):
    rows = [("m", "fast", 1, 0, "zzz", "A"), ("m", "fast", 1, 1, "A", "A"), ("m", "slow", 1, 0, "Risposta: B", "A"), ("m", "slow", 2, 0, None, "A")]
    records = last_records(spark.createDataFrame(rows, "model string, mode string, index int, at int, output string, answer string"), ["model", "mode", "index"], F.col("at"))
    got = {r["mode"]: (r["n"], r["official"], r["robust"], r["blank"]) for r in mode_report(records).collect()}
    assert got == {"fast": (1, 1.0, 1.0, 0.0), "slow": (2, 0.0, 0.0, 0.5)}
    text = "a\nb\r\nc\n"
    assert spark.range(1).select(line_from_end(F.lit(text), 2)).first()[0] == text.splitlines()[-2]
    table = spark.createDataFrame([(1, "x")], "k int, macro string")
    assert looked_up(spark.createDataFrame([(1,)], "k int"), table, "k").collect()[0].macro == "x"
    with pytest.raises(Exception, match="no k 2"):
        looked_up(spark.createDataFrame([(2,)], "k int"), table, "k").collect()
    means = spark.createDataFrame([(1.0, 1), (4.0, 2)], "v double, n int")
    assert means.agg(weighted_mean(F.col("v"), F.col("n"))).first()[0] == pytest.approx(3.0)
    assert means.limit(0).agg(weighted_mean(F.col("v"), F.col("n"))).first()[0] is None


def test_neighbours_of_awkward_vectors(spark):
    pool = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [1.0, 0.0, 0.0]), (7, [2.0, 0.0]), (8, [float("nan"), 1.0]), (9, [])]
    bench = [(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [3.0, 0.0]), (13, None), (None, [1.0, 0.0])]
    p, b = (spark.createDataFrame(x, "vec_id long, embedding array<double>") for x in (pool, bench))
    got = {r.vec_id: (r.bench_id, round(r.sim, 6)) for r in nearest(p, b).collect()}
    assert got == {1: (10, 1.0), 2: (10, round(math.sqrt(0.5), 6)), 7: (10, 1.0)}
    best = {}
    for r in top_k(p, b, 2).orderBy("bench_id", "rank").collect():
        best.setdefault(r.bench_id, []).append(r.vec_id)
    assert best == {10: [1, 7], 11: [2, 1], 12: [1, 7]}
    assert top_k(p.limit(0), b).count() == 0 and nearest(p, b.limit(0)).count() == 0


def test_positions_and_texts(spark):
    keys = [5, 5, 9, 100, 103, 250_000, None]
    got = [(r.k, r.position) for r in with_position(spark.createDataFrame([(k,) for k in keys], "k long"), "k", block=50).orderBy("k").collect()]
    assert got == [(None, None), (5, 0), (5, 0), (9, 2), (100, 3), (103, 4), (250_000, 5)]
    texts = [("a &amp; b", "a & c"), ("x" * 300, "x" * 150), (None, "a"), ("&amp;egrave;", "")]
    rows = spark.createDataFrame(texts, "a string, b string")
    assert [r[0] for r in rows.select(unescaped(F.col("a"))).collect()] == [None if a is None else html.unescape(a) for a, _ in texts]
    want = [None if a is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in texts]
    assert [r[0] for r in rows.select(sequence_ratio("a", "b")).collect()] == want
    sets = spark.createDataFrame([(["vero", "falso"],), (["si", "no", "x"],), (["vero", "x"],), (["vero", "falso", "x", "y"],), ([],)], "o array<string>")
    assert [r[0] for r in sets.select(generic(F.col("o"))).collect()] == [True, True, False, False, False]
